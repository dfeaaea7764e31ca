from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom import schema as S
from feedloom.operators import intake, maintenance
from feedloom.operators.library_store import LibraryIndex, LibraryStore
from feedloom.streaming import tables


def library(spark):
    source = S.conform(spark.createDataFrame([(s, f"Title {s}") for s in ("s", "t", "u", S.SAVED_PAGES_ID)], "id string, title string"), S.SOURCE)
    rows = [(str(k), "stu"[k % 3], f"t{k}", f"https://x.example.com/{k}", datetime(2024, 1, 1), k % 4 == 0) for k in range(24)]
    article = S.conform(spark.createDataFrame(
        rows, "id string, source_id string, title string, article_url string, added_at timestamp, is_saved boolean"), S.ARTICLE)
    page = S.conform(article.select(F.col("id").alias("article_id")), S.CACHED_PAGE)
    return source, article, page


def contents(store, spark):
    now = store.read(spark)
    return {n: sorted((tuple(r) for r in now[n].select(*c).collect()), key=str) for n, c in (
        ("source", ["id"]), ("article", ["id", "source_id", "original_source_name"]), ("cached_page", ["article_id"]), ("address", ["article_url", "id", "source_id"]))}


def test_deletion_equals_the_plain_one_and_tables_agree(spark, tmp_path):
    store, parts = LibraryStore(str(tmp_path), 3), library(spark)
    store.load(*parts, 0)
    gone = spark.createDataFrame([("s",), ("u",), ("s",), ("none",)], "id string")
    store.delete_sources(gone, 1)
    want = maintenance.delete_source(gone, *parts)
    got = contents(store, spark)
    assert got["source"] == sorted((tuple(r) for r in want["source"].select("id").collect()), key=str)
    assert got["article"] == sorted((tuple(r) for r in want["article"].select("id", "source_id", "original_source_name").collect()), key=str)
    assert got["cached_page"] == sorted((tuple(r) for r in want["cached_page"].select("article_id").collect()), key=str)
    assert {(i, s) for _, i, s in got["address"]} == {(i, s) for i, s, _ in got["article"]}
    store.delete_sources(gone, 1)
    assert contents(store, spark) == got


@pytest.mark.parametrize("step", [0, 1, 2, 3, "commit"])
def test_a_crash_at_any_step_changes_nothing(spark, tmp_path, monkeypatch, step):
    store = LibraryStore(str(tmp_path), 2)
    store.load(*library(spark), 0)
    before, calls = contents(store, spark), []
    name = "commit" if step == "commit" else "update"
    real = getattr(tables.Batch, name)

    def fails(self, *args):
        calls.append(1)
        if step == "commit" or len(calls) == step + 1:
            raise OSError("lost")
        return real(self, *args)

    gone = spark.createDataFrame([("s",)], "id string")
    with monkeypatch.context() as m:
        m.setattr(tables.Batch, name, fails)
        with pytest.raises(OSError):
            store.delete_sources(gone, 1)
    assert contents(store, spark) == before
    store.delete_sources(gone, 1)
    after = contents(store, spark)
    assert len(after["source"]) == 3 and not any(s == "s" for _, s, _ in after["article"])
    assert {i for i, _, _ in after["article"]} == {i for _, i, _ in after["address"]} == {i for i, in after["cached_page"]}


def test_a_lookup_does_not_move_the_library(spark, tmp_path):
    _, article, _ = library(spark)
    index = LibraryIndex(spark, str(tmp_path), 8).build(article)
    items = spark.createDataFrame([("s", 0, "https://x.example.com/0", "other"), ("s", 1, "https://new.example.com", "t3"), ("t", 2, "https://x.example.com/0", "t3"),
                                   ("u", 3, None, None)], "source_id string, pos int, url string, title string")
    want = sorted((tuple(r) for r in intake.match_existing(items, article).select("source_id", "pos", "existing_id", "matched_by").collect()), key=str)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = index.match(items).select("source_id", "pos", "existing_id", "matched_by")
        assert sorted((tuple(r) for r in found.collect()), key=str) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # One exchange for each join, both above the items; the tables are scanned in buckets.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") == 2
    assert all("parquet" not in "\n".join(part.split("\n")[1:4]) for part in plan.split("Exchange hashpartitioning")[1:])
    index.drop()


def test_tables_and_staged_rows_are_stored_densely(spark, tmp_path):
    import pyarrow.parquet as pq
    from feedloom.streaming.tables import Store

    store = Store(str(tmp_path / "dense"))
    table = store.table("t", "id STRING, text STRING", "id", 2)
    rows = spark.createDataFrame([(str(k), f"text {k} " * 50) for k in range(20)], "id string, text string")
    with store.batch(spark, 0) as batch:
        assert batch.stage(rows, "rows").count() == 20
        staged = list((tmp_path / "dense" / "_work").rglob("*.parquet"))
        batch.update(table, rows, lambda current, new: current.unionByName(new))
        files = staged + list((tmp_path / "dense").rglob("bucket=*/*.parquet"))
        kinds = {pq.ParquetFile(f).metadata.row_group(0).column(1).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups}
    assert staged and kinds == {"ZSTD"}
    assert sorted(r.id for r in table.read(spark).collect()) == sorted(str(k) for k in range(20))
