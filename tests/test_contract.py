"""Driver contract, plan shape and comparison on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("documents", "pages", "events")
CHECKED = [
    "agg_01_source_summary", "win_04_balanced_latest", "win_03_round_robin", "win_05_prune_excess", "win_07_dedup_titles",
    "win_01_feed_window", "join_01_match_existing", "upd_01_plan_fetch", "upd_02_apply_fetch", "upd_15_integrity_job",
    "fn_04_resolve_url", "src_01_read_feeds", "src_04_read_opml", "agg_07_directory_report", "ext_08_strip_badge_clusters",
    "ext_15_recover_placeholder_images", "win_13_pick_hero", "str_04_user_actions",
]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"id", "source_title", "unread_count"} <= set(rows[0].asDict())


def test_every_query_has_a_callable():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 180
    assert all(callable(q) for q in queries.values())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_matches_comparison_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(map(str, r)) for r in rel.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", [
    "join_01_match_existing", "join_03_new_items", "upd_01_plan_fetch", "win_01_feed_window", "win_05_prune_excess",
    "upd_15_integrity_job", "join_09_mark_subscribed", "set_05_discover_candidates"])
def test_no_products_or_python(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for bad in ("NestedLoop", "CartesianProduct", "PythonUDF", "MapInArrow", "ArrowEvalPython"):
        assert bad not in plan


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    plan = entry.queries()["win_08_top_per_source"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scan_reads_only_what_is_needed(spark, sf):
    plan = entry.queries()["agg_01_source_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in plan


def test_partitions_stay_small_as_the_input_grows(spark):
    """A task's sorts hold many times what it reads, so it reads a few megabytes at most."""
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(0, 2_000_000, 1, 4).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("noise"))
        assert rows.repartition("id").rdd.getNumPartitions() >= 8  # 64 MB of noise
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
