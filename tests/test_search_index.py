import random
import time

from pyspark.sql import functions as F

from feedloom.operators import library as L
from feedloom.operators.search_index import SearchIndex, grams, searched


def rows(spark, data):
    return spark.createDataFrame([(i, t) for i, t in data.items()], "id string, text string").select("id", searched(F.col("text")).alias("text"))


def found(index, spark, q):
    return {r.id for r in index.search(spark, q).collect()}


def test_equals_the_scan_after_any_changes(spark, tmp_path):
    rng = random.Random(1)
    words = ["The", "theatre", "ÉCOLE", "école", "x", "ab", "Abba", "日本語", "...", "the end", ""]
    index, data = SearchIndex(str(tmp_path), buckets=4), {}
    for batch in range(3):
        changes = {f"i{rng.randrange(60)}": " ".join(rng.choices(words, k=rng.randrange(0, 6))) for _ in range(40)}
        gone = {i for i in changes if rng.random() < 0.2}
        df = rows(spark, changes).withColumn("text", F.when(~F.col("id").isin(list(gone)), F.col("text")))
        index.update(df, batch)
        index.update(df, batch)  # committed: not applied again
        data = {i: t for i, t in {**data, **changes}.items() if i not in gone}
        for q in ("the", "THE E", "école", "本語", "日本語", "x", "", "zzz", "ab ab", "a", ". ", "bba"):
            assert found(index, spark, q) == {i for i, t in data.items() if q.lower() in t.lower()}, (batch, q)
    left = {(r.id, r.gram) for r in index.postings.read(spark).collect()}
    assert left == {(r.id, g) for r in index.texts.read(spark).select("id", grams(F.col("text")).alias("g")).collect() for g in r.g}


def test_no_match_spans_two_fields(spark, tmp_path):
    index = SearchIndex(str(tmp_path), buckets=2)
    df = spark.createDataFrame([("1", "one tw", "o three"), ("2", "one two", None)], "id string, a string, b string")
    index.update(df.select("id", searched(F.col("a"), F.col("b")).alias("text")), 0)
    assert found(index, spark, "two") == {"2"} and found(index, spark, "three") == {"1"}


def test_a_query_reads_matching_buckets_only(spark, tmp_path):
    index = SearchIndex(str(tmp_path), buckets=32)
    index.update(rows(spark, {str(i): f"title number {i * 7919} of them" for i in range(300)}), 0)
    everything = set(index.postings.read(spark).inputFiles())
    plan = index.candidates(spark, "7919").inputFiles()
    keys = spark.createDataFrame([("791",), ("919",)], "gram string")
    assert set(plan) <= set(index.postings.read(spark, None, index.postings.touched(keys)).inputFiles())
    assert len(plan) <= 2 and len(everything) > 20
    hits = index.candidates(spark, "7919")
    texts = index.search(spark, "7919").inputFiles()
    assert len([f for f in texts if "/texts/" in f]) <= len(index.texts.touched(hits))


def test_slots_of_a_list_of_any_length(spark):
    from datetime import datetime

    n = 500
    shown = spark.range(n).selectExpr("cast(id as string) id", "timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id % 50 as int)) published_at",
                                      "cast(null as timestamp) added_at")
    ranked = L.ranked_list(shown)
    want = {r.id: k + 1 for k, r in enumerate(sorted(shown.collect(), key=lambda r: (-r.published_at.timestamp(), r.id)))}
    assert {r.id: r.rn for r in ranked.collect()} == want
    stored = spark.createDataFrame(ranked.collect(), ranked.schema)
    slots = L.carousel_slots(stored, F.lit(datetime(2024, 1, 1)))
    got = slots.filter("slot = 7").collect()
    assert {r.id: r.slot_position for r in got} == {i: (rn - 1 - 7) % n for i, rn in want.items()}
    plan = slots._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and slots.count() == n * 180


def test_runs_of_a_long_text_take_time_by_its_length(spark):
    short = ["né😀x  y\n日本語", "ab", "", "a.b|c$"]
    for r in spark.createDataFrame([(t,) for t in short], "t string").select("t", grams(F.col("t")).alias("g")).collect():
        assert r.g == list(dict.fromkeys(r.t[i:i + 3] for i in range(len(r.t) - 2)))
    words = F.transform(F.sequence(F.lit(1), F.lit(25_000)), lambda i: F.substring(F.md5(i.cast("string")), 1, 6))
    long = spark.range(1).select(F.concat_ws(" ", words).alias("t")).localCheckpoint()
    start = time.perf_counter()
    assert long.select(F.size(grams(F.col("t")))).first()[0] > 4000
    assert time.perf_counter() - start < 10  # cut out by place, 80,000 characters took 12 s
