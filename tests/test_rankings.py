"""Set-based rankings against sequential models."""

import random

from pyspark.sql import Window, functions as F

from feedloom.operators import extract as E, intake, skew


def _items(rng, n):
    return [
        ("s" + str(rng.randint(0, 2)), f"u{rng.randint(0, 12)}", f"t{rng.randint(0, 12)}", rng.choice([None, *range(6)]), i)
        for i in range(n)
    ]


def test_feed_window_equals_sequential_filter(spark):
    rng = random.Random(1)
    rows = _items(rng, 300)
    df = spark.createDataFrame(rows, "source_id string, url string, title string, d int, pos bigint").withColumn(
        "published_at", F.timestamp_seconds("d"))
    source = spark.createDataFrame([("s0", None), ("s1", "full"), ("s2", "standard")], "id string, cache_level string")
    got = {(r.source_id, r.pos) for r in intake.feed_window(df, source).collect()}
    want = set()
    for s, cap in (("s0", 25), ("s1", 10), ("s2", 25)):
        seen_u, seen_t, kept = set(), set(), []
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (-(r[3] if r[3] is not None else -1), r[4]))
        for _, u, t, _, pos in mine:
            new_u, new_t = u not in seen_u, t not in seen_t
            seen_u.add(u), seen_t.add(t)
            if new_u and new_t:
                kept.append((s, pos))
        want |= set(kept[:cap])
    assert got == want


def test_beyond_top_k_and_rank_with_one_hot_key(spark):
    df = spark.range(3000).select(
        F.expr("CASE WHEN id % 3 = 0 THEN concat('k', id % 50) ELSE 'hot' END").alias("key"),
        F.expr("id * 7919 % 97").alias("moment"), F.col("id").cast("string").alias("id"))
    w = Window.partitionBy("key").orderBy(F.col("moment").desc(), "id")
    full = df.withColumn("rn", F.row_number().over(w))
    want = {r.id for r in full.filter("rn > 20").collect()}
    assert {r.id for r in skew.beyond_top_k(df, ["key"], "moment", "id", 20).collect()} == want
    ranks = {r.id: r.rn for r in skew.rank_within(df, "key", [F.col("moment").desc(), F.col("id")]).collect()}
    assert ranks == {r.id: r.rn for r in full.collect()}


def test_image_dedup_equals_greedy_scan(spark):
    rng = random.Random(2)
    hosts, files = ["https://a.com", "https://b.com", ""], ["/p/q/x.jpg", "/r/q/x.jpg", "/h/x.jpg", "/z/image.jpg", "/y/image.jpg", "/w/640x480.jpg"]
    rows = [(p, i, rng.choice(hosts) + rng.choice(files) + rng.choice(["", "?w=1", "?id=1", "?id=2"])) for p in range(20) for i in range(15)]
    df = spark.createDataFrame(rows, "page_id int, pre int, src string")
    got = {(r.page_id, r.pre) for r in E.duplicate_images(df).filter("duplicate").collect()}
    generic = {"image.jpg", "640x480.jpg"}
    want = set()
    for p in range(20):
        srcs, bases, files_seen = set(), set(), set()
        for _, i, src in (r for r in rows if r[0] == p):
            if src in srcs:
                want.add((p, i))
                continue
            srcs.add(src)
            if not src.startswith("https://"):
                continue
            path, _, q = src.partition("?")
            base = path + ("?" + q if q.startswith("id=") else "")
            if base in bases:
                want.add((p, i))
                continue
            bases.add(base)
            host, segs = path.split("/")[2], [s for s in path.split("/")[3:] if s]
            if segs[-1] in generic:
                continue
            key = (host, segs[0], segs[-1]) if len(segs) == 2 else (host, segs[-1])
            if key in files_seen:
                want.add((p, i))
            files_seen.add(key)
    assert got == want


def test_upsert_latest_wins(spark):
    from feedloom.operators.maintenance import upsert

    cur = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ch = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("c", 9, 1)], "id string, v int, n int")
    assert sorted(map(tuple, upsert(cur, ch, "id", F.col("n")).collect())) == [("a", 6), ("b", 2), ("c", 9)]
