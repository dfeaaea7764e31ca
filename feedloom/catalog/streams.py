"""Queries over the streaming jobs: given rows are replayed in several micro-batches, and the
final tables are compared with the same result computed at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom import schema as S
from feedloom.catalog import derive as D
from feedloom.catalog.registry import big, query, ts
from feedloom.operators import library as L
from feedloom.session import shared_dir, spread
from feedloom.streaming import jobs
from feedloom.streaming.tables import STORED, run
from feedloom.streaming.timers import StaleClock

HIDDEN = S.SAVED_PAGES_ID
R = "fetch_status IN ('cached', 'partial')"
M = "coalesce(published_at, added_at)"
PARTS, BUCKETS = 3, 4


def root_dir(spark, name: str) -> str:
    return f"{shared_dir(spark)}/feedloom/{name}-{uuid.uuid4().hex}"


def drain(df: DataFrame, part, step, root: str) -> None:
    """Give a job the rows in ``PARTS`` micro-batches, part 0 first.

    Every part is written with its own partitions, then the stream runs until its input is used
    up; it goes on from its checkpoint with the next part.
    """
    spark, staged = df.sparkSession, df.withColumn("_part", part)
    for i in range(PARTS):
        staged.filter(F.col("_part") == i).drop("_part").write.option("compression", STORED).mode("append").parquet(f"{root}/input")
        run(spark.readStream.schema(df.schema).parquet(f"{root}/input"), step, f"{root}/checkpoint").awaitTermination()


def replay(spark, sf, name: str, parts: list, step, root: str) -> None:
    """Give a job a given table once for each of ``parts``, which make the changes of its rows.

    The table's files are streamed as they are: wide rows need not be stored again before the
    job stores them. Each part has a stream and a checkpoint of its own.
    """
    schema = D.table(spark, sf, name).schema
    for i, part in enumerate(parts):
        stream = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")  # a pattern: a table may be a single file
        run(stream, lambda rows, batch_id, i=i, part=part: step(part(spread(rows)), 1000 * i + batch_id), f"{root}/checkpoint-{i}").awaitTermination()


def _thirds(c: str):
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


def _live(spark, sf) -> jobs.LiveLibrary:
    root = root_dir(spark, "live")
    half = F.pmod(F.xxhash64("id"), F.lit(2))

    def final(rows):
        return D.article_of(rows).withColumn("change_at", F.lit(2)).withColumn("change_seq", F.lit(0))

    def early(rows):
        """Each article arrives unread first and in its final state later. A fifth arrives in
        another source, which it leaves later and which ends up empty."""
        return final(rows).withColumn("is_read", F.lit(False)).withColumn("reading_minutes", F.lit(0)).withColumn("change_at", F.lit(1)).withColumn(
            "source_id", F.when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, "elsewhere").otherwise(F.col("source_id")))

    live = jobs.LiveLibrary(root, buckets=BUCKETS)
    replay(spark, sf, "documents", [early, lambda rows: final(rows).filter(half == 0), lambda rows: final(rows).filter(half == 1)], live.step, root)
    return live


@query("str_01_live_summary", f"""
SELECT source_id, least(count(*), 25) AS article_count, least(count(*) FILTER (WHERE NOT is_read), 25) AS unread_count,
  CAST(coalesce(sum(reading_minutes), 0) AS BIGINT) AS reading_minutes_total FROM t_article WHERE {R} GROUP BY source_id""")
def live_summary(spark, sf):
    return _live(spark, sf).summary.read(spark).select(
        "source_id", big("article_count"), big("unread_count"), big("reading_minutes_total"))


@query("str_01_live_list", f"""
SELECT id, source_id, rn FROM (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY {M} DESC, id) AS rn
  FROM t_article WHERE {R}) WHERE rn <= 5""")
def live_list(spark, sf):
    return _live(spark, sf).latest.read(spark).select("id", "source_id", big("rn"))


@query("str_02_live_carousels", f"""
SELECT 'balanced' AS list, id FROM (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY {M} DESC, id) AS turn,
    max({M}) OVER (PARTITION BY source_id) AS newest FROM t_article WHERE {R} AND source_id <> '{HIDDEN}' AND thumbnail_url IS NOT NULL
  ORDER BY turn, newest DESC, source_id LIMIT 30)
UNION ALL SELECT 'saved', id FROM (SELECT id FROM t_article WHERE is_saved AND fetch_status <> 'failed' AND thumbnail_url IS NOT NULL
  ORDER BY saved_at DESC, added_at DESC, id LIMIT 10)""")
def live_carousels(spark, sf):
    live = _live(spark, sf)
    return live.balanced.read(spark).select(F.lit("balanced").alias("list"), "id").unionByName(
        live.saved.read(spark).select(F.lit("saved").alias("list"), "id"))


_WIDGETS = " UNION ALL ".join(
    f"""SELECT '{size}' AS size, id, rn FROM (SELECT id, row_number() OVER (ORDER BY {M} DESC, id) AS rn FROM t_article
        WHERE {R} AND source_id <> '{HIDDEN}' {'' if size in jobs.ACCESSORIES else 'AND thumbnail_url IS NOT NULL'}) WHERE rn <= {k}"""
    for size, k in L.DISPLAY_ROWS.items())


@query("str_08_snapshots", f"SELECT * FROM ({_WIDGETS})")
def widget_snapshots(spark, sf):
    return _live(spark, sf).widgets.read(spark).select("size", "id", big("rn"))


@query("str_03_refresh_stream", r"""
, x AS (SELECT doc_id, source AS source_id, d_url AS url, d_published AS published_at,
    trim(CASE WHEN contains(d_title, '&') THEN replace(d_title, '&amp;', '&') ELSE d_title END) AS title, doc_id // 320 AS chunk FROM t_doc),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id, title ORDER BY published_at DESC NULLS LAST, chunk, doc_id) AS rt FROM x)
SELECT source_id, count(*) AS pending FROM k WHERE rt = 1 GROUP BY source_id""")
def refresh_stream(spark, sf):
    root = root_dir(spark, "refresh")
    docs = D.feed_xml(spark, sf).select(
        F.regexp_extract("feed_url", "https://([^.]+)", 1).alias("source_id"), "feed_url", "xml",
        F.expr("timestamp'2024-02-01'").alias("fetched_at"))
    job = jobs.RefreshStream(root, limit=None, buckets=BUCKETS)
    drain(docs, _thirds("feed_url"), job.step, root)
    return job.article.read(spark).groupBy("source_id").agg(F.count("*").alias("pending"))


def _by_chunk(c: str):
    return F.expr(f"cast(regexp_extract({c}, '/feed/([0-9]+)', 1) AS int) % {PARTS}")


_KEPT = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(published_at, TIMESTAMP '2024-02-01') DESC, id) AS rn FROM ({rows})) WHERE rn <= 25"
_FRESH = "SELECT * FROM k WHERE part = {part}"
_UNKNOWN = _FRESH + " AND NOT EXISTS (SELECT 1 FROM {known} l WHERE l.source_id = k.source_id AND l.title = k.title)"


@query("str_03_refresh_pruned", rf"""
, x AS (SELECT doc_id, source AS source_id, d_url AS article_url, d_published AS published_at, sha256(d_url) AS h, (doc_id // 320) % {PARTS} AS part,
    'https://' || source || '.example.com/feed/' || doc_id // 320 || '.xml' AS feed_url,
    trim(CASE WHEN contains(d_title, '&') THEN replace(d_title, '&amp;', '&') ELSE d_title END) AS title FROM t_doc),
k AS (SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id,
    source_id, title, article_url, published_at, part FROM (
  SELECT *, row_number() OVER (PARTITION BY part, source_id, title ORDER BY published_at DESC NULLS LAST, feed_url, doc_id) AS rt FROM x) WHERE rt = 1),
p0 AS ({_KEPT.format(rows=_FRESH.format(part=0))}),
p1 AS ({_KEPT.format(rows='SELECT * FROM p0 UNION ALL ' + _UNKNOWN.format(part=1, known='p0'))}),
p2 AS ({_KEPT.format(rows='SELECT * FROM p1 UNION ALL ' + _UNKNOWN.format(part=2, known='p1'))})
SELECT id, source_id, title, article_url, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM p2""")
def refresh_pruned(spark, sf):
    root = root_dir(spark, "refresh")
    docs = D.feed_xml(spark, sf).select(
        F.regexp_extract("feed_url", "https://([^.]+)", 1).alias("source_id"), "feed_url", "xml",
        F.expr("timestamp'2024-02-01'").alias("fetched_at"))
    job = jobs.RefreshStream(root, buckets=BUCKETS)
    drain(docs, _by_chunk("feed_url"), job.step, root)
    return job.article.read(spark).select("id", "source_id", "title", "article_url", ts("published_at"))


def _by_day(c: str):
    return F.least(F.floor((F.dayofmonth(c) - 1) / 10), F.lit(PARTS - 1)).cast("int")


@query("str_04_user_actions", """
, m AS (SELECT article_id, max((ts, seq)) AS mark FROM t_action WHERE action = 'read' GROUP BY 1),
n AS (SELECT x.article_id, count(*) AS n FROM t_action x LEFT JOIN m USING (article_id)
      WHERE x.action = 'toggle_read' AND (m.mark IS NULL OR (x.ts, x.seq) > m.mark) GROUP BY 1),
o AS (SELECT article_id, count(*) FILTER (WHERE action = 'toggle_save') % 2 = 1 AS is_saved, bool_or(action = 'fetch_failed') AS deleted FROM t_action GROUP BY 1)
SELECT o.article_id, (m.mark IS NOT NULL) <> (coalesce(n.n, 0) % 2 = 1) AS is_read, o.is_saved, o.deleted
FROM o LEFT JOIN m USING (article_id) LEFT JOIN n USING (article_id)""")
def user_actions(spark, sf):
    root = root_dir(spark, "actions")
    acts = D.user_action(spark, sf).withColumn("action", F.expr("CASE action WHEN 'fetch_failed' THEN 'delete' ELSE action END"))
    job = jobs.UserActions(root, BUCKETS)
    drain(acts, _thirds("seq"), job.step, root)  # any order: many arrive late
    return job.state.read(spark).select("article_id", "is_read", "is_saved", "deleted")


@query("str_05_retry_state", """
, e AS (SELECT *, CASE action WHEN 'fetch_failed' THEN 'failed' WHEN 'subscribe' THEN 'refetch' WHEN 'toggle_save' THEN 'ok' END AS outcome FROM t_action),
r AS (SELECT article_id, max((ts, seq)) AS reset FROM e WHERE outcome IN ('ok', 'refetch') GROUP BY 1),
f AS (SELECT e.article_id, count(*) AS n FROM e LEFT JOIN r USING (article_id) WHERE outcome = 'failed' AND (r.reset IS NULL OR (e.ts, e.seq) > r.reset) GROUP BY 1)
SELECT a.article_id, coalesce(f.n, 0) AS retry_count FROM (SELECT DISTINCT article_id FROM e WHERE outcome IS NOT NULL) a LEFT JOIN f USING (article_id)""")
def retry_state(spark, sf):
    root = root_dir(spark, "retry")
    tries = D.user_action(spark, sf).withColumn("outcome", F.expr(
        "CASE action WHEN 'fetch_failed' THEN 'failed' WHEN 'subscribe' THEN 'refetch' WHEN 'toggle_save' THEN 'ok' END")).filter(
        "outcome IS NOT NULL").select("article_id", "ts", "seq", "outcome")
    job = jobs.RetryCounter(root, BUCKETS)
    drain(tries, _thirds("seq"), job.step, root)
    return job.state.read(spark).select("article_id", big("retry_count"))


@query("str_06_stale_sources", f"""
, l AS (SELECT 'src' || user_id % 40 AS id, max(ts) AS at_ts FROM events GROUP BY 1)
SELECT s.id, CASE WHEN s.id = 'src2' THEN 'now' ELSE 'deferred' END AS priority FROM t_source s LEFT JOIN l USING (id)
WHERE s.id <> '{HIDDEN}' AND (l.at_ts IS NULL OR l.at_ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)""")
def stale_sources(spark, sf):
    root = root_dir(spark, "stale")
    done = D.user_action(spark, sf).select(F.expr("concat('src', user_id % 40)").alias("source_id"), "ts")
    job = jobs.StaleSources(root, D.source(spark, sf), "src2", BUCKETS)
    drain(done, _by_day("ts"), job.step, root)
    return job.plan.read(spark).select("id", "priority")


@query("str_06_stale_timers", f"""
, l AS (SELECT 'src' || user_id % 40 AS id, max(ts) AS at_ts FROM events GROUP BY 1)
SELECT coalesce(s.id, l.id) AS id, CASE WHEN coalesce(s.id, l.id) = 'src2' THEN 'now' ELSE 'deferred' END AS priority,
  strftime(coalesce(greatest(l.at_ts, s.last_fetched_at), l.at_ts, s.last_fetched_at), '%Y-%m-%d %H:%M:%S') AS last_fetched_at
FROM t_source s FULL JOIN l USING (id) WHERE coalesce(s.id, l.id) <> '{HIDDEN}'""")
def stale_timers(spark, sf):
    root = root_dir(spark, "timers")
    done = D.user_action(spark, sf).select(F.expr("concat('src', user_id % 40)").alias("source_id"), "ts")
    done.write.parquet(f"{root}/input")
    job = StaleClock(root, D.source(spark, sf), "src2", buckets=BUCKETS)
    job.settle(spark.readStream.schema(done.schema).parquet(f"{root}/input"))  # all fetches are long past: every timer fires
    return job.due(spark).select("id", "priority", ts("last_fetched_at"))


@query("str_07_suppress_deleted", f"""
SELECT source_id, count(*) AS kept FROM t_article WHERE source_id NOT IN (SELECT id FROM t_source WHERE fetch_status = 'failed') GROUP BY 1""")
def suppress_deleted(spark, sf):
    root = root_dir(spark, "deleted")
    gone = D.source(spark, sf).filter("fetch_status = 'failed'").select(F.col("id").alias("source_id"))

    def step(batch, batch_id):
        kept = jobs.without_deleted(batch, gone)
        kept.groupBy("source_id").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    drain(D.article(spark, sf).select("id", "source_id"), _thirds("id"), step, root)
    return spark.read.parquet(f"{root}/out").groupBy("source_id").agg(F.sum("n").alias("kept"))
