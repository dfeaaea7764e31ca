"""Queries over pruning, repair, deletion, fetch results and user changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom import schema as S
from feedloom.catalog import derive as D
from feedloom.catalog.library import NOW, now
from feedloom.catalog.registry import big, query, ts
from feedloom.operators import maintenance as X
from feedloom.operators.library_store import LibraryStore
from feedloom.session import shared_dir

HIDDEN = S.SAVED_PAGES_ID
M = "coalesce(published_at, added_at)"
R = "fetch_status IN ('cached', 'partial')"
U = "fetch_status IN ('pending', 'fetching', 'failed')"


def _ts(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def parts(spark, sf):
    return D.source(spark, sf), D.article(spark, sf), D.cached_page(spark, sf)


@query("win_05_prune_excess", f"""
, q AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {M} DESC, id) AS rn FROM t_article
        WHERE {R} AND source_id <> '{HIDDEN}')
SELECT q.id, CASE WHEN q.is_saved THEN 'detach' ELSE 'delete' END AS action,
  CASE WHEN q.is_saved THEN '{HIDDEN}' ELSE q.source_id END AS source_id,
  CASE WHEN q.is_saved THEN coalesce(q.original_source_name, s.title) ELSE q.original_source_name END AS original_source_name
FROM q LEFT JOIN t_source s ON s.id = q.source_id WHERE rn > 10""")
def prune_excess(spark, sf):
    return X.prune_excess(D.article(spark, sf), D.source(spark, sf), 10).select(
        "id", "action", "source_id", "original_source_name")


@query("win_06_prune_pending", f"""
SELECT id, source_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {M} DESC, id) AS rn FROM t_article
  WHERE {U} AND source_id <> '{HIDDEN}') WHERE rn > 5""")
def prune_pending(spark, sf):
    return X.prune_pending(D.article(spark, sf), 5).select("id", "source_id")


_RANK = "CASE fetch_status WHEN 'cached' THEN 4 WHEN 'partial' THEN 3 WHEN 'pending' THEN 2 WHEN 'fetching' THEN 1 ELSE 0 END"
_DEDUP = f"""row_number() OVER (PARTITION BY source_id, title ORDER BY {_RANK} DESC, added_at, id)"""


@query("win_07_dedup_titles",
       f"SELECT id, source_id, title FROM (SELECT *, {_DEDUP} AS rn FROM t_article) WHERE rn = 1")
def dedup_titles(spark, sf):
    return X.dedup_titles(D.article(spark, sf)).select("id", "source_id", "title")


@query("upd_05_reset_stuck",
       "SELECT id, CASE WHEN fetch_status = 'fetching' THEN 'pending' ELSE fetch_status END AS fetch_status FROM t_article")
def reset_stuck(spark, sf):
    return X.reset_stuck(D.article(spark, sf)).select("id", "fetch_status")


@query("upd_06_reset_missing", f"""
SELECT a.id, CASE WHEN lost THEN 'pending' ELSE fetch_status END AS fetch_status,
  CASE WHEN NOT lost THEN cache_size_bytes END AS cache_size_bytes, {_ts('CASE WHEN NOT lost THEN cached_at END', 'cached_at')}
FROM (SELECT a.*, {R} AND coalesce(c.content_chars, 0) < 50 AS lost FROM t_article a
      LEFT JOIN t_content c ON c.article_id = a.id) a""")
def reset_missing(spark, sf):
    return X.reset_missing(D.article(spark, sf), D.content(spark, sf)).select(
        "id", "fetch_status", big("cache_size_bytes"), ts("cached_at"))


@query("upd_06_drop_lost_pages", f"""
SELECT article_id FROM t_page WHERE article_id NOT IN (
  SELECT a.id FROM t_article a LEFT JOIN t_content c ON c.article_id = a.id WHERE {R} AND coalesce(c.content_chars, 0) < 50)""")
def drop_lost_pages(spark, sf):
    return X.drop_lost_pages(D.cached_page(spark, sf), D.article(spark, sf), D.content(spark, sf)).select("article_id")


@query("upd_07_delete_orphan_saved",
       f"SELECT id, source_id FROM t_article WHERE NOT (source_id = '{HIDDEN}' AND NOT is_saved)")
def delete_orphan_saved(spark, sf):
    return X.delete_orphan_saved(D.article(spark, sf)).select("id", "source_id")


_FIXED = f"""
, s1 AS (SELECT * REPLACE (CASE WHEN fetch_status = 'fetching' THEN 'pending' ELSE fetch_status END AS fetch_status) FROM t_article),
s2 AS (SELECT * FROM (SELECT *, {_DEDUP} AS rn FROM s1) WHERE rn = 1),
s3 AS (SELECT a.*, CASE WHEN {R} AND coalesce(c.content_chars, 0) < 50 THEN 'pending' ELSE fetch_status END AS new_status
       FROM s2 a LEFT JOIN t_content c ON c.article_id = a.id),
s4 AS (SELECT * FROM s3 WHERE NOT (source_id = '{HIDDEN}' AND NOT is_saved)),
s5 AS (SELECT p.* FROM t_page p JOIN s4 ON s4.id = p.article_id WHERE new_status IN ('cached', 'partial'))
"""


@query("upd_15_integrity_job", _FIXED + """
SELECT 'article' AS tbl, id AS key, new_status AS detail FROM s4
UNION ALL SELECT 'cached_page', article_id, cache_level_used FROM s5
UNION ALL SELECT 'asset_pool', asset_key, NULL FROM t_pool
  WHERE asset_key IN (SELECT asset_a FROM s5 UNION ALL SELECT asset_b FROM s5)""")
def integrity_job(spark, sf):
    out = X.integrity_job(
        D.article(spark, sf), D.cached_page(spark, sf), D.content(spark, sf), D.asset_pool(spark, sf))
    return (
        out["article"].select(F.lit("article").alias("tbl"), F.col("id").alias("key"), F.col("fetch_status").alias("detail"))
        .unionByName(out["cached_page"].select(F.lit("cached_page").alias("tbl"), F.col("article_id").alias("key"),
                                               F.col("cache_level_used").alias("detail")))
        .unionByName(out["asset_pool"].select(F.lit("asset_pool").alias("tbl"), F.col("asset_key").alias("key"),
                                              F.lit(None).cast("string").alias("detail")))
    )


def _gone(spark, sf):
    # Sources whose last refresh failed are the ones to delete.
    return D.source(spark, sf).filter("fetch_status = 'failed'")


_GONE = "(SELECT id FROM t_source WHERE fetch_status = 'failed')"


@query("join_13_cascade_delete", f"""
, keep AS (SELECT * FROM t_article WHERE source_id NOT IN {_GONE})
SELECT 'source' AS tbl, id FROM t_source WHERE id NOT IN {_GONE}
UNION ALL SELECT 'article', id FROM keep
UNION ALL SELECT 'cached_page', article_id FROM t_page WHERE article_id IN (SELECT id FROM keep)""")
def cascade_delete(spark, sf):
    return _tables(X.cascade_delete(_gone(spark, sf), *parts(spark, sf)))


def _tables(out):
    return (
        out["source"].select(F.lit("source").alias("tbl"), "id")
        .unionByName(out["article"].select(F.lit("article").alias("tbl"), "id"))
        .unionByName(out["cached_page"].select(F.lit("cached_page").alias("tbl"), F.col("article_id").alias("id")))
    )


@query("upd_08_delete_source", f"""
SELECT a.id, CASE WHEN s.id IS NOT NULL THEN '{HIDDEN}' ELSE a.source_id END AS source_id,
  CASE WHEN s.id IS NOT NULL THEN coalesce(a.original_source_name, s.title) ELSE a.original_source_name END AS original_source_name
FROM t_article a LEFT JOIN t_source s ON s.id = a.source_id AND s.id IN {_GONE}
WHERE s.id IS NULL OR a.is_saved""")
def delete_source(spark, sf):
    return X.delete_source(_gone(spark, sf), *parts(spark, sf))["article"].select(
        "id", "source_id", "original_source_name")


@query("upd_08_stored_delete", f"""
, k AS (
  SELECT a.id, a.article_url, CASE WHEN s.id IS NOT NULL THEN '{HIDDEN}' ELSE a.source_id END AS source_id
  FROM t_article a LEFT JOIN t_source s ON s.id = a.source_id AND s.id IN {_GONE} WHERE s.id IS NULL OR a.is_saved)
SELECT 'article' AS tbl, id, source_id FROM k
UNION ALL SELECT 'address', id, source_id FROM k
UNION ALL SELECT 'cached_page', article_id, NULL FROM t_page WHERE article_id IN (SELECT id FROM k)
UNION ALL SELECT 'source', id, NULL FROM t_source WHERE id NOT IN {_GONE}""")
def stored_delete(spark, sf):
    source, article, page = parts(spark, sf)
    library = LibraryStore(f"{shared_dir(spark)}/feedloom/library-{uuid.uuid4().hex}", 4)
    owned = S.conform(page, S.CACHED_PAGE).join(article.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    library.load(S.conform(source, S.SOURCE), S.conform(article, S.ARTICLE), owned, 0)
    library.delete_sources(_gone(spark, sf), 1)
    now = library.read(spark)
    no = F.lit(None).cast("string").alias("source_id")
    return (
        now["article"].select(F.lit("article").alias("tbl"), "id", "source_id")
        .unionByName(now["address"].select(F.lit("address").alias("tbl"), "id", "source_id"))
        .unionByName(now["cached_page"].select(F.lit("cached_page").alias("tbl"), F.col("article_id").alias("id"), no))
        .unionByName(now["source"].select(F.lit("source").alias("tbl"), "id", no))
    )


@query("upd_18_delete_article", """
, gone AS (SELECT DISTINCT article_id FROM t_action WHERE action = 'fetch_failed')
SELECT 'article' AS tbl, id FROM t_article WHERE id NOT IN (SELECT article_id FROM gone)
UNION ALL SELECT 'cached_page', article_id FROM t_page WHERE article_id NOT IN (SELECT article_id FROM gone)""")
def delete_article(spark, sf):
    ids = D.user_action(spark, sf).filter("action = 'fetch_failed'").select(F.col("article_id").alias("id"))
    out = X.delete_articles(ids, D.article(spark, sf), D.cached_page(spark, sf))
    return out["article"].select(F.lit("article").alias("tbl"), "id").unionByName(
        out["cached_page"].select(F.lit("cached_page").alias("tbl"), F.col("article_id").alias("id")))


# ---- fetch results


def _with_state(spark, sf):
    levels = D.source(spark, sf).select(
        F.col("id").alias("source_id"), F.coalesce("cache_level", F.lit("standard")).alias("cache_level"))
    c = D.content(spark, sf).select(F.col("article_id").alias("id"), (F.col("content_chars") >= 50).alias("has_content"))
    return D.article(spark, sf).join(levels, "source_id").join(c, "id")


_FETCH = f"""
, a AS (
  SELECT a.*, coalesce(s.cache_level, 'standard') AS cache_level, c.content_chars >= 50 AS has_content,
    r.status, r.content_type, r.body_bytes, r.etag AS r_etag, r.text_chars, r.word_count, r.any_failed,
    r.rss_chars, r.rss_word_count, r.total_bytes, r.id IS NOT NULL AS answered,
    coalesce(a.rss_content_html <> '', false) AS has_rss
  FROM t_article a JOIN t_source s ON s.id = a.source_id JOIN t_content c ON c.article_id = a.id
  LEFT JOIN (SELECT * FROM t_response WHERE content_type IS NOT NULL) r ON r.id = a.id),
b AS (SELECT *, status = 200 AND contains(content_type, 'text/html') AND body_bytes > 1000 AS valid FROM a),
o AS (SELECT *, CASE WHEN NOT answered THEN 'network_error'
    WHEN status = 304 THEN CASE WHEN has_content THEN 'not_modified' ELSE 'lost' END
    WHEN NOT valid AND NOT has_rss THEN 'rejected'
    WHEN valid AND text_chars >= 50 AND (word_count >= 50 OR (cache_level = 'full' AND NOT has_rss)) THEN 'page'
    WHEN has_rss AND rss_chars >= 50 THEN 'feed_content' ELSE 'failed' END AS outcome FROM b),
z AS (SELECT *, outcome IN ('page', 'feed_content') AS stored,
    outcome IN ('network_error', 'rejected') AND fetch_status = 'cached' AND has_content AS survives FROM o)
"""


@query("upd_02_apply_fetch", _FETCH + f"""
SELECT id, outcome,
  CASE WHEN stored THEN CASE WHEN any_failed THEN 'partial' ELSE 'cached' END
       WHEN outcome = 'not_modified' OR survives THEN 'cached' ELSE 'failed' END AS fetch_status,
  retry_count + CASE WHEN stored OR outcome = 'not_modified' OR survives THEN 0 ELSE 1 END AS retry_count,
  CASE WHEN outcome = 'lost' THEN NULL WHEN status <> 304 THEN coalesce(r_etag, etag) ELSE etag END AS etag,
  {_ts(f"CASE WHEN stored OR outcome = 'not_modified' THEN {NOW} ELSE cached_at END", 'cached_at')},
  CAST(CASE WHEN stored THEN 200 WHEN NOT valid AND status <> 304 THEN status ELSE last_http_status END AS BIGINT) AS last_http_status,
  CASE WHEN stored THEN greatest(1, (CASE WHEN outcome = 'page' THEN word_count ELSE rss_word_count END + 199) // 200)
       ELSE reading_minutes END AS reading_minutes,
  outcome <> 'page' AND rss_content_html IS NOT NULL AS keeps_feed_content
FROM z""")
def apply_fetch(spark, sf):
    return X.apply_fetch(_with_state(spark, sf), D.response(spark, sf), now()).select(
        "id", "outcome", "fetch_status", big("retry_count"), "etag", ts("cached_at"),
        big("last_http_status"), big("reading_minutes"),
        F.col("rss_content_html").isNotNull().alias("keeps_feed_content"))


@query("upd_04_clear_feed_content", """
SELECT id, CASE WHEN NOT is_read THEN rss_content_html END AS rss_content_html FROM t_article""")
def clear_feed_content(spark, sf):
    return X.clear_feed_content(D.article(spark, sf), ~F.col("is_read")).select("id", "rss_content_html")


@query("upd_03_set_hero_thumbnail", """
SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN regexp_extract(article_url, '^(https://[^/]+)', 1) || '/img/' || id || '.png'
                ELSE thumbnail_url END AS thumbnail_url FROM t_article""")
def set_hero_thumbnail(spark, sf):
    a = D.article(spark, sf)
    heroes = a.select("id", F.col("article_url").alias("page_url"), F.expr(
        "CASE WHEN cast(id AS bigint) % 3 = 0 THEN concat('/img/', id, '.png') END").alias("hero_image_url"))
    return X.set_hero_thumbnail(a, heroes).select("id", "thumbnail_url")


# ---- user changes


@query("upd_09_toggle_save", f"""
, t AS (SELECT article_id, count(*) % 2 = 1 AS flip, max(ts) AS at_ts FROM t_action WHERE action = 'toggle_save' GROUP BY 1),
d AS (SELECT a.*, coalesce(t.flip, false) AS flip, t.at_ts, s.title AS s_title FROM t_article a
      LEFT JOIN t ON t.article_id = a.id LEFT JOIN t_source s ON s.id = a.source_id)
SELECT id, is_saved <> flip AS is_saved,
  {_ts("CASE WHEN flip AND NOT is_saved THEN at_ts WHEN flip THEN NULL ELSE saved_at END", 'saved_at')},
  CASE WHEN flip AND NOT is_saved THEN s_title WHEN flip THEN NULL ELSE original_source_name END AS original_source_name
FROM d WHERE NOT (flip AND is_saved AND source_id = '{HIDDEN}')""")
def toggle_save(spark, sf):
    taps = D.user_action(spark, sf).filter("action = 'toggle_save'").select(
        F.col("article_id").alias("id"), F.col("ts").alias("at"))
    return X.toggle_save(D.article(spark, sf), D.source(spark, sf), taps).select(
        "id", "is_saved", ts("saved_at"), "original_source_name")


@query("upd_10_read_state", """
, m AS (SELECT article_id, max((ts, seq)) AS mark FROM t_action WHERE action = 'read' GROUP BY 1),
n AS (SELECT x.article_id, count(*) AS n FROM t_action x LEFT JOIN m USING (article_id)
      WHERE x.action = 'toggle_read' AND (m.mark IS NULL OR (x.ts, x.seq) > m.mark) GROUP BY 1)
SELECT a.id, ((m.mark IS NOT NULL) OR a.is_read) <> (coalesce(n.n, 0) % 2 = 1) AS is_read
FROM t_article a LEFT JOIN m ON m.article_id = a.id LEFT JOIN n ON n.article_id = a.id""")
def read_state(spark, sf):
    state = X.read_state(D.user_action(spark, sf), ["article_id"]).withColumnRenamed("article_id", "id")
    return X.apply_read_state(D.article(spark, sf), state).select("id", "is_read")


@query("upd_11_save_page", f"""
, req AS (SELECT DISTINCT trim(url) AS url FROM (
    SELECT CASE WHEN doc_id % 2 = 0 THEN d_url ELSE 'https://www.pages.example.org/' || doc_id END AS url FROM t_doc))
SELECT id, title, source_id, is_saved, article_url FROM (
  SELECT a.id, a.title, a.source_id, a.is_saved OR r.url IS NOT NULL AS is_saved, a.article_url
  FROM t_article a LEFT JOIN req r ON r.url = a.article_url
  UNION ALL
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12),
    'www.pages.example.org', '{HIDDEN}', true, url
  FROM (SELECT url, sha256(url) AS h FROM req WHERE url NOT IN (SELECT article_url FROM t_article)))""")
def save_page(spark, sf):
    wanted = D.documents(spark, sf).withColumn("_u", D._url()).select(
        F.expr("CASE WHEN doc_id % 2 = 0 THEN _u ELSE concat('https://www.pages.example.org/', doc_id) END").alias("url"),
        F.lit(None).cast("string").alias("title"))
    return X.save_page(D.article(spark, sf), wanted, now()).select(
        "id", "title", "source_id", "is_saved", "article_url")


@query("upd_12_add_source", f"""
, held AS (SELECT user_id, source_id, row_number() OVER (PARTITION BY user_id ORDER BY source_id) - 1 AS sort_order FROM (
    SELECT DISTINCT user_id, 'k' || CAST(article_id AS BIGINT) % 40 AS source_id FROM t_action)),
n AS (SELECT user_id, count(*) AS n FROM held GROUP BY user_id),
ok AS (SELECT DISTINCT a.user_id FROM t_action a LEFT JOIN n USING (user_id) WHERE coalesce(n.n, 0) < 25)
SELECT held.user_id, source_id AS id, sort_order + CASE WHEN ok.user_id IS NOT NULL THEN 1 ELSE 0 END AS sort_order
FROM held LEFT JOIN ok USING (user_id)
UNION ALL SELECT user_id, 'new-' || user_id, 0 FROM ok""")
def add_source(spark, sf):
    from pyspark.sql import Window
    acts = D.user_action(spark, sf)
    # A user's sources: at most 40 keys each, so ranking within a user is bounded.
    held = acts.select("user_id", F.expr("concat('k', cast(article_id AS bigint) % 40)").alias("id")).distinct()
    held = held.withColumn("sort_order", F.row_number().over(Window.partitionBy("user_id").orderBy("id")) - 1)
    added = acts.select("user_id").distinct().select("user_id", F.expr("concat('new-', user_id)").alias("id"))
    return X.add_source(held, added, "user_id").select("user_id", "id", big("sort_order"))


@query("upd_16_refetch", f"""
SELECT a.id, 0 AS retry_count, coalesce(CASE WHEN a.source_id = '{HIDDEN}' THEN p.cache_level_used ELSE s.cache_level END, 'standard') AS refetch_level
FROM t_article a LEFT JOIN t_page p ON p.article_id = a.id LEFT JOIN t_source s ON s.id = a.source_id""")
def refetch(spark, sf):
    s, a, p = parts(spark, sf)
    return X.refetch(a, s, p).select("id", big("retry_count"), "refetch_level")


@query("upd_17_update_source", """
, ch AS (SELECT 'src' || user_id % 20 AS id, CASE action WHEN 'read' THEN 'title' ELSE 'is_collapsed' END AS field,
    CASE action WHEN 'read' THEN 'Renamed ' || seq ELSE CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END END AS value, ts, seq
  FROM t_action WHERE action IN ('read', 'subscribe')),
l AS (SELECT id, field, arg_max(value, (ts, seq)) AS value FROM ch GROUP BY id, field)
SELECT s.id, coalesce(t.value, s.title) AS title, coalesce(CAST(c.value AS BOOLEAN), s.is_collapsed) AS is_collapsed
FROM t_source s LEFT JOIN l t ON t.id = s.id AND t.field = 'title' LEFT JOIN l c ON c.id = s.id AND c.field = 'is_collapsed'""")
def update_source(spark, sf):
    changes = D.user_action(spark, sf).filter("action IN ('read', 'subscribe')").select(
        F.expr("concat('src', user_id % 20)").alias("id"),
        F.expr("CASE action WHEN 'read' THEN 'title' ELSE 'is_collapsed' END").alias("field"),
        F.expr("CASE action WHEN 'read' THEN concat('Renamed ', seq) ELSE cast(seq % 2 = 0 AS string) END").alias("value"),
        F.col("ts").alias("at"), "seq")
    return X.update_source(D.source(spark, sf), changes).select("id", "title", "is_collapsed")


@query("src_08_upsert", """
, ch AS (SELECT article_id AS id, 'Edited ' || arg_max(seq, (ts, seq)) AS title FROM t_action
         WHERE article_id IS NOT NULL GROUP BY article_id)
SELECT coalesce(ch.id, a.id) AS id, coalesce(ch.title, a.title) AS title FROM t_article a FULL JOIN ch ON ch.id = a.id""")
def upsert(spark, sf):
    current = D.article(spark, sf).select("id", "title")
    changes = D.user_action(spark, sf).filter("article_id IS NOT NULL").select(
        F.col("article_id").alias("id"), F.concat(F.lit("Edited "), F.col("seq").cast("string")).alias("title"), "ts", "seq")
    return X.upsert(current, changes, "id", F.struct("ts", "seq")).select("id", "title")
