"""Queries over the article library: lists, lookups, counts and rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom import schema as S
from feedloom.catalog import derive as D
from feedloom.catalog.registry import big, query, ts
from feedloom.operators import intake, library as L
from feedloom.operators.search_index import SearchIndex, searched
from feedloom.session import shared_dir

HIDDEN = S.SAVED_PAGES_ID
NOW = "TIMESTAMP '2024-03-01 12:30:00'"
R = "fetch_status IN ('cached', 'partial')"
M = "coalesce(published_at, added_at)"


def now():
    return F.expr("timestamp'2024-03-01 12:30:00'")


def _ts(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


@query("flt_04_readable", f"SELECT id, source_id, fetch_status FROM t_article WHERE {R}")
def readable(spark, sf):
    return L.readable(D.article(spark, sf)).select("id", "source_id", "fetch_status")


@query("flt_05_visible_sources",
       f"SELECT id, title, sort_order FROM t_source WHERE id <> '{HIDDEN}' ORDER BY sort_order")
def visible_sources(spark, sf):
    return L.visible_sources(D.source(spark, sf)).select("id", "title", big("sort_order"))


@query("flt_12_stale_sources",
       f"""SELECT id, {_ts('last_fetched_at', 'last_fetched_at')} FROM t_source
           WHERE last_fetched_at IS NULL OR last_fetched_at < {NOW} - INTERVAL 1 HOUR""")
def stale_sources(spark, sf):
    return L.stale_sources(D.source(spark, sf), now()).select("id", ts("last_fetched_at"))


@query("flt_13_article_search",
       "SELECT id, title FROM t_article WHERE fetch_status <> 'failed' AND contains(lower(title), 'the')")
def article_search(spark, sf):
    return L.article_search(D.article(spark, sf), "The").select("id", "title")


@query("flt_14_saved_search",
       """SELECT a.id, a.title, coalesce(nullif(a.original_source_name, ''), s.title) AS attribution
          FROM t_article a LEFT JOIN t_source s ON s.id = a.source_id
          WHERE a.is_saved AND (contains(lower(a.title), 're')
            OR contains(lower(coalesce(nullif(a.original_source_name, ''), s.title)), 're'))""")
def saved_search(spark, sf):
    return L.saved_search(D.article(spark, sf), D.source(spark, sf), "re").select(
        "id", "title", "attribution")


_SEARCHES = ("The", "ation ", "xq", "né", "e th")


def _indexed(spark, rows):
    index = SearchIndex(f"{shared_dir(spark)}/feedloom/search-{uuid.uuid4().hex}", 8)
    index.update(rows, 0)
    out = None
    for q in _SEARCHES:
        part = index.search(spark, q).select(F.lit(q).alias("q"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("flt_13_indexed_search", " UNION ALL ".join(
    f"SELECT '{q}' AS q, id FROM t_article WHERE fetch_status <> 'failed' AND contains(lower(title), '{q.lower()}')" for q in _SEARCHES))
def indexed_search(spark, sf):
    return _indexed(spark, D.article(spark, sf).select("id", F.when(F.col("fetch_status") != "failed", searched(F.col("title"))).alias("text")))


@query("flt_14_indexed_saved_search", " UNION ALL ".join(
    f"""SELECT '{q}' AS q, a.id FROM t_article a LEFT JOIN t_source s ON s.id = a.source_id WHERE a.is_saved AND (contains(lower(a.title), '{q.lower()}')
        OR contains(lower(coalesce(nullif(a.original_source_name, ''), s.title)), '{q.lower()}'))""" for q in _SEARCHES))
def indexed_saved_search(spark, sf):
    named = L.attach_names(D.article(spark, sf), D.source(spark, sf))
    name = F.coalesce(F.nullif("original_source_name", F.lit("")), "source_title")
    return _indexed(spark, named.select("id", F.when(F.col("is_saved"), searched(F.col("title"), name)).alias("text")))


@query("flt_18_due_sources",
       f"""SELECT 'automatic' AS mode, 'resume' AS run, id FROM t_source WHERE id <> '{HIDDEN}'
             AND (last_fetched_at IS NULL OR last_fetched_at < {NOW} - INTERVAL 1 HOUR)
           UNION ALL SELECT 'automatic', 'background', id FROM t_source WHERE id <> '{HIDDEN}'
           UNION ALL SELECT 'on_open', 'launch', id FROM t_source WHERE id <> '{HIDDEN}'""")
def due_sources(spark, sf):
    runs = [("automatic", "resume"), ("automatic", "background"), ("on_open", "launch"), ("manual", "launch")]
    out = None
    for mode, run in runs:
        part = L.due_sources(D.source(spark, sf), mode, run, now()).select(
            F.lit(mode).alias("mode"), F.lit(run).alias("run"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("flt_20_sources_by_id",
       f"""SELECT 'some' AS choice, id FROM t_source WHERE id IN ('src1', 'src3')
           UNION ALL SELECT 'all', id FROM t_source WHERE id <> '{HIDDEN}'""")
def sources_by_id(spark, sf):
    s = D.source(spark, sf)
    some = L.sources_by_id(s, ["src1", "src3"]).select(F.lit("some").alias("choice"), "id")
    return some.unionByName(L.sources_by_id(s, ["all"]).select(F.lit("all").alias("choice"), "id"))


@query("fn_29_effective_settings",
       f"""SELECT id, coalesce(cache_level, 'standard') AS cache_level, coalesce(layout, 'list') AS layout,
             'list' AS home_layout, 'system' AS appearance_mode, contains(feed_url, 'news.google.com') AS is_topic_feed
           FROM t_source""")
def effective_settings(spark, sf):
    return L.effective_settings(D.source(spark, sf)).select(
        "id", "cache_level", "layout", "home_layout", "appearance_mode", "is_topic_feed")


@query("src_11_library_paths",
       "SELECT id, '/store/articles/' || id || '/index.html' AS html_path FROM t_article")
def library_paths(spark, sf):
    return D.article(spark, sf).select("id", L.library_path(F.col("id"), "/store").alias("html_path"))


# ---- joins


@query("join_04_articles_with_source",
       f"""SELECT a.id, s.title AS source_name, {_ts('coalesce(a.published_at, a.added_at)', 'moment')}
           FROM t_article a JOIN t_source s ON s.id = a.source_id
           WHERE {R.replace('fetch_status', 'a.fetch_status')} AND a.thumbnail_url IS NOT NULL AND a.source_id <> '{HIDDEN}'
           ORDER BY coalesce(a.published_at, a.added_at) DESC, a.id LIMIT 10""")
def articles_with_source(spark, sf):
    return L.articles_with_source(D.article(spark, sf), D.source(spark, sf), 10).select(
        "id", "source_name", ts(S.newest(), "moment"))


@query("join_05_articles_with_source_and_page",
       f"""SELECT a.id, s.title AS source_name, p.cache_level_used
           FROM t_article a JOIN t_source s ON s.id = a.source_id LEFT JOIN t_page p ON p.article_id = a.id
           WHERE a.{R} AND a.source_id <> '{HIDDEN}'
           ORDER BY coalesce(a.published_at, a.added_at) DESC, a.id LIMIT 5""")
def articles_with_source_and_page(spark, sf):
    return L.articles_with_source_and_page(
        D.article(spark, sf), D.source(spark, sf), D.cached_page(spark, sf)
    ).select("id", "source_name", "cache_level_used")


@query("join_06_storage_by_source",
       """SELECT s.id AS source_id, s.title, CAST(sum(p.total_size_bytes) AS BIGINT) AS bytes
          FROM t_page p JOIN t_article a ON a.id = p.article_id JOIN t_source s ON s.id = a.source_id
          GROUP BY s.id, s.title HAVING sum(p.total_size_bytes) > 0
          UNION ALL SELECT NULL, 'total', CAST(sum(p.total_size_bytes) AS BIGINT) FROM t_page p
            JOIN t_article a ON a.id = p.article_id""")
def storage_by_source(spark, sf):
    return L.storage_by_source(
        D.cached_page(spark, sf), D.article(spark, sf), D.source(spark, sf)
    ).select("source_id", "title", big("bytes"))


@query("join_07_attach_names",
       """SELECT a.id, s.title AS source_title, coalesce(s.cache_level, 'standard') AS cache_level
          FROM t_article a LEFT JOIN t_source s ON s.id = a.source_id""")
def attach_names(spark, sf):
    return L.attach_names(D.article(spark, sf), D.source(spark, sf)).select(
        "id", "source_title", "cache_level")


@query("join_11_orphan_assets",
       """SELECT asset_key FROM t_pool WHERE asset_key NOT IN
            (SELECT asset_a FROM t_page UNION SELECT asset_b FROM t_page)""")
def orphan_assets(spark, sf):
    return L.orphan_assets(D.asset_pool(spark, sf), D.cached_page(spark, sf))


@query("join_12_missing_content",
       f"""SELECT a.id, a.fetch_status FROM t_article a LEFT JOIN t_content c ON c.article_id = a.id
           WHERE a.{R} AND coalesce(c.content_chars, 0) < 50""")
def missing_content(spark, sf):
    return L.missing_content(D.article(spark, sf), D.content(spark, sf)).select("id", "fetch_status")


@query("join_18_missing_icons",
       """SELECT s.id, s.icon_url FROM t_source s WHERE s.icon_url IS NOT NULL AND s.id NOT IN
            (SELECT source_id FROM t_article WHERE is_saved AND thumbnail_url IS NULL)""")
def missing_icons(spark, sf):
    # Icons count as stored for sources that own a saved article without a picture.
    icon = D.article(spark, sf).filter("is_saved AND thumbnail_url IS NULL").select("source_id")
    return L.missing_icons(D.source(spark, sf), icon).select("id", "icon_url")


# ---- aggregates


@query("agg_01_source_summary",
       f"""SELECT source_id, least(count(*), 25) AS article_count,
             least(count(*) FILTER (WHERE NOT is_read), 25) AS unread_count,
             CAST(coalesce(sum(reading_minutes), 0) AS BIGINT) AS reading_minutes_total
           FROM t_article WHERE {R} GROUP BY source_id""")
def source_summary(spark, sf):
    return L.source_summary(D.article(spark, sf)).select(
        "source_id", big("article_count"), big("unread_count"), big("reading_minutes_total"))


@query("agg_02_library_totals",
       f"""SELECT count(*) FILTER (WHERE {R} AND source_id <> '{HIDDEN}') AS readable_count,
             coalesce(bool_or(is_saved), false) AS has_saved FROM t_article""")
def library_totals(spark, sf):
    return L.library_totals(D.article(spark, sf)).select(big("readable_count"), "has_saved")


@query("agg_03_saved_summary",
       f"""SELECT id, title, {_ts('coalesce(saved_at, added_at)', 'saved_moment')},
             (SELECT count(*) FROM t_article WHERE is_saved) AS saved_total
           FROM t_article WHERE is_saved ORDER BY coalesce(saved_at, added_at) DESC, id LIMIT 5""")
def saved_summary(spark, sf):
    return L.saved_summary(D.article(spark, sf)).select(
        "id", "title", ts("saved_moment"), big("saved_total"))


@query("agg_09_refresh_outcome",
       f"""SELECT coalesce(cache_level, 'standard') AS run_id, count(*) AS sources,
             count(*) FILTER (WHERE fetch_status = 'failed') AS failed,
             count(*) FILTER (WHERE fetch_status = 'failed') = count(*) AS offline
           FROM t_source WHERE id <> '{HIDDEN}' GROUP BY 1""")
def refresh_outcome(spark, sf):
    runs = D.source(spark, sf).filter(F.col("id") != HIDDEN).select(
        F.coalesce("cache_level", F.lit("standard")).alias("run_id"),
        F.col("fetch_status").alias("status"))
    return L.refresh_outcome(runs).select("run_id", big("sources"), big("failed"), "offline")


# ---- windows and rankings


@query("win_02_priority_split",
       f"""SELECT id, source_id, rn AS queue_rank, CASE WHEN rn <= 5 THEN 'priority' ELSE 'backfill' END AS phase
           FROM (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY {M} DESC, id) AS rn
                 FROM t_article WHERE fetch_status = 'pending')""")
def priority_split(spark, sf):
    pending = D.article(spark, sf).filter("fetch_status = 'pending'")
    return intake.priority_split(pending).select("id", "source_id", big("queue_rank"), "phase")


@query("win_03_round_robin",
       f"""SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY {M} DESC, id) AS turn,
             {_ts(f'max({M}) OVER (PARTITION BY source_id)', 'source_newest')}
           FROM t_article WHERE fetch_status = 'pending'""")
def round_robin(spark, sf):
    pending = D.article(spark, sf).filter("fetch_status = 'pending'").select(
        "id", "source_id", "published_at", "added_at")
    return intake.round_robin(pending).select("id", "source_id", big("turn"), ts("source_newest"))


@query("win_04_balanced_latest",
       f"""SELECT id, source_id, turn, {_ts('newest', 'source_newest')} FROM (
             SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY {M} DESC, id) AS turn,
               max({M}) OVER (PARTITION BY source_id) AS newest
             FROM t_article WHERE {R} AND source_id <> '{HIDDEN}' AND thumbnail_url IS NOT NULL)
           ORDER BY turn, newest DESC, source_id LIMIT 30""")
def balanced_latest(spark, sf):
    return L.balanced_latest(D.article(spark, sf)).select(
        "id", "source_id", big("turn"), ts("source_newest"))


@query("win_08_top_per_source",
       f"""SELECT id, source_id, rn FROM (
             SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY {M} DESC, id) AS rn
             FROM t_article WHERE {R}) WHERE rn <= 5""")
def top_per_source(spark, sf):
    return L.top_per_source(D.article(spark, sf)).select("id", "source_id", big("rn"))


@query("win_17_carousel_slots",
       f"""WITH shown AS (
             SELECT id, row_number() OVER (ORDER BY {M} DESC, id) AS rn, count(*) OVER () AS n FROM (
               SELECT * FROM t_article WHERE {R} AND source_id <> '{HIDDEN}' AND thumbnail_url IS NOT NULL
               ORDER BY {M} DESC, id LIMIT 5))
           SELECT id, slot, ((rn - 1 - slot) % n + n) % n AS slot_position,
             {_ts(NOW + ' + to_seconds(CAST(slot * 10 AS INTEGER))', 'slot_at')}
           FROM shown, range(0, 180) r(slot)""".replace("WITH shown AS", ", shown AS", 1))
def carousel_slots(spark, sf):
    shown = L.articles_with_source(D.article(spark, sf), D.source(spark, sf), L.DISPLAY_ROWS["small"])
    return L.carousel_slots(L.ranked_list(shown), now()).select("id", big("slot"), big("slot_position"), ts("slot_at"))


@query("win_18_renumber_sources",
       f"""SELECT id, coalesce(cache_level, 'standard') AS owner,
             row_number() OVER (PARTITION BY coalesce(cache_level, 'standard') ORDER BY title DESC, id) - 1 AS sort_order
           FROM t_source WHERE id <> '{HIDDEN}'""")
def renumber_sources(spark, sf):
    s = D.source(spark, sf).filter(F.col("id") != HIDDEN).withColumn(
        "owner", F.coalesce("cache_level", F.lit("standard")))
    return L.renumber_sources(s, "owner", [F.col("title").desc(), F.col("id")]).select(
        "id", "owner", big("sort_order"))


@query("win_18_insert_at_top",
       f"""SELECT id, CASE WHEN id = '{HIDDEN}' THEN sort_order ELSE sort_order + 1 END AS sort_order FROM t_source
           UNION ALL SELECT 'added-' || max(source), 0 FROM documents""")
def insert_at_top(spark, sf):
    added = D.documents(spark, sf).agg(F.concat(F.lit("added-"), F.max("source")).alias("id"))
    return L.insert_at_top(D.source(spark, sf), added).select("id", big("sort_order"))


# ---- sorted lists


@query("sort_01_newest_first",
       f"SELECT id, {_ts(M, 'moment')} FROM t_article ORDER BY {M} DESC, id")
def newest_first(spark, sf):
    return D.article(spark, sf).orderBy(*L.newest_first()).select("id", ts(S.newest(), "moment"))


@query("sort_02_saved_order",
       f"SELECT id, {_ts('saved_at', 'saved_at')} FROM t_article WHERE is_saved ORDER BY saved_at DESC, added_at DESC")
def saved_order(spark, sf):
    return L.saved_order(D.article(spark, sf)).select("id", ts("saved_at"))


@query("sort_02_saved_order_coalesced",
       f"SELECT id, {_ts('coalesce(saved_at, added_at)', 'moment')} FROM t_article WHERE is_saved")
def saved_order_coalesced(spark, sf):
    return L.saved_order(D.article(spark, sf), coalesced=True).select(
        "id", ts(F.coalesce("saved_at", "added_at"), "moment"))


@query("sort_03_saved_carousel",
       """SELECT id, title FROM t_article WHERE is_saved AND fetch_status <> 'failed' AND thumbnail_url IS NOT NULL
          ORDER BY saved_at DESC, added_at DESC, id LIMIT 10""")
def saved_carousel(spark, sf):
    return L.saved_carousel(D.article(spark, sf)).select("id", "title")


@query("sort_04_offset", f"SELECT id, source_id FROM t_article ORDER BY {M} DESC, id OFFSET 25")
def after_first(spark, sf):
    return L.after_first(D.article(spark, sf), 25).select("id", "source_id")


@query("sort_07_drawer_list",
       f"""SELECT 'saved' AS context, id FROM t_article WHERE is_saved AND {R}
           UNION ALL SELECT source_id, id FROM t_article WHERE source_id = 'src2' AND {R}""")
def drawer_list(spark, sf):
    a = D.article(spark, sf)
    saved = L.drawer_list(a, None).select(F.lit("saved").alias("context"), "id")
    return saved.unionByName(L.drawer_list(a, "src2").select(F.col("source_id").alias("context"), "id"))


_SIZES = " UNION ALL ".join(
    f"""(SELECT '{size}' AS size, a.id FROM t_article a JOIN t_source s ON s.id = a.source_id
         WHERE a.{R} AND a.source_id <> '{HIDDEN}'
         {'' if size in ('rectangular', 'circular', 'inline', 'corner') else 'AND a.thumbnail_url IS NOT NULL'}
         ORDER BY coalesce(a.published_at, a.added_at) DESC, a.id LIMIT {k})"""
    for size, k in L.DISPLAY_ROWS.items()
)


@query("sort_08_display_sizes", f"SELECT * FROM ({_SIZES})")
def display_sizes(spark, sf):
    out = None
    for size in L.DISPLAY_ROWS:
        part = L.display_list(D.article(spark, sf), D.source(spark, sf), size).select(
            F.lit(size).alias("size"), "id")
        out = part if out is None else out.unionByName(part)
    return out
