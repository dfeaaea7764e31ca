"""Queries over the intake path: windows, matching, fetch plan and queues."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom import schema as S
from feedloom.catalog import derive as D
from feedloom.catalog.registry import big, query, ts
from feedloom.functions import urls
from feedloom.operators import intake as I
from feedloom.operators.library_store import LibraryIndex
from feedloom.session import shared_dir

HIDDEN = S.SAVED_PAGES_ID
M = "coalesce(published_at, added_at)"
NON_ARTICLE = r"""(regexp_matches(regexp_extract(lower({u}), '^[^:/?#]+://([^/?#]*)', 1), '^(accounts|account|auth|login|signin|sso)\.')
  OR regexp_matches(regexp_extract(lower({u}), '^[^:/?#]+://[^/?#]*([^?#]*)', 1),
     '^/(login|signin|sign-in|signup|sign-up|register|auth|oauth|sso|password|forgot-password|reset-password|logout|signout|sign-out|subscribe|subscription|checkout|payment|unsubscribe|preferences/notifications)(/|$)')
  OR regexp_matches(regexp_extract(lower({u}), '\?([^#]*)', 1), '(post_login_redirect|redirect_uri|return_to|login_challenge)='))"""

# The intake window in SQL: newest first, first of URL and of title, capped per cache level.
WINDOW = f"""
, w_rank AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY published_at DESC NULLS LAST, pos) AS ru,
    row_number() OVER (PARTITION BY source_id, title ORDER BY published_at DESC NULLS LAST, pos) AS rt
  FROM t_item),
w_cap AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC NULLS LAST, pos) AS window_rank
  FROM w_rank WHERE ru = 1 AND rt = 1),
w_window AS (
  SELECT w.*, coalesce(s.cache_level, 'standard') AS cache_level FROM w_cap w JOIN t_source s ON s.id = w.source_id
  WHERE window_rank <= CASE WHEN s.cache_level = 'full' THEN 10 ELSE 25 END),
w_title AS (
  SELECT source_id, title, arg_min(id, (added_at, id)) AS title_id FROM t_article GROUP BY source_id, title),
w_match AS (
  SELECT w.*, coalesce(u.id, t.title_id) AS existing_id,
    CASE WHEN u.id IS NOT NULL THEN 'url' WHEN t.title_id IS NOT NULL THEN 'title' END AS matched_by
  FROM w_window w
  LEFT JOIN t_article u ON u.source_id = w.source_id AND u.article_url = w.url
  LEFT JOIN w_title t ON t.source_id = w.source_id AND t.title = w.title)
"""


def window(spark, sf):
    return I.feed_window(D.feed_item(spark, sf), D.source(spark, sf))


@query("win_01_feed_window",
       WINDOW + "SELECT source_id, pos, url, title, window_rank FROM w_window")
def feed_window(spark, sf):
    return window(spark, sf).select("source_id", "pos", "url", "title", big("window_rank"))


@query("join_01_match_existing",
       WINDOW + "SELECT source_id, pos, existing_id, matched_by FROM w_match")
def match_existing(spark, sf):
    return I.match_existing(window(spark, sf), D.article(spark, sf)).select(
        "source_id", "pos", "existing_id", "matched_by")


@query("join_01_bucketed_match",
       WINDOW + "SELECT source_id, pos, existing_id, matched_by FROM w_match")
def bucketed_match(spark, sf):
    index = LibraryIndex(spark, f"{shared_dir(spark)}/feedloom/index-{uuid.uuid4().hex}", 16).build(D.article(spark, sf))
    return index.match(window(spark, sf)).select("source_id", "pos", "existing_id", "matched_by")


@query("join_02_reattach_saved",
       WINDOW + f"""SELECT a.id, min(w.source_id) AS source_id FROM t_article a JOIN w_window w ON w.url = a.article_url
          WHERE a.source_id = '{HIDDEN}' AND a.is_saved GROUP BY a.id""")
def reattach_saved(spark, sf):
    return I.reattach_saved(window(spark, sf), D.article(spark, sf)).select("id", "source_id")


@query("join_03_new_items",
       f""", f AS (SELECT * FROM t_item WHERE NOT {NON_ARTICLE.format(u='url')}),
       k AS (SELECT *, row_number() OVER (PARTITION BY source_id, title ORDER BY published_at DESC NULLS LAST, pos) AS rt FROM f),
       n AS (SELECT * FROM k WHERE rt = 1 AND url NOT IN (SELECT article_url FROM t_article)
             AND NOT EXISTS (SELECT 1 FROM t_article a WHERE a.source_id = k.source_id AND a.title = k.title)),
       o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_id, published_at DESC NULLS LAST, pos) AS ru FROM n)
       SELECT source_id, pos, url, title FROM o WHERE ru = 1""")
def new_items(spark, sf):
    return I.new_items(D.feed_item(spark, sf), D.article(spark, sf)).select(
        "source_id", "pos", "url", "title")


@query("flt_03_resolve_redirects",
       """SELECT i.source_id, i.pos, CASE WHEN i.is_agg THEN r.to_url ELSE i.url END AS resolved_url
          FROM t_item i LEFT JOIN t_redirect r ON r.from_url = i.url
          WHERE NOT i.is_agg OR (r.to_url IS NOT NULL AND r.to_url NOT IN (SELECT article_url FROM t_article))""")
def resolve_redirects(spark, sf):
    return I.resolve_redirects(
        D.feed_item(spark, sf), D.redirect(spark, sf), D.article(spark, sf)
    ).select("source_id", "pos", "resolved_url")


@query("upd_01_plan_fetch", WINDOW + f"""
, p AS (
  SELECT m.*, r.to_url, o.source_id AS owner_id, o.is_saved AS owner_saved, a.fetch_status, a.retry_count,
    c.content_chars, g.cache_level_used
  FROM w_match m
  LEFT JOIN t_redirect r ON r.from_url = m.url
  LEFT JOIN t_article o ON o.article_url = coalesce(r.to_url, m.url)
  LEFT JOIN t_article a ON a.id = m.existing_id
  LEFT JOIN t_content c ON c.article_id = m.existing_id
  LEFT JOIN t_page g ON g.article_id = m.existing_id)
SELECT source_id, pos, existing_id, CASE
  WHEN is_login THEN CASE WHEN existing_id IS NOT NULL THEN 'delete' ELSE 'ignore' END
  WHEN existing_id IS NOT NULL THEN CASE
    WHEN fetch_status IN ('pending', 'failed') THEN CASE WHEN retry_count < 2 THEN 'queue' ELSE 'give_up' END
    WHEN fetch_status = 'fetching' THEN CASE WHEN retry_count < 2 THEN 'reset' ELSE 'give_up' END
    WHEN coalesce(content_chars, 0) < 50 THEN 'requeue_missing'
    WHEN cache_level_used <> cache_level THEN 'requeue_level' ELSE 'keep' END
  WHEN NOT is_agg AND owner_id = '{HIDDEN}' AND owner_saved THEN 'reattach'
  WHEN is_agg AND to_url IS NULL THEN 'unresolved'
  WHEN owner_id IS NOT NULL THEN 'duplicate' ELSE 'insert' END AS action
FROM p""")
def plan_fetch(spark, sf):
    return I.plan_fetch(
        window(spark, sf), D.article(spark, sf), D.cached_page(spark, sf),
        D.content(spark, sf), D.redirect(spark, sf),
    ).select("source_id", "pos", "existing_id", "action")


@query("win_09_retry_queue", f"""
, q AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {M} DESC, id) AS rn FROM t_article
        WHERE fetch_status IN ('pending', 'fetching', 'failed') AND retry_count < 2)
SELECT q.id, q.source_id, q.rn, CAST(NULL AS VARCHAR) AS etag, 'cache' AS action FROM q JOIN t_source s ON s.id = q.source_id
WHERE rn <= CASE WHEN s.cache_level = 'full' THEN 10 ELSE 25 END""")
def retry_queue(spark, sf):
    return I.retry_queue(D.article(spark, sf), D.source(spark, sf)).select(
        "id", "source_id", big("rn"), "etag", "action")


@query("win_10_backfill_queue", f"""
, q AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {M} DESC, id) AS rn FROM t_article
        WHERE fetch_status IN ('pending', 'fetching') AND retry_count < 2)
SELECT q.id, q.source_id, q.rn FROM q JOIN t_source s ON s.id = q.source_id
WHERE rn <= least(CASE WHEN s.cache_level = 'full' THEN 10 ELSE 25 END, 15)""")
def backfill_queue(spark, sf):
    return I.backfill_queue(D.article(spark, sf), D.source(spark, sf), 15).select(
        "id", "source_id", big("rn"))


@query("flt_01_is_non_article_url",
       f"SELECT pos, {NON_ARTICLE.format(u='url')} AS non_article FROM t_item")
def is_non_article_url(spark, sf):
    return D.feed_item(spark, sf).select("pos", urls.is_non_article_url(F.col("url")).alias("non_article"))


@query("flt_02_is_aggregator_url",
       """SELECT pos, regexp_extract(lower(url), '^https?://([^/?#]*)', 1) = 'news.google.com'
            AND regexp_matches(url, '^https?://[^/?#]*[^?#]*(articles|read)') AS aggregator FROM t_item""")
def is_aggregator_url(spark, sf):
    return D.feed_item(spark, sf).select("pos", urls.is_aggregator_url(F.col("url")).alias("aggregator"))
