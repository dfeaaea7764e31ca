"""Queries over feed documents, outlines and table inputs and outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.catalog import derive as D
from feedloom.catalog.registry import big, query, ts
from feedloom.functions import text as T
from feedloom.session import shared_dir
from feedloom.sources import feeds, opml, tables

_CLEAN = r"replace(regexp_replace({c}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), ']]>', '')"
_TRIM = r"regexp_replace({c}, '^[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"
_BODY = _TRIM.format(c=_CLEAN.format(c="text"))
_RAW_TITLE = _TRIM.format(c=_CLEAN.format(c="d_title"))
_ITEMS = f"""
, x AS (
  SELECT doc_id, source, doc_id // 320 AS chunk, 'https://' || source || '.example.com/feed/' || doc_id // 320 || '.xml' AS feed_url,
    row_number() OVER (PARTITION BY source, doc_id // 320 ORDER BY doc_id) - 1 AS pos,
    {_RAW_TITLE} AS raw_title, d_url AS url, d_published AS published_at,
    CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://' || source || '.example.com/img/' || doc_id || '.jpg'
      ELSE 'https://img.example.com/' || doc_id || '.png' END AS thumbnail_url,
    {_BODY} AS body FROM t_doc)
"""


@query("src_01_read_feeds", _ITEMS + """
SELECT feed_url, pos, url, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, thumbnail_url,
  CASE WHEN length(body) > 100 THEN length(body) END AS content_chars FROM x""")
def read_feeds(spark, sf):
    _, items = feeds.read_feeds(D.feed_xml(spark, sf))
    return items.select("feed_url", big("pos"), "url", ts("published_at"), "thumbnail_url",
                        big(F.length("content_html"), "content_chars"))


@query("src_01_read_atom", _ITEMS + """
SELECT replace(feed_url, '/feed/', '/atom/') AS feed_url, pos, url,
  strftime(coalesce(published_at, TIMESTAMP '2024-02-01') + CASE WHEN doc_id % 4 IN (0, 2) THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END,
    '%Y-%m-%d %H:%M:%S') AS published_at,
  CASE WHEN length(body) > 100 THEN length(body) END AS content_chars FROM x""")
def read_atom(spark, sf):
    _, items = feeds.read_feeds(D.atom_xml(spark, sf))
    return items.select("feed_url", big("pos"), "url", ts("published_at"), big(F.length("content_html"), "content_chars"))


@query("flt_09_malformed_lines", f"""
, y AS (
  SELECT doc_id, 'https://' || source || '.example.com/atom/' || doc_id // 320 || '.xml' AS feed_url,
    sum(1 + length({_CLEAN.format(c='text')}) - length(replace({_CLEAN.format(c='text')}, chr(10), '')))
      OVER (PARTITION BY source, doc_id // 320 ORDER BY doc_id) AS breaks
  FROM t_doc)
SELECT feed_url, CASE WHEN count(*) FILTER (WHERE doc_id % 50 = 49) > 0
  THEN 'line ' || CAST(1 + min(breaks) FILTER (WHERE doc_id % 50 = 49) AS BIGINT) || ': mismatched tag' END AS detail
FROM y GROUP BY feed_url""")
def malformed_lines(spark, sf):
    parsed = feeds.parse_feeds(D.atom_xml(spark, sf, broken=True))
    return parsed.select("feed_url", F.when(~feeds.well_formed(), feeds.malformed_detail()).alias("detail"))


@query("src_01_feed_headers", """
SELECT DISTINCT 'https://' || source || '.example.com/feed/' || doc_id // 320 || '.xml' AS feed_url,
  'Feed ' || source || ' & more' AS title, 'https://www.' || source || '.example.com/' AS site_url FROM documents""")
def feed_headers(spark, sf):
    headers, _ = feeds.read_feeds(D.feed_xml(spark, sf))
    return headers.select("feed_url", "title", "site_url")


@query("src_02_feed_item_finalize", """
SELECT pos, CASE WHEN is_login THEN 'https://accounts.' || source_id || '.example.com/login?n=' || pos ELSE url END AS url,
  CASE WHEN pos % 2 = 0 THEN CASE WHEN is_login THEN 'https://accounts.' || source_id || '.example.com/login?n=' || pos ELSE url END
       ELSE 'T' || pos END AS title,
  CASE WHEN length(content_html) > 100 THEN content_html END AS content_html
FROM t_item""")
def feed_item_finalize(spark, sf):
    raw = D.feed_item(spark, sf).select(
        "feed_url", "pos", F.regexp_replace("url", "^https:", "http:").alias("raw_url"),
        F.expr("CASE WHEN pos % 2 = 0 THEN '' ELSE concat('T', pos) END").alias("raw_title"),
        F.lit("").alias("raw_date"), F.lit("").alias("raw_thumbnail"), F.lit("").alias("raw_source"),
        F.col("content_html").alias("raw_content"))
    return feeds.finalize_items(raw).select("pos", "url", "title", "content_html")


@query("src_03_feed_check_items", _ITEMS + """
SELECT feed_url, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS newest_item_date,
  string_agg(url, ' ' ORDER BY pos) AS article_urls FROM x WHERE pos < 10 GROUP BY feed_url""")
def feed_check_items(spark, sf):
    parsed = feeds.parse_feeds(D.feed_xml(spark, sf))
    return feeds.read_feed_check_items(parsed).select(
        "feed_url", ts("newest_item_date"), F.array_join("article_urls", " ").alias("article_urls"))


@query("agg_05_newest_item", _ITEMS + """
SELECT feed_url, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS newest_item_date FROM x GROUP BY feed_url""")
def newest_item(spark, sf):
    _, items = feeds.read_feeds(D.feed_xml(spark, sf))
    return feeds.newest_item(items).select("feed_url", ts("newest_item_date"))


@query("ext_37_site_url", """
SELECT DISTINCT 'https://' || source || '.example.com/feed/' || doc_id // 320 || '.xml' AS feed_url,
  'http://www.' || source || '.example.com/' AS site_url FROM documents""")
def site_url(spark, sf):
    return feeds.site_url(feeds.parse_feeds(D.feed_xml(spark, sf)))


@query("src_04_read_opml", """
, o AS (SELECT *, pos // 64 AS n, max(CASE WHEN pos % 8 = 0 THEN pos END) OVER (PARTITION BY pos // 64 ORDER BY pos) AS g FROM t_dir)
SELECT 'topic-' || n AS file, feed_url, 'd' AS description,
  CASE WHEN g IS NULL THEN 'All' ELSE 'Group ' || g END AS category, CAST(NULL AS VARCHAR) AS country FROM o
UNION ALL SELECT 'country-' || n, feed_url, 'd', 'Land ' || n, 'Land ' || n FROM o""")
def read_opml(spark, sf):
    return opml.read_opml(D.opml_xml(spark, sf)).select("file", "feed_url", "description", "category", "country")


@query("src_05_fix_bare_ampersands", r"""
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'),
  '&amp;amp;', '&amp;'), '&amp;lt;', '&lt;'), '&amp;gt;', '&gt;'), '&amp;quot;', '&quot;'), '&amp;apos;', '&apos;'), '&amp;#', '&#') AS html
FROM pages""")
def fix_bare_ampersands(spark, sf):
    return D.pages(spark, sf).select("page_id", T.fix_bare_ampersands(F.col("html")).alias("html"))


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/feedloom/{name}-{uuid.uuid4().hex}"


@query("src_06_read_directory", """
SELECT id, name, feed_url, site_url, category, country, tag1 || ' ' || tag2 AS tags,
  strftime(last_verified, '%Y-%m-%d') AS last_verified FROM t_dir""")
def read_directory(spark, sf):
    path = _fresh(spark, "directory")
    tables.write_directory(D.directory_feed(spark, sf), path)
    return tables.read_directory(spark, f"{path}/*", arrays=False).select(
        "id", "name", "feed_url", "site_url", "category", "country", F.array_join("tags", " ").alias("tags"),
        F.date_format("last_verified", "yyyy-MM-dd").alias("last_verified"))


@query("src_09_write_directory", "SELECT lower(category) AS slug, count(*) AS feeds FROM t_dir GROUP BY 1")
def write_directory(spark, sf):
    path = _fresh(spark, "directory")
    tables.write_directory(D.directory_feed(spark, sf), path)
    written = spark.read.json(path)
    return written.groupBy("slug").agg(F.count("*").alias("feeds"))


@query("src_10_publish_directory", """
SELECT id, name, regexp_replace(feed_url, '^http://', 'https://') AS "feedURL",
  regexp_replace(site_url, '^http://', 'https://') AS "siteURL" FROM t_dir""")
def publish_directory(spark, sf):
    path = _fresh(spark, "published")
    tables.publish_directory(D.directory_feed(spark, sf), path)
    return spark.read.json(path).select("id", "name", "feedURL", "siteURL")


def fetch_log(spark, sf):
    """Crawl results of all pages: missing pages, unchanged ones, other types, short bodies."""
    return D.pages(spark, sf).select(
        F.col("page_url").alias("url"), F.col("page_url").alias("final_url"),
        F.expr("cast(CASE page_id % 11 WHEN 3 THEN 404 WHEN 5 THEN 304 ELSE 200 END AS int)").alias("status"),
        F.expr("CASE WHEN page_id % 13 = 2 THEN 'application/json' ELSE 'Text/HTML; charset=utf-8' END").alias("content_type"),
        F.col("html").alias("body"), F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit(1).alias("attempt"),
        F.expr("timestamp'2024-03-01' + make_dt_interval(0, 0, cast(page_id % 1440 AS int))").alias("fetched_at"))


@query("src_07_read_pages", """
SELECT url, CASE page_id % 11 WHEN 3 THEN 404 WHEN 5 THEN 304 ELSE 200 END AS status, strlen(html) AS body_bytes FROM pages""")
def read_pages(spark, sf):
    path = _fresh(spark, "fetch_log")
    fetch_log(spark, sf).write.parquet(path)
    return tables.read_fetch_log(spark, path).select("url", big("status"), big(F.octet_length("body"), "body_bytes"))


@query("flt_06_valid_page", """
SELECT url FROM pages WHERE page_id % 11 NOT IN (3, 5) AND page_id % 13 <> 2 AND strlen(html) > 1000""")
def valid_page(spark, sf):
    return tables.valid_page(fetch_log(spark, sf)).select("url")


@query("src_08_write_library", "SELECT source_id, count(*) AS articles, count(DISTINCT id) AS ids FROM t_article GROUP BY 1")
def write_library(spark, sf):
    path = _fresh(spark, "article")
    tables.write_library(D.article(spark, sf).drop("rss_content_html"), path)
    back = spark.read.parquet(path)
    return back.groupBy("source_id").agg(F.count("*").alias("articles"), F.countDistinct("id").alias("ids"))
