"""Queries over the images and stylesheets of stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog import derive as D
from feedloom.catalog.pages import expected, illustrated, marks
from feedloom.catalog.registry import big, query
from feedloom.functions import media
from feedloom.operators import assets as A
from feedloom.operators.dom import attr
from feedloom.plans.extract_job import _page
from feedloom.session import materialize
from feedloom.sources.html import parse_nodes

_MEDIA = [
    '<img srcset="https://c.example.com/{p}-300.jpg 300w, https://c.example.com/{p}-1200.jpg 1200w" src="/s.jpg"><img src="data:x" data-src="https://c.example.com/l{p}.jpg"><img src="/placeholder.gif"><link rel="stylesheet" href="/m{p}.css">',
    '<img src="https://c.example.com/{p}.jpg"><img src="https://c.example.com/{p}.jpg"><picture><source srcset="https://c.example.com/p{p}.webp 2x"><img src="https://c.example.com/q{p}.jpg"></picture>',
]


@query("ext_28_asset_list", """
SELECT CAST(page_id AS VARCHAR) AS page_id, replace(v.url, '{p}', CAST(page_id AS VARCHAR)) AS url FROM pages, (VALUES
  (0, 'https://c.example.com/{p}-1200.jpg'), (0, 'https://c.example.com/l{p}.jpg'), (1, 'https://c.example.com/{p}.jpg'),
  (1, 'https://c.example.com/p{p}.webp'), (1, 'https://c.example.com/q{p}.jpg')) v(k, url) WHERE page_id % 2 = v.k""")
@query("set_07_ordered_asset_urls", """
SELECT CAST(page_id AS VARCHAR) AS page_id, replace(v.url, '{p}', CAST(page_id AS VARCHAR)) AS url FROM pages, (VALUES
  (0, 'https://c.example.com/{p}-1200.jpg'), (0, 'https://c.example.com/l{p}.jpg'), (1, 'https://c.example.com/{p}.jpg'),
  (1, 'https://c.example.com/p{p}.webp'), (1, 'https://c.example.com/q{p}.jpg')) v(k, url) WHERE page_id % 2 = v.k""")
def asset_list(spark, sf):
    pages = illustrated(spark, sf, _MEDIA)
    # Sorting looks at its input twice: once for the bounds of its ranges.
    return materialize(A.asset_list(parse_nodes(pages), _page(pages)).select("page_id", "pre", "url")).orderBy("page_id", "pre").select("page_id", "url")


@query("ext_28_asset_list_full", """
SELECT CAST(page_id AS VARCHAR) AS page_id, replace(v.url, '{p}', CAST(page_id AS VARCHAR)) AS url, v.kind FROM pages, (VALUES
  (0, 'https://c.example.com/{p}-1200.jpg', 'image'), (0, 'https://c.example.com/l{p}.jpg', 'image'), (1, 'https://c.example.com/{p}.jpg', 'image'),
  (1, 'https://c.example.com/q{p}.jpg', 'image')) v(k, url, kind) WHERE page_id % 2 = v.k
UNION ALL SELECT CAST(page_id AS VARCHAR), regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/m' || page_id || '.css', 'stylesheet' FROM pages WHERE page_id % 2 = 0""")
def asset_list_full(spark, sf):
    pages = illustrated(spark, sf, _MEDIA)
    return A.asset_list(parse_nodes(pages), _page(pages), "full").select("page_id", "url", "kind")


@query("ext_29_css_font_urls", """
SELECT page_id, '/f/' || page_id || '.woff2 https://f.example.com/b.woff' AS urls FROM pages""")
def css_font_urls(spark, sf):
    css = F.expr("concat('p{color:red} @font-face { font-family: A; src: url(\"/f/', page_id, '.woff2\") } a{} @font-face{src:url(https://f.example.com/b.woff)}')")
    return D.pages(spark, sf).select("page_id", F.array_join(media.css_font_urls(css), " ").alias("urls"))


def _assets(spark, sf):
    """Twelve fetched assets per document, with sizes and failures that vary."""
    return D.documents(spark, sf).select(
        F.col("doc_id").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pre")
    ).select(
        "page_id", "pre",
        F.expr("concat('https://c.example.com/', (page_id + pre) % 97, '.jpg')").alias("url"),
        F.expr("200000 + (page_id * 7919 + pre * 104729) % 2600000").alias("size"),
        F.expr("pre = 0").alias("is_hero"), F.expr("(page_id + pre) % 13 <> 0").alias("ok"),
    )


_BUDGET = """
, a AS (SELECT doc_id AS page_id, pre, 'https://c.example.com/' || (doc_id + pre) % 97 || '.jpg' AS url,
    200000 + (doc_id * 7919 + pre * 104729) % 2600000 AS size, pre = 0 AS is_hero, (doc_id + pre) % 13 <> 0 AS ok FROM documents, range(0, 12) r(pre)),
b AS (SELECT *, ok AND size <= CASE WHEN is_hero THEN 3000000 ELSE 2000000 END AS fits FROM a),
c AS (SELECT *, CAST(sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pre) AS BIGINT) AS total FROM b),
d AS (SELECT *, fits AND total - size < 8000000 AS loaded, NOT fits AS failed FROM c),
e AS (SELECT *, loaded AND total >= 8000000 AS was_truncated FROM d)
"""


@query("ext_30_asset_budget", _BUDGET + "SELECT page_id, pre, loaded, was_truncated, failed FROM e")
def asset_budget(spark, sf):
    return A.asset_budget(_assets(spark, sf)).select("page_id", big("pre"), "loaded", "was_truncated", "failed")


@query("agg_10_asset_totals", _BUDGET + """
SELECT page_id, CAST(coalesce(sum(CASE WHEN loaded THEN size END), 0) AS BIGINT) AS total_size_bytes, bool_or(was_truncated) AS is_truncated,
  CASE WHEN bool_or(failed) THEN 'partial' ELSE 'cached' END AS fetch_status FROM e GROUP BY page_id""")
def asset_totals(spark, sf):
    return A.asset_totals(A.asset_budget(_assets(spark, sf))).select("page_id", big("total_size_bytes"), "is_truncated", "fetch_status")


@query("agg_15_shared_asset_dedup", _BUDGET + """
SELECT sha256(url) AS asset_key, max(size) AS stored_bytes, CAST(sum(size) AS BIGINT) AS referenced_bytes, count(*) AS pages FROM e WHERE loaded GROUP BY url""")
def shared_asset_dedup(spark, sf):
    return A.shared_asset_dedup(A.asset_budget(_assets(spark, sf))).select(
        "asset_key", big("stored_bytes"), big("referenced_bytes"), big("pages"))


@query("ext_31_rewrite_assets", expected(
    "x1=./assets/a{p}.jpg x3=data:z x4=./assets/l{p}.jpg", "x1=./assets/b{p}.jpg"))
def rewrite_assets(spark, sf):
    pages = illustrated(spark, sf, [
        '<img id="x1" src="https://c.example.com/{p}.jpg" srcset="https://c.example.com/{p}-2.jpg 2x"><img id="x2" src="/gone.jpg"><img id="x3" src="data:z"><img id="x4" src="/ph.gif" data-src="https://c.example.com/l{p}.jpg">',
        '<img id="x1" src="/none.jpg" srcset="https://c.example.com/s{p}.jpg 300w, https://c.example.com/{p}-2.jpg 900w"><picture><source id="x2" srcset="/q.webp"></picture>'])
    p = D.pages(spark, sf).select(F.col("page_id").cast("string").alias("page_id"))
    stored = p.select("page_id", F.explode(F.array(
        F.struct(F.expr("concat('https://c.example.com/', page_id, '.jpg')").alias("url"), F.expr("concat('a', page_id, '.jpg')").alias("filename")),
        F.struct(F.expr("concat('https://c.example.com/', page_id, '-2.jpg')").alias("url"), F.expr("concat('b', page_id, '.jpg')").alias("filename")),
        F.struct(F.expr("concat('https://c.example.com/l', page_id, '.jpg')").alias("url"), F.expr("concat('l', page_id, '.jpg')").alias("filename")),
    )).alias("s")).select("page_id", "s.*")
    return marks(A.rewrite_assets(parse_nodes(pages), _page(pages), stored), attr("src"))


@query("ext_32_asset_fallbacks", """
SELECT CAST(page_id AS VARCHAR) AS page_id, CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS tier,
  'https://c.example.com/' || CASE page_id % 3 WHEN 0 THEN 'set' WHEN 1 THEN 'src' ELSE 'zoom' END || page_id || '.jpg' AS url FROM pages""")
def asset_fallbacks(spark, sf):
    pages = illustrated(spark, sf, [
        '<a href="https://c.example.com/zoom{p}.jpg"><img src="https://c.example.com/src{p}.jpg" srcset="https://c.example.com/set{p}.jpg 1200w"></a>'])
    # What the log knows depends on the page: the chosen address, its src, or only the link.
    fetch = D.pages(spark, sf).select(F.expr(
        "explode(CASE page_id % 3 WHEN 0 THEN array('set', 'src', 'zoom') WHEN 1 THEN array('src', 'zoom') ELSE array('zoom') END)").alias("k"), "page_id").select(
        F.expr("concat('https://c.example.com/', k, page_id, '.jpg')").alias("url"), F.lit(True).alias("ok"))
    return A.asset_fallbacks(parse_nodes(pages), _page(pages), fetch).select("page_id", big("tier"), "url")
