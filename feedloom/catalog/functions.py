"""Queries over the column functions, each on every row of a given table."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog import derive as D
from feedloom.catalog.registry import big, query
from feedloom.functions import media, names, text as T, urls
from feedloom.operators import maintenance

URL_PARTS = """
, u AS (SELECT page_id, url, regexp_extract(url, '^([^:/?#]+)://', 1) AS sch, regexp_extract(url, '://([^/?#]*)', 1) AS au,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS pa, regexp_extract(url, '[?]([^#]*)', 1) AS qu FROM pages)
"""


@query("fn_01_normalize_url", URL_PARTS + """
SELECT page_id, '//' || regexp_replace(lower(au), '^www[.]', '') || regexp_replace(pa, '/$', '')
  || CASE WHEN qu <> '' THEN '?' || qu ELSE '' END AS key FROM u""")
def normalize_url(spark, sf):
    return D.pages(spark, sf).select("page_id", urls.normalize_url(F.col("page_url")).alias("key"))


@query("fn_02_normalize_feed_url", """
SELECT page_id, regexp_replace(regexp_replace(lower(url), '/$', ''), 'https?://', '', 'g') AS key FROM pages""")
def normalize_feed_url(spark, sf):
    return D.pages(spark, sf).select("page_id", urls.normalize_feed_url(F.col("page_url")).alias("key"))


@query("fn_03_upgrade_https",
       "SELECT page_id, regexp_replace(url, '^http://', 'https://') AS url FROM pages")
def upgrade_https(spark, sf):
    return D.pages(spark, sf).select("page_id", urls.upgrade_https(F.col("page_url")).alias("url"))


_REFS = ("../img/a.png", "/rss", "//cdn.example.com/x", "?page=3", "#top", "next/", "https://other.example.com/", "")


@query("fn_04_resolve_url", URL_PARTS + """
, r AS (SELECT u.*, 'https://' || au AS root, regexp_replace(pa, '[^/]*$', '') AS dir FROM u)
SELECT page_id, ref, CASE ref
  WHEN '../img/a.png' THEN root || regexp_replace(dir, '[^/]+/$', '') || 'img/a.png'
  WHEN '/rss' THEN root || '/rss' WHEN '//cdn.example.com/x' THEN 'https://cdn.example.com/x'
  WHEN '?page=3' THEN root || pa || '?page=3'
  WHEN '#top' THEN root || pa || CASE WHEN qu <> '' THEN '?' || qu ELSE '' END || '#top'
  WHEN 'next/' THEN root || dir || 'next/' WHEN 'https://other.example.com/' THEN ref END AS url
FROM r, (VALUES ('../img/a.png'), ('/rss'), ('//cdn.example.com/x'), ('?page=3'), ('#top'), ('next/'), ('https://other.example.com/'), ('')) v(ref)""")
def resolve_url(spark, sf):
    refs = F.explode(F.array(*[F.lit(r) for r in _REFS])).alias("ref")
    d = D.pages(spark, sf).select("page_id", "page_url", refs)
    return d.select("page_id", "ref", urls.resolve_url(F.col("page_url"), F.col("ref")).alias("url"))


@query("fn_05_display_domain", URL_PARTS + """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Wire' ELSE regexp_replace(lower(au), '^www[.]', '') END AS domain FROM u""")
def display_domain(spark, sf):
    name = F.expr("CASE WHEN page_id % 4 = 0 THEN 'Wire' WHEN page_id % 4 = 1 THEN '' END")
    return D.pages(spark, sf).select("page_id", urls.display_domain(name, F.col("page_url")).alias("domain"))


@query("fn_06_bare_domain", URL_PARTS + """
SELECT page_id, regexp_replace(regexp_replace(lower(au), '^www[.]', ''), '[.][^.]*$', '') AS domain FROM u""")
def bare_domain(spark, sf):
    return D.pages(spark, sf).select("page_id", urls.bare_domain(F.col("page_url")).alias("domain"))


@query("fn_07_deterministic_id", """
SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS feed_id
FROM (SELECT page_id, sha256(url) AS h FROM pages)""")
def deterministic_id(spark, sf):
    return D.pages(spark, sf).select("page_id", urls.deterministic_id(F.col("page_url")).alias("feed_id"))


@query("fn_08_slugify", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(d_title), '[^a-z0-9\s-]', '', 'g'), '^ +| +$', '', 'g'), '\s+', '-', 'g'), '-{2,}', '-', 'g') AS ascii_slug,
  regexp_replace(regexp_replace(trim(regexp_replace(lower(d_title), '[^\p{L}\p{M}\p{N} -]', '', 'g')), ' +', '-', 'g'), '-{2,}', '-', 'g') AS slug
FROM t_doc""")
def slugify(spark, sf):
    d = D.documents(spark, sf).withColumn("t", D._title())
    return d.select("doc_id", T.slugify(F.col("t"), True).alias("ascii_slug"), T.slugify(F.col("t")).alias("slug"))


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _run_sql(labels: str) -> str:
    """The first run of adjacent words that joins to a label, as [start, words]; null without."""
    ends = f"list_filter(range(1, least(len(clean) - i + 1, reach) + 1), lambda n: array_to_string(clean[i:i + n - 1], '') IN ({labels}))"
    return f"""list_filter(list_transform(range(1, len(clean) + 1), lambda i: CASE WHEN len({ends}) > 0 THEN [i, ({ends})[1]] END), lambda r: r IS NOT NULL)[1]"""


_BARE = r"list_transform(w, lambda x: regexp_replace(x, '^\p{P}+|\p{P}+$', '', 'g'))"
_SPACED = "d_name"
for _mark in names.SPACED_SEPARATORS:
    _SPACED = f"replace({_SPACED}, '{_mark}', ' {_mark} ')"


@query("fn_09_simplify_name", f"""
, a AS (
  SELECT id, name || ' | ' || tag2 AS d_name, regexp_replace(lower(regexp_extract(feed_url, '://([^/]+)', 1)), 'www[.]|feeds[.]', '', 'g') AS label FROM t_dir),
b AS (SELECT id, d_name, split_part(label, '.', 1) AS d, trim(regexp_replace({_SPACED}, ' {{2,}}', ' ', 'g')) AS n FROM a),
c AS (SELECT *, replace(d, '-', '') AS dh, list_filter(string_split(n, ' '), lambda x: x <> '') AS w FROM b),
e AS (SELECT *, {_BARE} AS bare, coalesce(list_position(list_transform(w, lambda x: x IN {_in(names.SEPARATORS)}), true), 0) - 1 AS sep FROM c),
f AS (SELECT *, list_transform(bare, lambda x: lower(x)) AS clean, length(d) + len(list_filter(bare, lambda x: x = '')) AS reach,
    CASE WHEN sep > 0 THEN list_filter(bare[1:sep], lambda x: x <> '') ELSE [] END AS bef,
    CASE WHEN sep > 0 THEN list_filter(bare[sep + 2:], lambda x: x <> '') ELSE [] END AS aft FROM e),
g AS (SELECT *, array_to_string(bef, ' ') AS bj, array_to_string(aft, ' ') AS aj, lower(array_to_string(bef, '')) AS bc, lower(array_to_string(aft, '')) AS ac,
    list_position(list_transform(clean, lambda x: x IN (d, dh)), true) AS hit,
    CASE WHEN len(w) > 5 AND d <> '' THEN {_run_sql('d, dh')} END AS run,
    list_filter(list_transform(list_filter(w, lambda x: x NOT IN {_in(names.SEPARATORS)}), lambda x: regexp_replace(x, '^\\p{{P}}+|\\p{{P}}+$', '', 'g')), lambda x: x <> '') AS rl
  FROM f)
SELECT id, d_name AS name, CASE WHEN n = '' THEN n
  WHEN sep > 0 AND len(aft) > 0 AND lower(bj) IN {_in(names.GENERIC_TERMS)} THEN aj
  WHEN sep > 0 AND len(bef) > 0 AND lower(aj) IN {_in(names.GENERIC_TERMS)} THEN bj
  WHEN sep > 0 AND d <> '' AND ac IN (d, dh) THEN aj WHEN sep > 0 AND d <> '' AND bc IN (d, dh) THEN bj
  WHEN len(w) <= 5 OR d = '' THEN n WHEN hit > 0 THEN bare[hit]
  WHEN run IS NOT NULL THEN array_to_string(bare[run[1]:run[1] + run[2] - 1], ' ')
  WHEN sep > 0 AND len(bef) BETWEEN 1 AND 4 THEN bj ELSE array_to_string(rl[1:3], ' ') END AS simple_name
FROM g""")
def simplify_name(spark, sf):
    d = D.directory_feed(spark, sf).withColumn("name", F.concat_ws(" | ", "name", F.element_at("tags", 2)))
    return names.with_simple_name(d, "name", "feed_url").select("id", "name", "simple_name")


@query("fn_10_shorten_title", f"""
, a AS (SELECT doc_id, d_title AS t, split_part(lower(regexp_extract(d_url, '://([^/]+)', 1)), '.', 1) AS d, trim(d_title) AS raw FROM t_doc),
b AS (SELECT *, list_filter(string_split(raw, ' '), lambda x: x <> '') AS w FROM a),
c AS (SELECT *, {_BARE} AS bare FROM b),
e AS (SELECT *, list_transform(bare, lambda x: lower(x)) AS clean, length(d) + len(list_filter(bare, lambda x: x = '')) AS reach FROM c),
f AS (SELECT *, list_position(clean, d) AS hit, CASE WHEN len(w) > 5 AND d <> '' THEN {_run_sql('d')} END AS run,
    list_filter(list_transform(list_filter(w, lambda x: x NOT IN {_in(names.TITLE_SEPARATORS)}), lambda x: regexp_replace(x, '^[–—|>:·•]+|[–—|>:·•]+$', '', 'g')), lambda x: x <> '') AS rl
  FROM e)
SELECT doc_id, t, CASE WHEN len(w) <= 5 THEN raw WHEN d <> '' AND hit > 0 THEN bare[hit]
  WHEN run IS NOT NULL THEN array_to_string(bare[run[1]:run[1] + run[2] - 1], ' ') ELSE array_to_string(rl[1:3], ' ') END AS short_title
FROM f""")
def shorten_title(spark, sf):
    d = D.documents(spark, sf).withColumn("t", D._title()).withColumn("u", D._url())
    return names.with_short_title(d, "t", "u").select("doc_id", "t", "short_title")


@query("fn_11_parse_feed_date", """
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS rfc, strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS iso,
  CAST(NULL AS VARCHAR) AS bad FROM events""")
def parse_feed_date(spark, sf):
    e = D.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    out = lambda c: F.date_format(T.parse_feed_date(c), "yyyy-MM-dd HH:mm:ss")
    return e.select(
        "event_id", out(F.concat(F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).alias("rfc"),
        out(F.concat(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("iso"),
        out(F.date_format("t", "yyyy/MM/dd")).alias("bad"))


@query("fn_12_decode_entities", r"""
SELECT doc_id, text AS decoded FROM documents""")
def decode_entities(spark, sf):
    # Escaping and decoding again gives the text back, whatever it holds.
    d = D.documents(spark, sf).withColumn("e", T.escape_html(F.col("text")))
    plain = F.when(F.col("text").rlike("[&<>\"]"), T.unescape(F.col("e"))).otherwise(F.col("e"))
    return d.select("doc_id", plain.alias("decoded"))


@query("fn_13_first_image_src", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE '/i/' || page_id || '.jpg' END AS src FROM pages""")
def first_image_src(spark, sf):
    tag = F.expr("CASE page_id % 3 WHEN 0 THEN '<img src=\"data:x\">' WHEN 1 THEN concat('<IMG alt=\"a\" src=''/i/', page_id, '.jpg''><img src=\"z\">') ELSE concat('<img class=\"c\" src = \"/i/', page_id, '.jpg\">') END")
    d = D.pages(spark, sf).withColumn("html", F.concat("html", tag))
    return d.select("page_id", media.first_image_src(F.col("html")).alias("src"))


@query("fn_14_reading_minutes", "SELECT doc_id, greatest(1, (n_chars // 6 + 199) // 200) AS minutes FROM documents")
def reading_minutes(spark, sf):
    return D.documents(spark, sf).select("doc_id", big(T.reading_minutes(F.expr("n_chars div 6")), "minutes"))


@query("fn_15_format_minutes", """
, m AS (SELECT doc_id, n_chars // 20 AS m FROM documents),
r AS (SELECT *, CASE WHEN m < 10 THEN m ELSE (m + 2) // 5 * 5 END AS r FROM m)
SELECT doc_id, CASE WHEN m <= 0 THEN NULL WHEN m < 5 THEN '5min' WHEN m >= 300 THEN '5hr+' WHEN r < 60 THEN r || 'min'
  WHEN r % 60 = 0 THEN r // 60 || 'hr' ELSE r // 60 || 'hr ' || r % 60 || 'min' END AS label, m || ' min read' AS read_label FROM r""")
def format_minutes(spark, sf):
    m = F.expr("n_chars div 20")
    return D.documents(spark, sf).select("doc_id", T.format_minutes(m).alias("label"), T.minutes_label(m).alias("read_label"))


@query("fn_16_relative_time", """
, e AS (SELECT event_id, ts, TIMESTAMP '2024-01-15 12:00:00' AS now,
    epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts) AS us FROM events)
SELECT event_id, CASE WHEN us < 0 THEN 'On ' || strftime(ts, '%b %-d, %Y') WHEN us < 60000000 THEN 'Just now'
  WHEN us < 3600000000 THEN us // 60000000 || 'm ago' WHEN us < 86400000000 THEN us // 3600000000 || 'h ago'
  WHEN date_diff('day', CAST(ts AS DATE), CAST(now AS DATE)) = 1 THEN 'Yesterday'
  WHEN date_diff('day', CAST(ts AS DATE), CAST(now AS DATE)) BETWEEN 2 AND 6 THEN date_diff('day', CAST(ts AS DATE), CAST(now AS DATE)) || ' days ago'
  ELSE 'On ' || strftime(ts, '%b %-d, %Y') END AS label FROM e""")
def relative_time(spark, sf):
    e = D.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.select("event_id", T.relative_time(F.col("t"), F.expr("timestamp'2024-01-15 12:00:00'"), "On").alias("label"))


def _srcset():
    return F.expr("concat('https://c.example.com/w_640,c_limit/', doc_id, '.jpg ', doc_id % 7 * 300, 'w, https://c.example.com/w_9,c_x/', doc_id, '.jpg ', doc_id % 5 * 400, 'w, /s/', doc_id, '.jpg ', doc_id % 3 + 1, 'x')")


@query("fn_17_parse_srcset", """
SELECT doc_id, 'https://c.example.com/w_640,c_limit/' || doc_id || '.jpg ' || doc_id % 7 * 300 || 'w|https://c.example.com/w_9,c_x/' || doc_id || '.jpg ' || doc_id % 5 * 400 || 'w|/s/' || doc_id || '.jpg ' || (doc_id % 3 + 1) || 'x' AS entries
FROM documents""")
def parse_srcset(spark, sf):
    return D.documents(spark, sf).select("doc_id", F.array_join(media.parse_srcset(_srcset()), "|").alias("entries"))


@query("win_14_pick_srcset", """
, c AS (SELECT doc_id, 0 AS i, 'https://c.example.com/w_640,c_limit/' || doc_id || '.jpg' AS url, doc_id % 7 * 300 AS w FROM documents
  UNION ALL SELECT doc_id, 1, 'https://c.example.com/w_9,c_x/' || doc_id || '.jpg', doc_id % 5 * 400 FROM documents
  UNION ALL SELECT doc_id, 2, '/s/' || doc_id || '.jpg', (doc_id % 3 + 1) * 600 FROM documents)
SELECT doc_id, arg_min(url, (CASE WHEN w <= 0 THEN 3 WHEN w BETWEEN 1000 AND 1500 THEN 0 WHEN w < 1000 THEN 1 ELSE 2 END,
  CASE WHEN w < 1000 THEN -w ELSE w END, i)) AS url FROM c GROUP BY doc_id""")
def pick_srcset(spark, sf):
    return D.documents(spark, sf).select("doc_id", media.pick_srcset(_srcset()).alias("url"))


@query("fn_18_image_dedup_key", "SELECT doc_id, 'https://c.example.com/' || doc_id || '.jpg' AS key FROM documents")
def image_dedup_key(spark, sf):
    src = F.expr("concat('https://c.example.com/', doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-640x426' ELSE '-1152x648-1774644559' END, '.jpg')")
    return D.documents(spark, sf).select("doc_id", media.image_dedup_key(src).alias("key"))


@query("fn_19_asset_filename", """
, a AS (SELECT doc_id, 'https://c.example.com/i/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.webp?x=1' ELSE '' END AS u,
  CASE doc_id % 3 WHEN 0 THEN 'image/jpeg; q=1' WHEN 1 THEN 'IMAGE/PNG' END AS mime FROM documents)
SELECT doc_id, sha256(u) || '.' || CASE WHEN doc_id % 2 = 0 THEN 'webp' WHEN mime LIKE 'image/jpeg%' THEN 'jpg' WHEN mime = 'IMAGE/PNG' THEN 'png' ELSE 'bin' END AS filename FROM a""")
def asset_filename(spark, sf):
    u = F.expr("concat('https://c.example.com/i/', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.webp?x=1' ELSE '' END)")
    mime = F.expr("CASE doc_id % 3 WHEN 0 THEN 'image/jpeg; q=1' WHEN 1 THEN 'IMAGE/PNG' END")
    return D.documents(spark, sf).select("doc_id", media.asset_filename(u, mime).alias("filename"))


@query("fn_20_meta_description", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'og & ' || page_id WHEN 1 THEN 'plain ' || page_id WHEN 2 THEN 'rev ' || page_id END AS description FROM pages""")
def meta_description(spark, sf):
    meta = F.expr("""CASE page_id % 4
      WHEN 0 THEN concat('<meta name="description" content="no"><meta property="og:description" content=" og &amp; ', page_id, '">')
      WHEN 1 THEN concat('<META name="description" content="plain ', page_id, '">')
      WHEN 2 THEN concat('<meta content="rev ', page_id, '" name="description">') ELSE '' END""")
    return D.pages(spark, sf).select("page_id", T.meta_description(F.concat(meta, F.col("html"))).alias("description"))


@query("fn_22_add_paragraphs", r"""
, t AS (SELECT doc_id, text, contains(text, chr(10)) AS has_break FROM documents),
l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS blank,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS lines FROM t)
SELECT doc_id, CASE WHEN len(blank) > 1 THEN list_aggregate(list_transform(blank, lambda x: '<p>' || x || '</p>'), 'string_agg', chr(10))
  WHEN len(lines) > 1 THEN list_aggregate(list_transform(lines, lambda x: '<p>' || x || '</p>'), 'string_agg', chr(10)) END AS html
FROM l""")
def add_paragraphs(spark, sf):
    # Texts on one line split at sentences, which the comparison engine cannot express.
    d = D.documents(spark, sf).withColumn("p", T.add_paragraphs(F.col("text")))
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: T.trim_ws(x) != "")) > 1
    return d.select("doc_id", F.when(lines, F.col("p")).alias("html"))


@query("fn_22_sentence_paragraphs", r"""
, s AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents),
p AS (SELECT doc_id, t, list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)) AS l FROM s),
g AS (SELECT doc_id, t, l, list_filter(list_transform(range(1, len(l) + 1, 3), lambda i: array_to_string(l[i:i + 2], ' ')), lambda x: x <> '') AS q FROM p)
SELECT doc_id, CASE WHEN len(l) > 1 THEN array_to_string(list_transform(q, lambda x: '<p>' || x || '</p>'), chr(10)) ELSE '<p>' || t || '</p>' END AS html FROM g""")
def sentence_paragraphs(spark, sf):
    one_line = F.regexp_replace("text", r"\s+", " ")
    return D.documents(spark, sf).select("doc_id", T.add_paragraphs(one_line).alias("html"))


@query("fn_23_escape_html", """
SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM documents""")
def escape_html(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.escape_html(F.col("text")).alias("html"))


@query("fn_24_render_page", """
SELECT doc_id, '<html><body><h1>' || replace(replace(replace(replace(d_title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</h1>' || text || '</body></html>' AS html FROM t_doc""")
def render_page(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.render_page(D._title(), F.col("text")).alias("html"))


@query("fn_25_text_segments", r"""
SELECT page_id, list_aggregate(list_filter(regexp_split_to_array(lower(url), '[_\-./ ?&=]'), lambda x: x <> ''), 'string_agg', ' ') AS segments FROM pages""")
def text_segments(spark, sf):
    return D.pages(spark, sf).select("page_id", F.array_join(media.text_segments(F.col("page_url")), " ").alias("segments"))


@query("fn_28_icon_site_candidates", URL_PARTS + """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://feeds.' || au || '/x' || ' ' || 'https://' || au ELSE 'https://' || au || '/x' END AS candidates FROM u""")
def icon_site_candidates(spark, sf):
    site = F.expr("concat('https://', CASE WHEN page_id % 2 = 0 THEN 'feeds.' ELSE '' END, regexp_extract(page_url, '://([^/?#]*)', 1), '/x')")
    return D.pages(spark, sf).select("page_id", F.array_join(urls.icon_site_candidates(site), " ").alias("candidates"))


@query("flt_17_is_placeholder_image", """
SELECT doc_id, doc_id % 5 < 3 AS placeholder FROM documents""")
def is_placeholder_image(spark, sf):
    u = F.expr("""CASE doc_id % 5 WHEN 0 THEN concat('https://c.example.com/grey-placeholder/', doc_id) WHEN 1 THEN concat('https://x.example.com/', doc_id, '/pixel.gif')
      WHEN 2 THEN 'https://pixel.quantserve.com/p' WHEN 3 THEN concat('https://c.example.com/pixel.gif/', doc_id) ELSE concat('https://c.example.com/', doc_id, '.jpg') END""")
    return D.documents(spark, sf).select("doc_id", media.is_placeholder_image(u).alias("placeholder"))


@query("flt_19_looks_like_url", r"""
SELECT doc_id, contains(trim(d_title), '.') AND NOT contains(trim(d_title), ' ') AS title_is_url,
  contains(source || '.example.com', '.') AS source_is_url, 'https://' || source || '.example.com' AS with_scheme FROM t_doc""")
def looks_like_url(spark, sf):
    d = D.documents(spark, sf).withColumn("t", D._title()).withColumn("h", F.concat("source", F.lit(".example.com")))
    return d.select("doc_id", urls.looks_like_url(F.col("t")).alias("title_is_url"),
                    urls.looks_like_url(F.col("h")).alias("source_is_url"), urls.with_default_scheme(F.col("h")).alias("with_scheme"))


@query("agg_12_word_count", r"""
SELECT doc_id, len(regexp_extract_all(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS words FROM documents""")
def word_count(spark, sf):
    return D.documents(spark, sf).select("doc_id", big(T.word_count(F.col("text")), "words"))


@query("agg_13_paywall_score", """
SELECT page_id, page_id % 3 + page_id % 2 AS score FROM pages""")
def paywall_score(spark, sf):
    extra = F.expr("concat(repeat('<div class=\"PayWall\">', cast(page_id % 3 AS int)), repeat('<i data-metered-content>', cast(page_id % 2 AS int)))")
    return D.pages(spark, sf).select("page_id", big(T.paywall_score(F.concat("html", extra)), "score"))


@query("win_07_status_rank", """
SELECT id, CASE fetch_status WHEN 'cached' THEN 4 WHEN 'partial' THEN 3 WHEN 'pending' THEN 2 WHEN 'fetching' THEN 1 ELSE 0 END AS status_rank FROM t_article""")
def status_rank(spark, sf):
    return D.article(spark, sf).select("id", big(maintenance.status_rank(F.col("fetch_status")), "status_rank"))
