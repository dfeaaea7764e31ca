"""Queries over the feed directory."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog import derive as D
from feedloom.catalog.registry import big, query, ts
from feedloom.functions import names, text as T, urls
from feedloom.operators import directory as X, library as L
from feedloom.plans.directory_audit import run_audit
from feedloom.sources import feeds

TODAY = "DATE '2024-06-29'"
_NORM = "regexp_replace(regexp_replace(lower({c}), '/$', ''), 'https?://', '', 'g')"
_LIBNORM = "'//' || regexp_replace(regexp_extract(lower({c}), '://([^/?#]*)', 1), '^www[.]', '') || regexp_replace(regexp_extract({c}, '://[^/?#]*([^?#]*)', 1), '/$', '')"


def today():
    return F.expr("date'2024-06-29'")


@query("flt_08_looks_like_feed", "SELECT url, attempt, k % 11 <> 0 AS is_feed FROM t_fetch")
def looks_like_feed(spark, sf):
    return D.feed_fetch(spark, sf).select("url", big("attempt"), T.looks_like_feed(F.col("body")).alias("is_feed"))


@query("flt_09_feed_issue", """
SELECT url, attempt, issue, CASE issue WHEN 'unreachable' THEN 'HTTP ' || status
  WHEN 'redirectsToHTTP' THEN 'http://' || regexp_extract(url, '://(.*)$', 1)
  WHEN 'malformedXML' THEN 'line 1: mismatched tag' END AS detail FROM t_fetch""")
def feed_issue(spark, sf):
    return X.feed_issue(D.feed_fetch(spark, sf)).select(
        "url", big("attempt"), F.col("issue.kind").alias("issue"), F.col("issue.detail").alias("detail"))


@query("flt_10_is_recently_verified",
       f"SELECT id, coalesce(last_verified >= {TODAY} - 60, false) AS recent FROM t_dir")
def is_recently_verified(spark, sf):
    return D.directory_feed(spark, sf).select("id", X.is_recently_verified(F.col("last_verified"), today()).alias("recent"))


@query("flt_11_is_stale_feed",
       f"SELECT url, attempt, newest < {TODAY} - INTERVAL 6 MONTH AS stale FROM t_fetch WHERE issue IS NULL")
def is_stale_feed(spark, sf):
    checked = X.feed_issue(D.feed_fetch(spark, sf)).filter("is_valid")
    facts = feeds.read_feed_check_items(checked.filter("attempt = 1")).withColumn("attempt", F.lit(1)).unionByName(
        feeds.read_feed_check_items(checked.filter("attempt = 2")).withColumn("attempt", F.lit(2)))
    return facts.select(F.col("feed_url").alias("url"), big("attempt"), X.is_stale(F.col("newest_item_date"), today()).alias("stale"))


@query("flt_15_is_feed_cdn_site", """
SELECT id FROM t_dir WHERE regexp_matches('http://' || CASE WHEN l = 'fr' THEN 'feeds.' ELSE '' END || h, '^http://(feeds|feed|rss|xml)[.]')""")
def is_feed_cdn_site(spark, sf):
    d = D.directory_feed(spark, sf).withColumn("site_url", F.expr(
        "concat('http://', CASE WHEN tags[0] = 'fr' THEN 'feeds.' ELSE '' END, regexp_extract(feed_url, '://([^/]+)', 1), '/')"))
    return X.feed_cdn_sites(d).select("id")


@query("flt_16_directory_lint", """
SELECT id, 'insecure_feed_url' AS rule FROM t_dir WHERE feed_url NOT LIKE 'https://%'
UNION ALL SELECT id, 'empty_name' FROM t_dir WHERE trim(name) = ''
UNION ALL SELECT id, 'generic_name' FROM t_dir WHERE regexp_matches(lower(name), '^(rss|feed|rss feed|blog|news)( -| [|]|:|$)')
UNION ALL SELECT id, 'duplicate_url' FROM t_dir WHERE lower(feed_url) IN
  (SELECT lower(feed_url) FROM t_dir GROUP BY 1 HAVING count(*) > 1)""")
def directory_lint(spark, sf):
    return X.directory_lint(D.directory_feed(spark, sf))


def _split(spark, sf):
    d = D.directory_feed(spark, sf)
    return d.filter("country IS NULL"), d.filter("country IS NOT NULL")


_ORDER = "CASE WHEN country IS NULL THEN 0 ELSE 1 END, pos"


@query("set_01_union_candidates", "SELECT id, CASE WHEN country IS NULL THEN 0 ELSE 1 END AS part FROM t_dir")
def union_candidates(spark, sf):
    return X.union_candidates(*_split(spark, sf)).select("id", big("part"))


_SET2 = f", u AS (SELECT *, row_number() OVER (PARTITION BY {_NORM.format(c='feed_url')} ORDER BY {_ORDER}) AS rn FROM t_dir)"


@query("set_02_distinct_urls", _SET2 + " SELECT id, feed_url FROM u WHERE rn = 1")
def distinct_urls(spark, sf):
    d = X.union_candidates(*_split(spark, sf))
    return X.distinct_urls(d, [F.col("part"), F.col("pos")]).select("id", "feed_url")


# Names without a separator and of at most five words are not simplified, which plain SQL can
# follow; the comparison gives every feed such a name.
_SET3 = _SET2 + """, s AS (SELECT *, row_number() OVER (PARTITION BY replace(h, 'www.', ''), 'name ' || category
  ORDER BY CASE WHEN country IS NULL THEN 0 ELSE 1 END, pos) AS r2 FROM u WHERE rn = 1)"""


@query("set_03_distinct_sites", _SET3 + " SELECT id FROM s WHERE r2 = 1")
def distinct_sites(spark, sf):
    d = X.union_candidates(*_split(spark, sf)).withColumn("name", F.concat(F.lit("Name "), F.col("category")))
    order = [F.col("part"), F.col("pos")]
    return X.distinct_sites(X.distinct_urls(d, order), order).select("id")


_MASTER = f"(SELECT {_NORM.format(c='feed_url')} FROM t_dir WHERE last_verified IS NOT NULL)"


@query("set_04_except_master", f"SELECT id FROM t_dir WHERE {_NORM.format(c='feed_url')} NOT IN {_MASTER}")
@query("join_08_not_in_master", f"SELECT id FROM t_dir WHERE {_NORM.format(c='feed_url')} NOT IN {_MASTER}")
def not_in_master(spark, sf):
    d = D.directory_feed(spark, sf)
    return X.not_in_master(d, d.filter("last_verified IS NOT NULL")).select("id")


@query("set_05_discover_candidates", _SET3 + f" SELECT id FROM s WHERE r2 = 1 AND {_NORM.format(c='feed_url')} NOT IN {_MASTER}")
def discover_candidates(spark, sf):
    topics, countries = (p.withColumn("name", F.concat(F.lit("Name "), F.col("category"))) for p in _split(spark, sf))
    master = D.directory_feed(spark, sf).filter("last_verified IS NOT NULL")
    return X.discover_candidates(topics, countries, master).select("id")


# ---- audit

_SIGNAL = """, sig AS (SELECT feed_url, pos, length(description) * 2 AS w, pos % 7 AS i, pos % 5 AS p,
    row_number() OVER (PARTITION BY feed_url ORDER BY pos) AS rn FROM t_dir),
med AS (SELECT feed_url, count(*) AS n, CAST(floor(quantile_cont(w, 0.5)) AS BIGINT) AS mw, CAST(floor(quantile_cont(i, 0.5)) AS BIGINT) AS mi,
    CAST(floor(quantile_cont(p, 0.5)) AS BIGINT) AS mp FROM sig WHERE rn <= 5 GROUP BY feed_url),
q AS (SELECT *, CASE WHEN n < 2 THEN 'too_few' WHEN mw < 100 THEN 'very_thin' WHEN mw < 200 AND mp >= 3 THEN 'paywalled'
    WHEN mw < 200 AND mi < 3 THEN 'thin' WHEN mw < 200 THEN 'image_rich' ELSE 'ok' END AS reason FROM med)"""


def signal(spark, sf):
    """Page facts per feed: its directory entries stand for sampled pages."""
    d = D.directory_feed(spark, sf).select(
        "feed_url", "pos", F.expr("length(description) * 2").alias("word_count"),
        F.expr("pos % 7").alias("image_count"), F.expr("pos % 5").alias("paywall_score"))
    return X.sample_articles(d)


@query("win_19_sample_articles",
       _SIGNAL + " SELECT feed_url, pos, rn FROM sig WHERE rn <= 5")
def sample_articles(spark, sf):
    return signal(spark, sf).select("feed_url", "pos", big("rn"))


@query("agg_04_feed_quality", _SIGNAL + """
SELECT feed_url, n AS sampled, CASE WHEN n < 2 THEN 0 ELSE mw END AS median_words, CASE WHEN n < 2 THEN 0 ELSE mi END AS median_images,
  reason, reason IN ('too_few', 'image_rich', 'ok') AS is_acceptable FROM q""")
def feed_quality(spark, sf):
    return X.feed_quality(signal(spark, sf)).select(
        "feed_url", big("sampled"), big("median_words"), big("median_images"), "reason", "is_acceptable")


_AUDIT = _SIGNAL + f""", a AS (
  SELECT d.*, f1.issue IS NULL AS v1, f2.url IS NOT NULL AND f2.issue IS NULL AS v2, f1.newest,
    coalesce(d.last_verified >= {TODAY} - 60, false) AS auto,
    EXISTS (SELECT 1 FROM t_dir o WHERE o.feed_url = d.feed_url AND NOT coalesce(o.last_verified >= {TODAY} - 60, false)) AS due,
    q.reason NOT IN ('too_few', 'image_rich', 'ok') AS bad
  FROM t_dir d JOIN t_fetch f1 ON f1.url = d.feed_url AND f1.attempt = 1
  LEFT JOIN t_fetch f2 ON f2.url = d.feed_url AND f2.attempt = 2 JOIN q ON q.feed_url = d.feed_url),
z AS (SELECT *, CASE WHEN auto THEN 'auto' WHEN (v1 OR v2) AND newest < {TODAY} - INTERVAL 6 MONTH THEN 'stale'
  WHEN v1 THEN 'valid' WHEN v2 THEN 'recovered' ELSE 'dead' END AS outcome FROM a),
y AS (SELECT *, outcome IN ('valid', 'recovered') AND bad AS thin FROM z)"""


def audited(spark, sf):
    return run_audit(D.directory_feed(spark, sf), D.feed_fetch(spark, sf), signal(spark, sf), today())


@query("set_05_validated_branches", _AUDIT + " SELECT id, outcome, thin FROM y")
def validated_branches(spark, sf):
    return audited(spark, sf)["audited"].select("id", "outcome", "thin")


@query("set_08_removal_reasons", _AUDIT + """
SELECT id, outcome AS reason FROM y WHERE outcome IN ('dead', 'stale') UNION ALL SELECT id, 'thin' FROM y WHERE thin""")
def removal_reasons(spark, sf):
    return X.removal_reasons(audited(spark, sf)["audited"])


@query("agg_07_directory_report", _AUDIT + """
SELECT category, outcome, count(*) AS feeds, count(*) FILTER (WHERE thin) AS thin FROM y GROUP BY CUBE (category, outcome)""")
def directory_report(spark, sf):
    return audited(spark, sf)["report"].select("category", "outcome", big("feeds"), big("thin"))


@query("agg_08_validation_totals", _AUDIT + """
SELECT category, count(*) FILTER (WHERE outcome <> 'dead') AS valid, count(*) FILTER (WHERE outcome = 'dead') AS invalid
FROM y WHERE outcome <> 'auto' GROUP BY ROLLUP (category)""")
def validation_totals(spark, sf):
    return X.validation_totals(audited(spark, sf)["audited"]).select("category", big("valid"), big("invalid"))


@query("upd_14_stamp_verified", _AUDIT + f"""
SELECT id, strftime(CASE WHEN feed_url IN (SELECT feed_url FROM y WHERE NOT auto AND (v1 OR v2)) THEN {TODAY} ELSE last_verified END, '%Y-%m-%d') AS last_verified FROM y""")
def stamp_verified(spark, sf):
    return audited(spark, sf)["stamped"].select("id", F.date_format("last_verified", "yyyy-MM-dd").alias("last_verified"))


@query("join_15_probe_feeds", """
, good AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '/[a-z][a-z]/feed/?$', '/rss.xml'), '^http:', 'https:') AS url FROM t_fetch WHERE issue IS NULL),
cand AS (SELECT id, 0 AS n, feed_url AS url FROM t_dir WHERE pos % 3 = 0 UNION ALL SELECT id, 3, 'https://' || h || '/rss.xml' FROM t_dir)
SELECT c.id, arg_min(c.url, c.n) AS found_url FROM cand c JOIN good g ON g.url = c.url GROUP BY c.id""")
def probe_feeds(spark, sf):
    d = D.directory_feed(spark, sf)
    sites = d.select(
        "id", F.expr("concat('https://', regexp_extract(feed_url, '://([^/]+)', 1), '/')").alias("site_url"),
        F.expr("CASE WHEN pos % 3 = 0 THEN feed_url END").alias("declared"))
    valid = X.feed_issue(D.feed_fetch(spark, sf)).filter("is_valid").select(
        F.expr("regexp_replace(regexp_replace(url, '/[a-z][a-z]/feed/?$', '/rss.xml'), '^http:', 'https:')").alias("url"))
    return X.probe_feeds(X.feed_candidates(sites), valid)


@query("upd_13_verify_directory", f"""
, ok AS (SELECT url, bool_or(issue IS NULL) AS ok FROM t_fetch GROUP BY url),
v AS (SELECT d.*, CASE WHEN pos % 3 = 0 THEN 'https://' || h || '/rss.xml' WHEN pos % 3 = 1 THEN upper(feed_url) END AS found_url, ok.ok
      FROM t_dir d JOIN ok ON ok.url = d.feed_url),
w AS (SELECT *, CASE WHEN ok THEN 'ok' WHEN found_url IS NOT NULL AND {_NORM.format(c='found_url')} <> {_NORM.format(c='feed_url')} THEN 'fixed' ELSE 'removed' END AS verdict FROM v)
SELECT id, verdict, CASE WHEN verdict = 'fixed' THEN found_url ELSE feed_url END AS feed_url,
  strftime(CASE WHEN verdict <> 'fixed' THEN last_verified END, '%Y-%m-%d') AS last_verified FROM w""")
def verify_directory(spark, sf):
    d = D.directory_feed(spark, sf)
    checks = X.feed_issue(D.feed_fetch(spark, sf)).select(F.col("url").alias("feed_url"), "attempt", "is_valid")
    found = d.select("id", F.expr(
        "CASE pos % 3 WHEN 0 THEN concat('https://', regexp_extract(feed_url, '://([^/]+)', 1), '/rss.xml') WHEN 1 THEN upper(feed_url) END").alias("found_url"))
    return X.verify_directory(d, checks, found).select(
        "id", "verdict", "feed_url", F.date_format("last_verified", "yyyy-MM-dd").alias("last_verified"))


# ---- browse and search


@query("agg_06_category_counts",
       "SELECT category, count(*) AS feed_count, bool_or(country IS NOT NULL) AS is_country FROM t_dir GROUP BY category")
def category_counts(spark, sf):
    return X.category_counts(D.directory_feed(spark, sf)).select("category", big("feed_count"), "is_country")


@query("sort_05_name_order", "SELECT id, name FROM t_dir WHERE category = 'Tech'")
def name_order(spark, sf):
    return X.feeds_in(D.directory_feed(spark, sf), "Tech").select("id", "name")


@query("sort_06_category_order", """
SELECT category, bool_or(country IS NOT NULL) AS is_country,
  CASE WHEN bool_or(country IS NOT NULL) THEN 36 ELSE CASE category WHEN 'Tech' THEN 1 WHEN 'Science' THEN 3 ELSE 36 END END AS category_rank
FROM t_dir GROUP BY category""")
def category_order(spark, sf):
    return X.ordered_categories(X.category_counts(D.directory_feed(spark, sf))).select(
        "category", "is_country", big("category_rank"))


def _score(terms):
    total = []
    dom = r"regexp_replace(regexp_replace(coalesce(regexp_extract(lower(site_url), '://([^/?#]*)', 1), ''), '^www[.]', ''), '[.][^.]*$', '')"
    for t in terms:
        total.append(f"""CASE WHEN starts_with(lower(name), '{t}') THEN 100 WHEN contains(lower(name), '{t}') THEN 80 ELSE 0 END
          + CASE WHEN {dom} = '' THEN 0 WHEN {dom} = '{t}' THEN 90 WHEN contains({dom}, '{t}') THEN 70 ELSE 0 END
          + CASE WHEN starts_with(lower(tag1), '{t}') OR starts_with(lower(tag2), '{t}') THEN 60 ELSE 0 END
          + CASE WHEN contains(lower(category), '{t}') THEN 40 ELSE 0 END
          + CASE WHEN country IS NOT NULL AND contains(lower(country), '{t}') THEN 40 ELSE 0 END
          + CASE WHEN contains(lower(description), '{t}') THEN 20 ELSE 0 END""")
    return " + ".join(f"({x})" for x in total)


_SEARCH = f", s AS (SELECT *, {_score(['th', 'tech'])} AS score FROM t_dir)"


@query("fn_26_search_score", _SEARCH + " SELECT id, score FROM s WHERE score > 0")
def search_score(spark, sf):
    score = names.search_score("Th tech", F.col("name"), F.col("site_url"), F.col("tags"), F.col("category"),
                               F.col("country"), F.col("description"))
    return D.directory_feed(spark, sf).select("id", big(score, "score")).filter("score > 0")


@query("set_06_search", _SEARCH + """
, b AS (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY score DESC, pos) AS rn FROM s WHERE score > 0)
SELECT id, feed_url, score FROM b WHERE rn = 1 ORDER BY score DESC, pos LIMIT 20""")
def search(spark, sf):
    return X.search(D.directory_feed(spark, sf), "Th tech").select("id", "feed_url", big("score"))


@query("join_09_mark_subscribed", f"""
, subs AS (SELECT * FROM t_dir WHERE category = 'Science')
SELECT id, {_LIBNORM.format(c='feed_url')} IN (SELECT {_LIBNORM.format(c='feed_url')} FROM subs)
  OR coalesce({_LIBNORM.format(c='site_url')} IN (SELECT {_LIBNORM.format(c='site_url')} FROM subs WHERE site_url IS NOT NULL), false) AS is_subscribed
FROM t_dir""")
def mark_subscribed(spark, sf):
    d = D.directory_feed(spark, sf)
    return L.mark_subscribed(d, d.filter("category = 'Science'")).select("id", "is_subscribed")


@query("join_10_find_existing_source", f"""
, subs AS (SELECT *, {_LIBNORM.format(c='feed_url')} AS fk, {_LIBNORM.format(c='site_url')} AS sk FROM t_dir WHERE category = 'Science'),
f AS (SELECT fk, arg_min(id, (pos, id)) AS id FROM subs GROUP BY fk),
g AS (SELECT sk, arg_min(id, (pos, id)) AS id FROM subs WHERE site_url IS NOT NULL GROUP BY sk)
SELECT d.id, coalesce(f.id, g.id) AS existing_source_id, coalesce(f.id, g.id) IS NOT NULL AS is_duplicate FROM t_dir d
LEFT JOIN f ON f.fk = {_LIBNORM.format(c='d.feed_url')} LEFT JOIN g ON g.sk = {_LIBNORM.format(c='d.site_url')}""")
def find_existing_source(spark, sf):
    d = D.directory_feed(spark, sf)
    subs = d.filter("category = 'Science'").withColumn("sort_order", F.col("pos"))
    return L.find_existing_source(d, subs).select("id", "existing_source_id", "is_duplicate")


# ---- descriptions


def described(spark, sf):
    d = D.directory_feed(spark, sf)
    fetched = d.select("name", F.col("description").alias("og"), "pos")
    overrides = d.filter("country IS NOT NULL").groupBy("name").agg(
        F.max(F.expr("CASE WHEN country = 'Spain' THEN concat('About ', country) END")).alias("override"),
        F.bool_or(F.expr("country = 'Germany'")).alias("prefer_current"))
    return X.attach_descriptions(d, fetched, overrides)


_DESC = """, og AS (SELECT name, arg_max(description, pos) AS og FROM t_dir GROUP BY name),
ov AS (SELECT name, max(CASE WHEN country = 'Spain' THEN 'About Spain' END) AS override, bool_or(country = 'Germany') AS prefer
       FROM t_dir WHERE country IS NOT NULL GROUP BY name)"""


@query("join_14_attach_descriptions", _DESC + """
SELECT d.id, og.og, ov.override, coalesce(ov.prefer, false) AS prefer_current
FROM t_dir d LEFT JOIN og ON og.name = d.name LEFT JOIN ov ON ov.name = d.name""")
def attach_descriptions(spark, sf):
    return described(spark, sf).select("id", "og", "override", "prefer_current")


# Description texts of the given pages carry none of the boilerplate phrases, so the comparison
# covers choice, white space, the cut and the trailing punctuation.
_CUT = r"""CASE WHEN length({c}) > 120 THEN regexp_replace(regexp_replace(CASE WHEN
  length(substr({c}, 1, 120)) - length(regexp_extract(substr({c}, 1, 120), '([^ ]*)$', 1)) - 1 > 60
  THEN substr({c}, 1, length(substr({c}, 1, 120)) - length(regexp_extract(substr({c}, 1, 120), '([^ ]*)$', 1)) - 1)
  ELSE substr({c}, 1, 120) END, '[.,;: -]+$', ''), '[.]+$', '') ELSE regexp_replace({c}, '[.]+$', '') END"""


@query("fn_21_refine_description", _DESC + f""", r AS (SELECT d.id, trim(regexp_replace(
  CASE WHEN length(og.og) > 10 THEN og.og WHEN length(d.description) > 10 THEN d.description WHEN og.og <> '' THEN og.og ELSE d.description END,
  '\\s+', ' ', 'g')) AS raw FROM t_dir d LEFT JOIN og ON og.name = d.name)
SELECT id, {_CUT.format(c='raw')} AS refined FROM r""")
def refine_description(spark, sf):
    return described(spark, sf).select("id", T.refine_description(F.col("description"), F.col("og")).alias("refined"))


@query("fn_21_pick_description", _DESC + f""", r AS (SELECT d.id, ov.override, trim(regexp_replace(
  CASE WHEN coalesce(ov.prefer, false) AND length(d.description) > 10 THEN d.description
       WHEN length(og.og) > 15 AND NOT regexp_matches(lower(og.og), 'bonanza|gambling|casino|slot|suspect believed|get each month|responsive blogger|shah code exporters|brad feld|bruno rocha|latest updates read my|kicked off celebrations') THEN og.og
       WHEN length(d.description) > 5 THEN d.description WHEN og.og <> '' THEN og.og ELSE d.description END,
  '\\s+', ' ', 'g')) AS raw FROM t_dir d LEFT JOIN og ON og.name = d.name LEFT JOIN ov ON ov.name = d.name)
SELECT id, coalesce(override, {_CUT.format(c='raw')}) AS picked FROM r""")
def pick_description(spark, sf):
    return described(spark, sf).select("id", T.pick_description(
        F.col("name"), F.col("description"), F.col("og"), F.col("override"), F.col("prefer_current")).alias("picked"))


@query("agg_14_description_changes", _DESC + f""", r AS (SELECT d.id, d.description, og.og, trim(regexp_replace(
  CASE WHEN length(og.og) > 10 THEN og.og WHEN length(d.description) > 10 THEN d.description WHEN og.og <> '' THEN og.og ELSE d.description END,
  '\\s+', ' ', 'g')) AS raw FROM t_dir d LEFT JOIN og ON og.name = d.name)
SELECT count(*) AS total, count(*) FILTER (WHERE {_CUT.format(c='raw')} <> regexp_replace(trim(description), '[.]+$', '')) AS changed,
  count(*) FILTER (WHERE og <> '') AS found, count(*) FILTER (WHERE og IS NULL) AS missing FROM r""")
def description_changes(spark, sf):
    d = described(spark, sf).withColumn("refined", T.refine_description(F.col("description"), F.col("og")))
    return X.description_changes(d).select(big("total"), big("changed"), big("found"), big("missing"))
