"""Curating the feed directory: validity, quality, duplicates, search and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom import schema as S
from feedloom.functions import names, text as T, urls
from feedloom.operators.skew import first_per_key, lookup, top_k
from feedloom.sources.feeds import malformed_detail, parse_feeds, read_feed_check_items, site_url

# Topic order on the browse page, probe paths, and names that say nothing.
CATEGORY_ORDER = (
    "World News", "Tech", "AI", "Science", "Space", "Business & Finance", "Sports",
    "Health & Wellness", "Fitness", "Film & TV", "Music", "Gaming", "Anime",
    "Celebrity & Pop Culture", "Food", "Travel", "Books", "Fashion", "Beauty", "Photography",
    "History", "Personal Finance",
    "Apple", "Android", "Cars", "Motorcycles", "Boating", "Environment", "Architecture",
    "Home & Design", "DIY", "Humor & Satire", "Marketing",
    "Programming", "Mobile Development", "Web Design & UX",
)
LIBRARY_FEED_PATHS = (
    "/feed", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml",
    "/news/rss.xml", "/news/feed", "/blog/feed", "/blog/rss.xml",
)
LIBRARY_SUBDOMAIN_PATHS = ("/rss.xml", "/news/rss.xml")
DIRECTORY_FEED_PATHS = (
    "/feed", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml", "/feeds/all",
    "/feeds/rss", "/feeds.xml", "/news/rss.xml", "/news/feed", "/blog/feed", "/blog/rss.xml",
)
DIRECTORY_SUBDOMAIN_PATHS = ("", "/rss.xml", "/news/rss.xml")
SAMPLE_ARTICLES = 5


# ---- validity ------------------------------------------------------------------------


def feed_issue(log: DataFrame) -> DataFrame:
    """FLT-09: why a fetched feed is unusable, as struct(kind, detail); null when it is fine.

    Checks run in a fixed order and the first failure counts.
    """
    d = parse_feeds(log.withColumn("feed_url", F.col("url")).withColumn("xml", F.col("body")))
    status_ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    kind = (
        F.when(~status_ok, "unreachable")
        .when(urls.scheme(F.col("final_url")) == "http", "redirectsToHTTP")
        .when(~T.looks_like_feed(F.col("body")), "notAFeed")
        .when(F.col("doc.error").isNotNull(), "malformedXML")
    )
    d = d.withColumn("_kind", kind)
    detail = (
        F.when(F.col("_kind") == "unreachable", F.concat(F.lit("HTTP "), F.coalesce(F.col("status"), F.lit(0)).cast("string")))
        .when(F.col("_kind") == "redirectsToHTTP", F.col("final_url"))
        .when(F.col("_kind") == "malformedXML", malformed_detail())
    )
    return d.withColumn(
        "issue", F.when(F.col("_kind").isNotNull(), F.struct(F.col("_kind").alias("kind"), detail.alias("detail")))
    ).withColumn("is_valid", F.col("_kind").isNull()).drop("_kind")


def validate_feeds(log: DataFrame) -> DataFrame:
    """Validation result per fetched feed: validity, issue, newest date, addresses, site."""
    return validated_facts(feed_issue(log))


def validated_facts(checked: DataFrame) -> DataFrame:
    """The facts of feeds that ``feed_issue`` has looked at."""
    good = checked.filter("is_valid")
    facts = read_feed_check_items(good).join(site_url(good).withColumnRenamed("site_url", "found_site_url"), "feed_url")
    return checked.select("feed_url", "is_valid", "issue").join(facts, "feed_url", "left")


def is_recently_verified(last_verified: Column, today: Column) -> Column:
    """FLT-10."""
    return F.coalesce(last_verified >= F.date_sub(today, S.RECENTLY_VERIFIED_DAYS), F.lit(False))


def is_stale(newest: Column, now: Column) -> Column:
    """FLT-11: feeds without dates are kept."""
    return F.coalesce(newest < F.add_months(now, -S.STALE_FEED_MONTHS), F.lit(False))


def directory_lint(feeds: DataFrame) -> DataFrame:
    """FLT-16: violations as (id, rule)."""
    d = feeds.withColumn("_key", F.lower("feed_url"))
    repeated_urls = d.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated_ids = d.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select(
        "id", F.lit("duplicate_id").alias("rule"))
    rules = F.filter(F.array(
        F.when(~F.coalesce(F.col("feed_url").startswith("https://"), F.lit(False)), "insecure_feed_url"),
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "empty_name"),
        F.when(F.trim(F.coalesce("category", F.lit(""))) == "", "empty_category"),
        F.when(F.lower("name").rlike(r"^(?:rss|feed|rss feed|blog|news)(?: -| \||:|$)"), "generic_name"),
    ), lambda r: r.isNotNull())
    simple = d.select("id", F.explode(rules).alias("rule"))
    twice = lookup(d.select("id", "_key"), repeated_urls, ["_key"], "inner", "id").select(
        "id", F.lit("duplicate_url").alias("rule"))
    return simple.unionByName(twice).unionByName(repeated_ids)


def feed_cdn_sites(feeds: DataFrame) -> DataFrame:
    """FLT-15."""
    return feeds.filter(urls.is_feed_cdn_site(F.col("site_url")))


# ---- candidates ----------------------------------------------------------------------


def union_candidates(topics: DataFrame, countries: DataFrame) -> DataFrame:
    """SET-01: topic and country feeds, duplicates kept, topics first."""
    return topics.withColumn("part", F.lit(0)).unionByName(countries.withColumn("part", F.lit(1)))


def distinct_urls(feeds: DataFrame, order: list[Column]) -> DataFrame:
    """SET-02: first feed per normalized address. Minima pre-aggregate, hot keys included."""
    d = feeds.withColumn("_key", urls.normalize_feed_url(F.col("feed_url")))
    return first_per_key(d, ["_key"], order, feeds.columns).select(*feeds.columns)


def distinct_sites(feeds: DataFrame, order: list[Column]) -> DataFrame:
    """SET-03: first feed per (domain, simplified name). Feeds without a host all stay."""
    d = names.with_simple_name(feeds, "name", "feed_url", "_simple")
    host = urls.host(F.col("feed_url"))
    d = d.withColumn("_host", F.replace(host, F.lit("www."), F.lit("")))
    keyed = d.filter(host != "").withColumn("_name", T.trim_ws(F.lower("_simple")))
    kept = first_per_key(keyed, ["_host", "_name"], order, feeds.columns).select(*feeds.columns)
    return kept.unionByName(d.filter(host == "").select(*feeds.columns))


def not_in_master(candidates: DataFrame, directory: DataFrame) -> DataFrame:
    """JOIN-08 and SET-04: candidates whose normalized address the directory lacks."""
    known = directory.select(urls.normalize_feed_url(F.col("feed_url")).alias("_key")).distinct()
    return candidates.withColumn("_key", urls.normalize_feed_url(F.col("feed_url"))).join(
        known, "_key", "left_anti").drop("_key")


def discover_candidates(topics: DataFrame, countries: DataFrame, directory: DataFrame) -> DataFrame:
    """New directory candidates from topic and country lists (name, feed_url, pos)."""
    order = [F.col("part"), F.col("pos")]
    unique = distinct_sites(distinct_urls(union_candidates(topics, countries), order), order)
    return not_in_master(unique, directory)


def feed_candidates(sites: DataFrame, library: bool = False) -> DataFrame:
    """Addresses to probe per site, best first: declared link, usual paths, feeds host.

    ``sites`` has ``id``, ``site_url`` and ``declared`` (null where the page names no feed).
    """
    paths = LIBRARY_FEED_PATHS if library else DIRECTORY_FEED_PATHS
    sub = LIBRARY_SUBDOMAIN_PATHS if library else DIRECTORY_SUBDOMAIN_PATHS
    base = F.concat(urls.scheme(F.col("site_url")), F.lit("://"), urls.authority(F.col("site_url")))
    feeds = F.concat(urls.scheme(F.col("site_url")), F.lit("://feeds."),
                     F.replace(urls.host(F.col("site_url")), F.lit("www."), F.lit("")))
    d = sites.withColumn("_base", base).withColumn("_feeds", feeds)
    tries = F.array(
        F.col("declared"), *[F.concat("_base", F.lit(p)) for p in paths],
        *[F.concat("_feeds", F.lit(p)) for p in sub],
    )
    return d.select("id", F.posexplode(tries).alias("priority", "url")).filter(F.col("url").isNotNull())


def probe_feeds(candidates: DataFrame, valid: DataFrame) -> DataFrame:
    """JOIN-15: the first candidate per site that is a valid feed. ``valid`` has ``url``."""
    hits = candidates.join(valid.select("url").distinct(), "url")
    return hits.groupBy("id").agg(F.min_by("url", "priority").alias("found_url"))


# ---- quality -------------------------------------------------------------------------


def sample_articles(items: DataFrame, k: int = SAMPLE_ARTICLES) -> DataFrame:
    """WIN-19: the first ``k`` items of each feed."""
    return top_k(items, ["feed_url"], [F.col("pos")], k)


def feed_quality(signal: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """AGG-04: integer medians over at most five sampled pages and the verdict.

    ``signal`` has feed_url, word_count, image_count and paywall_score, one row per page that
    could be fetched. ``feeds`` adds feeds without any such page, which are not acceptable.
    An even sample takes the lower middle of the mean, as integer division does.
    """
    med = lambda c: F.floor(F.percentile(F.col(c), F.lit(0.5))).cast("int")
    q = signal.groupBy("feed_url").agg(
        F.count("*").alias("sampled"), med("word_count").alias("words"),
        med("image_count").alias("images"), med("paywall_score").alias("paywall"),
    )
    if feeds is not None:
        q = feeds.select("feed_url").distinct().join(q, "feed_url", "left")
    n = F.coalesce("sampled", F.lit(0))
    w, i, p = F.col("words"), F.col("images"), F.col("paywall")
    reason = (
        F.when(n < 1, "blocked").when(n < 2, "too_few").when(w < 100, "very_thin")
        .when((w < 200) & (p >= 3), "paywalled").when((w < 200) & (i < 3), "thin")
        .when(w < 200, "image_rich").otherwise("ok")
    )
    judged = n >= 2
    return q.withColumn("reason", reason).select(
        "feed_url", n.alias("sampled"),
        F.when(judged, w).otherwise(0).alias("median_words"), F.when(judged, i).otherwise(0).alias("median_images"),
        F.when(judged, p).otherwise(0).alias("median_paywall"), "reason",
        F.col("reason").isin("too_few", "image_rich", "ok").alias("is_acceptable"),
    )


# ---- audit ---------------------------------------------------------------------------


def audit(directory: DataFrame, first: DataFrame, retry: DataFrame, quality: DataFrame, today: Column) -> DataFrame:
    """SET-05 and SET-08: outcome of every directory feed.

    ``first`` and ``retry`` are validation results by feed_url (is_valid, newest_item_date,
    found_site_url). Outcomes: ``auto`` (verified lately), ``valid``, ``recovered``, ``dead``,
    ``stale``. Thin feeds are kept, with ``thin`` set.
    """
    f = first.select("feed_url", F.col("is_valid").alias("_v1"), F.col("newest_item_date").alias("_d1"), F.col("found_site_url").alias("_s1"))
    r = retry.select("feed_url", F.col("is_valid").alias("_v2"), F.col("newest_item_date").alias("_d2"), F.col("found_site_url").alias("_s2"))
    q = quality.select("feed_url", (~F.col("is_acceptable")).alias("_thin"))
    # Results are one row per address, the directory may list an address many times.
    d = directory
    for side in (f, r, q):
        d = lookup(d, side, ["feed_url"], "left", "id")
    auto = is_recently_verified(F.col("last_verified"), today)
    ok1, ok2 = F.coalesce("_v1", F.lit(False)), F.coalesce("_v2", F.lit(False))
    newest = F.when(ok1, F.col("_d1")).when(ok2, F.col("_d2"))
    d = d.withColumn("_auto", auto).withColumn("newest_item_date", F.when(~F.col("_auto"), newest))
    stale = is_stale(F.col("newest_item_date"), today)
    outcome = (
        F.when(F.col("_auto"), "auto").when(stale, "stale").when(ok1, "valid").when(ok2, "recovered").otherwise("dead")
    )
    found = F.when(ok1, F.col("_s1")).when(ok2, F.col("_s2"))
    d = d.withColumn("outcome", outcome).withColumn("site_url", F.coalesce("site_url", found))
    kept = F.col("outcome").isin("auto", "valid", "recovered")
    return (
        d.withColumn("kept", kept)
        .withColumn("thin", F.col("outcome").isin("valid", "recovered") & F.coalesce("_thin", F.lit(False)))
        .withColumn("verified_now", ~F.col("_auto") & (ok1 | ok2))
        .drop("_v1", "_d1", "_s1", "_v2", "_d2", "_s2", "_thin", "_auto")
    )


def removal_reasons(audited: DataFrame) -> DataFrame:
    """SET-08: dead, stale and thin feeds with their reason; thin ones stay published."""
    out = audited.filter(F.col("outcome").isin("dead", "stale")).select("id", F.col("outcome").alias("reason"))
    return out.unionByName(audited.filter("thin").select("id", F.lit("thin").alias("reason")))


def directory_report(audited: DataFrame) -> DataFrame:
    """AGG-07: feeds by category and outcome, with totals (null) on both levels."""
    return audited.cube("category", "outcome").agg(
        F.count("*").alias("feeds"), F.count_if("thin").alias("thin"), F.grouping_id().alias("level")
    ).orderBy("level", F.col("feeds").desc(), "category", "outcome")


def validation_totals(audited: DataFrame) -> DataFrame:
    """AGG-08: valid and invalid counts of the checked feeds, per category and overall."""
    checked = audited.filter(F.col("outcome") != "auto")
    valid = F.col("outcome") != "dead"
    return checked.rollup("category").agg(
        F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.grouping("category").alias("is_total")
    )


def stamp_verified(directory: DataFrame, verified: DataFrame, today: Column) -> DataFrame:
    """UPD-14: today's date on the feeds that passed; others keep theirs."""
    hit = verified.select("feed_url", F.lit(True).alias("_hit")).distinct()
    d = lookup(directory, hit, ["feed_url"], "left", "id")
    return d.withColumn("last_verified", F.when(F.col("_hit"), today).otherwise(F.col("last_verified"))).drop("_hit")


def verify_directory(directory: DataFrame, checks: DataFrame, found: DataFrame) -> DataFrame:
    """UPD-13: repair or remove broken feeds.

    ``checks`` has feed_url, attempt and is_valid (two attempts at most); ``found`` has id and
    ``found_url``, the probe's answer. Verdicts: ``ok``, ``fixed`` (new address, verification
    date dropped, site kept) and ``removed`` (nothing found, or the same address again).
    """
    passed = checks.groupBy("feed_url").agg(F.bool_or("is_valid").alias("_ok"))
    d = lookup(directory, passed, ["feed_url"], "left", "id").join(found, "id", "left")
    other = urls.normalize_feed_url(F.col("found_url")) != urls.normalize_feed_url(F.col("feed_url"))
    verdict = F.when(F.coalesce("_ok", F.lit(False)), "ok").when(F.coalesce(other, F.lit(False)), "fixed").otherwise("removed")
    d = d.withColumn("verdict", verdict)
    fixed = F.col("verdict") == "fixed"
    return (
        d.withColumn("old_url", F.col("feed_url"))
        .withColumn("feed_url", F.when(fixed, F.col("found_url")).otherwise(F.col("feed_url")))
        .withColumn("last_verified", F.when(~fixed, F.col("last_verified")))
        .drop("_ok", "found_url")
    )


# ---- browse and search ---------------------------------------------------------------


def category_counts(directory: DataFrame) -> DataFrame:
    """AGG-06: feeds per category; one feed with a country makes it a country."""
    return directory.groupBy("category").agg(
        F.count("*").alias("feed_count"), F.bool_or(F.col("country").isNotNull()).alias("is_country")
    )


def ordered_categories(counts: DataFrame) -> DataFrame:
    """SORT-06: topics in curated order, unknown ones last; countries by name."""
    rank = F.lit(len(CATEGORY_ORDER))
    for i, name in enumerate(CATEGORY_ORDER):
        rank = F.when(F.col("category") == name, i).otherwise(rank)
    d = counts.withColumn("category_rank", F.when(F.col("is_country"), len(CATEGORY_ORDER)).otherwise(rank))
    return d.orderBy("is_country", "category_rank", F.collate(F.col("category"), "UNICODE_CI"))


def feeds_in(directory: DataFrame, category: str) -> DataFrame:
    """SORT-05: the feeds of a category by name, without regard to case."""
    return directory.filter(F.col("category") == category).orderBy(F.collate(F.col("name"), "UNICODE_CI"), "id")


def search(directory: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """FN-26 and SET-06: best matches; an address listed twice counts with its best score."""
    score = names.search_score(
        query, F.col("name"), F.col("site_url"), F.col("tags"), F.col("category"), F.col("country"), F.col("description")
    )
    hits = directory.withColumn("score", score).filter("score > 0")
    best = first_per_key(hits, ["feed_url"], [-F.col("score"), F.col("pos")], ["id", "name", "score", "pos"])
    return best.orderBy(F.col("score").desc(), "pos").limit(limit)


# ---- descriptions --------------------------------------------------------------------


def attach_descriptions(directory: DataFrame, fetched: DataFrame, overrides: DataFrame) -> DataFrame:
    """JOIN-14: the last fetched text per name, and the manual override where there is one.

    ``overrides`` has name, ``override`` and ``prefer_current``.
    """
    last = fetched.groupBy("name").agg(F.max_by("og", "pos").alias("og"))
    d = lookup(directory, last, ["name"], "left", "id")
    return lookup(d, overrides, ["name"], "left", "id").withColumn(
        "prefer_current", F.coalesce("prefer_current", F.lit(False))
    )


def description_changes(refined: DataFrame) -> DataFrame:
    """AGG-14: how many descriptions change, were found, or failed."""
    before = F.regexp_replace(T.trim_ws(F.coalesce("description", F.lit(""))), r"\.+$", "")
    return refined.agg(
        F.count("*").alias("total"), F.count_if(F.col("refined") != before).alias("changed"),
        F.count_if(F.coalesce(F.col("og") != "", F.lit(False))).alias("found"),
        F.count_if(F.col("og").isNull()).alias("missing"),
    )
