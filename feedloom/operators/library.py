"""Reading lists, counts and lookups over the article library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom import schema as S
from feedloom.functions import urls
from feedloom.operators.skew import first_per_key, lookup, rank_within, top_k

# Rows shown per display size, and the slide show of one refresh window.
DISPLAY_ROWS = {
    "small": 5, "medium": 8, "large": 10, "extra_large": 10,
    "rectangular": 3, "circular": 1, "inline": 3, "corner": 1,
}
SLOT_SECONDS = 10
WINDOW_MINUTES = 30
CAROUSEL_SIZE = 30
ALL_SOURCES = "all"


def readable(article: DataFrame) -> DataFrame:
    """FLT-04: articles with stored content."""
    return article.filter(F.col("fetch_status").isin(*S.READABLE))


def visible_sources(source: DataFrame) -> DataFrame:
    """FLT-05: every source but the hidden one, in list order."""
    return source.filter(F.col("id") != S.SAVED_PAGES_ID).orderBy("sort_order", "id")


def stale_sources(source: DataFrame, now: Column) -> DataFrame:
    """FLT-12: never fetched, or fetched more than an hour ago."""
    return source.filter(
        F.col("last_fetched_at").isNull() | (F.col("last_fetched_at") < now - F.expr(S.STALE_AFTER))
    )


def article_search(article: DataFrame, q: str) -> DataFrame:
    """FLT-13: case-insensitive title search; failed articles stay hidden."""
    return article.filter(
        (F.col("fetch_status") != "failed") & F.lower("title").contains(q.lower())
    )


def attach_names(article: DataFrame, source: DataFrame) -> DataFrame:
    """JOIN-07: source title and cache level for every article."""
    names = source.select(
        F.col("id").alias("source_id"), F.col("title").alias("source_title"),
        F.coalesce("cache_level", F.lit("standard")).alias("cache_level"),
    )
    return lookup(article, names, ["source_id"], "left", "id")


def saved_search(article: DataFrame, source: DataFrame, q: str) -> DataFrame:
    """FLT-14: saved articles whose title or attribution contains the text."""
    saved = attach_names(article.filter("is_saved"), source)
    name = F.coalesce(F.nullif("original_source_name", F.lit("")), "source_title")
    return saved.withColumn("attribution", name).filter(
        F.lower("title").contains(q.lower())
        | F.coalesce(F.lower("attribution").contains(q.lower()), F.lit(False))
    )


def due_sources(source: DataFrame, mode: str, trigger: str, now: Column) -> DataFrame:
    """FLT-18: which sources a run may refresh under the global refresh mode."""
    shown = source.filter(F.col("id") != S.SAVED_PAGES_ID)
    allowed = {
        ("automatic", "resume"): stale_sources(shown, now),
        ("automatic", "background"): shown,
        ("on_open", "launch"): shown,
    }
    return allowed.get((mode, trigger), shown.filter(F.lit(False)))


def sources_by_id(source: DataFrame, ids: list[str]) -> DataFrame:
    """FLT-20: chosen sources in list order; the sentinel stands for all of them."""
    shown = source.filter(F.col("id") != S.SAVED_PAGES_ID)
    if ALL_SOURCES not in ids:
        shown = shown.filter(F.col("id").isin(*ids))
    return shown.orderBy("sort_order", "id")


# ---- joins ---------------------------------------------------------------------------


def articles_with_source(
    article: DataFrame, source: DataFrame, k: int, source_id: str | None = None,
    require_thumbnail: bool = True,
) -> DataFrame:
    """JOIN-04: newest readable articles with their source name, at most ``k``."""
    picked = readable(article)
    if require_thumbnail:
        picked = picked.filter(F.col("thumbnail_url").isNotNull())
    if source_id is None:
        picked = picked.filter(F.col("source_id") != S.SAVED_PAGES_ID)
    else:
        picked = picked.filter(F.col("source_id") == source_id)
    names = source.select(F.col("id").alias("source_id"), F.col("title").alias("source_name"))
    return lookup(picked, names, ["source_id"], "inner", "id").orderBy(*newest_first()).limit(k)


def articles_with_source_and_page(
    article: DataFrame, source: DataFrame, page: DataFrame, k: int = 5
) -> DataFrame:
    """JOIN-05: as above, with the level of the stored page where there is one."""
    names = source.select(F.col("id").alias("source_id"), F.col("title").alias("source_name"))
    level = page.select(F.col("article_id").alias("id"), F.col("cache_level_used"))
    shown = readable(article).filter(F.col("source_id") != S.SAVED_PAGES_ID)
    # The limit runs before the page lookup: at most one page exists per article.
    top = lookup(shown, names, ["source_id"], "inner", "id").orderBy(*newest_first()).limit(k)
    return top.join(level, "id", "left").orderBy(*newest_first())


def storage_by_source(page: DataFrame, article: DataFrame, source: DataFrame) -> DataFrame:
    """JOIN-06: stored bytes per source, in source order, and one total row."""
    owner = article.select(F.col("id").alias("article_id"), "source_id")
    per_source = (
        page.join(owner, "article_id").groupBy("source_id")
        .agg(F.sum("total_size_bytes").alias("bytes")).filter("bytes > 0")
    )
    named = per_source.join(
        source.select(F.col("id").alias("source_id"), "title", "sort_order"), "source_id"
    )
    total = per_source.agg(F.sum("bytes").alias("bytes")).select(
        F.lit(None).cast("string").alias("source_id"), "bytes",
        F.lit("total").alias("title"), F.lit(None).cast("int").alias("sort_order"),
    )
    return named.unionByName(total).orderBy(F.col("sort_order").asc_nulls_last())


def mark_subscribed(directory: DataFrame, source: DataFrame) -> DataFrame:
    """JOIN-09: directory feeds whose feed or site address is already subscribed."""
    def keys(col: str, out: str) -> DataFrame:
        return (
            source.filter(F.col(col).isNotNull())
            .select(urls.normalize_url(F.col(col)).alias(out)).distinct()
            .withColumn(f"{out}_hit", F.lit(True))
        )

    d = directory.withColumn("_f", urls.normalize_url(F.col("feed_url"))).withColumn(
        "_s", urls.normalize_url(F.coalesce("site_url", F.lit("")))
    )
    d = lookup(d, keys("feed_url", "_f"), ["_f"], "left", "id")
    d = lookup(d, keys("site_url", "_s"), ["_s"], "left", "id")
    flag = F.coalesce(F.col("_f_hit"), F.col("_s_hit"), F.lit(False))
    return d.withColumn("is_subscribed", flag).drop("_f", "_s", "_f_hit", "_s_hit")


def find_existing_source(feed: DataFrame, source: DataFrame) -> DataFrame:
    """JOIN-10: the source a feed duplicates. A feed-address match beats a site match."""
    def first_by(col: str, out: str) -> DataFrame:
        return first_per_key(
            source.filter(F.col(col).isNotNull())
            .withColumn(out, urls.normalize_url(F.col(col))),
            [out], [F.col("sort_order"), F.col("id")], ["id"],
        ).withColumnRenamed("id", f"{out}_id")

    d = feed.withColumn("_f", urls.normalize_url(F.col("feed_url"))).withColumn(
        "_s", urls.normalize_url(F.coalesce("site_url", F.lit("")))
    )
    d = lookup(d, first_by("feed_url", "_f"), ["_f"], "left", "id")
    d = lookup(d, first_by("site_url", "_s"), ["_s"], "left", "id")
    return (
        d.withColumn("existing_source_id", F.coalesce("_f_id", "_s_id"))
        .withColumn("is_duplicate", F.col("existing_source_id").isNotNull())
        .drop("_f", "_s", "_f_id", "_s_id")
    )


def orphan_assets(asset_pool: DataFrame, page: DataFrame) -> DataFrame:
    """JOIN-11: stored assets that no page's manifest names."""
    used = page.select(F.explode("asset_manifest").alias("asset_key")).distinct()
    return asset_pool.join(used, "asset_key", "left_anti")


def missing_content(article: DataFrame, content: DataFrame) -> DataFrame:
    """JOIN-12: readable articles whose stored text is absent or below 50 characters."""
    have = content.select(F.col("article_id").alias("id"), "content_chars")
    return readable(article).join(have, "id", "left").filter(
        F.coalesce("content_chars", F.lit(0)) < S.MIN_CONTENT_CHARS
    )


def missing_icons(source: DataFrame, icon: DataFrame) -> DataFrame:
    """JOIN-18: sources that name an icon which is not stored yet."""
    stored = icon.select(F.col("source_id").alias("id")).distinct()
    return source.filter(F.col("icon_url").isNotNull()).join(stored, "id", "left_anti")


# ---- aggregates ----------------------------------------------------------------------


def source_summary(article: DataFrame, cap: int = S.DEFAULT_ARTICLE_LIMIT) -> DataFrame:
    """AGG-01: readable count, unread count (both capped for display) and minutes per source."""
    return (
        readable(article).groupBy("source_id")
        .agg(
            F.least(F.count("*"), F.lit(cap)).alias("article_count"),
            F.least(F.count_if(~F.col("is_read")), F.lit(cap)).alias("unread_count"),
            F.coalesce(F.sum("reading_minutes"), F.lit(0)).alias("reading_minutes_total"),
        )
    )


def library_totals(article: DataFrame) -> DataFrame:
    """AGG-02: readable articles outside the hidden source, and whether anything is saved."""
    shown = F.col("fetch_status").isin(*S.READABLE) & (F.col("source_id") != S.SAVED_PAGES_ID)
    return article.agg(
        F.count_if(shown).alias("readable_count"),
        F.coalesce(F.bool_or("is_saved"), F.lit(False)).alias("has_saved"),
    )


def saved_summary(article: DataFrame, k: int = 5) -> DataFrame:
    """AGG-03: the newest saved articles, each with the count of all saved ones."""
    saved = article.filter("is_saved")
    total = saved.agg(F.count("*").alias("saved_total"))
    moment = F.coalesce("saved_at", "added_at")
    newest = (
        saved.select("id", "title", moment.alias("saved_moment"))
        .orderBy(F.col("saved_moment").desc(), "id").limit(k)
    )
    # Both sides are bounded: k rows and one row. The keyed join avoids a product.
    return (
        newest.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
        .drop("_one")
    )


def refresh_outcome(source_run: DataFrame) -> DataFrame:
    """AGG-09: a run is offline when it touched sources and every one of them failed."""
    failed = F.count_if(F.col("status") == "failed")
    return source_run.groupBy("run_id").agg(
        F.count("*").alias("sources"), failed.alias("failed"),
        ((failed == F.count("*")) & (F.count("*") > 0)).alias("offline"),
    )


# ---- windows and rankings ------------------------------------------------------------


def newest_first(tie: str = "id") -> list[Column]:
    """SORT-01: the standard order, with an id so that ties repeat."""
    return [S.newest().desc(), F.col(tie)]


def top_per_source(article: DataFrame, k: int = S.VISIBLE_ARTICLES) -> DataFrame:
    """WIN-08: newest readable articles of each source."""
    return top_k(readable(article), ["source_id"], newest_first(), k)


def balanced_latest(article: DataFrame, n: int = CAROUSEL_SIZE) -> DataFrame:
    """WIN-04: newest illustrated articles, one source after another.

    No source can contribute more than ``n`` rows, so the rank is limited before the
    shuffle; the sources' own order comes from their first row.
    """
    shown = readable(article).filter(
        (F.col("source_id") != S.SAVED_PAGES_ID) & F.col("thumbnail_url").isNotNull()
    ).withColumn("moment", S.newest())
    ranked = top_k(shown, ["source_id"], [F.col("moment").desc(), F.col("id")], n, "turn")
    lead = F.max("moment").over(Window.partitionBy("source_id"))
    return (
        ranked.withColumn("source_newest", lead)
        .orderBy("turn", F.col("source_newest").desc(), "source_id")
        .limit(n)
    )


def ranked_list(shown: DataFrame, rank: str = "rn") -> DataFrame:
    """A list of any length with its ranks, newest first, without one task for all rows."""
    return rank_within(shown.withColumn("_all", F.lit(1)), "_all", newest_first(), rank).drop("_all")


def carousel_slots(shown: DataFrame, start: Column, rank: str = "rn") -> DataFrame:
    """WIN-17: the rotated list for every ten-second slot of one refresh window.

    ``shown`` is a display list with a 1-based rank. Positions are cyclic: they need the list's
    length, one number, and nothing of other rows.
    """
    slots = WINDOW_MINUTES * 60 // SLOT_SECONDS
    length = shown.agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    return (
        shown.withColumn("_one", F.lit(1)).join(length, "_one")  # with one row: as a keyed join, not a product
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        .withColumn("slot_position", F.pmod(F.col(rank) - 1 - F.col("slot"), F.col("_n")).cast("int"))
        .withColumn("slot_at", start + F.make_dt_interval(secs=F.col("slot") * SLOT_SECONDS))
        .drop("_n", "_one")
    )


def renumber_sources(source: DataFrame, owner: str, desired: list[Column]) -> DataFrame:
    """WIN-18: dense list order per owner after a move; an owner has at most 25 sources."""
    w = Window.partitionBy(owner).orderBy(*desired)
    return source.withColumn("sort_order", F.row_number().over(w) - 1)


def insert_at_top(source: DataFrame, added: DataFrame) -> DataFrame:
    """WIN-18: the new source takes position 0, the visible others move down by one."""
    moved = source.withColumn(
        "sort_order",
        F.when(F.col("id") == S.SAVED_PAGES_ID, F.col("sort_order")).otherwise(F.col("sort_order") + 1),
    )
    return moved.unionByName(added.withColumn("sort_order", F.lit(0)), allowMissingColumns=True)


# ---- sorted lists --------------------------------------------------------------------


def saved_order(article: DataFrame, coalesced: bool = False) -> DataFrame:
    """SORT-02: saved articles, by save moment then arrival, or by either of the two."""
    saved = article.filter("is_saved")
    if coalesced:
        return saved.orderBy(F.coalesce("saved_at", "added_at").desc(), "id")
    return saved.orderBy(F.col("saved_at").desc_nulls_last(), F.col("added_at").desc(), "id")


def saved_carousel(article: DataFrame, k: int = 10) -> DataFrame:
    """SORT-03: most recently saved articles with a picture."""
    ok = (F.col("fetch_status") != "failed") & F.col("thumbnail_url").isNotNull()
    return saved_order(article.filter(ok)).limit(k)


def after_first(article: DataFrame, n: int) -> DataFrame:
    """SORT-04: everything past the newest ``n``."""
    return article.orderBy(*newest_first()).offset(n)


def drawer_list(article: DataFrame, source_id: str | None) -> DataFrame:
    """SORT-07: the full side list, of the saved context or of one source."""
    shown = readable(article)
    if source_id is None:
        return saved_order(shown)
    return shown.filter(F.col("source_id") == source_id).orderBy(*newest_first())


def display_list(article: DataFrame, source: DataFrame, size: str) -> DataFrame:
    """SORT-08: as many rows as a display size shows; small accessories need no picture."""
    accessory = size in ("rectangular", "circular", "inline", "corner")
    return articles_with_source(
        article, source, DISPLAY_ROWS[size], require_thumbnail=not accessory
    )


def effective_settings(source: DataFrame) -> DataFrame:
    """FN-29: settings with their defaults, and the topic-feed flag."""
    out = source
    defaults = {
        "cache_level": "standard", "appearance_mode": "system",
        "layout": "list", "home_layout": "list",
    }
    for col, value in defaults.items():
        out = out.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
    return out.withColumn("is_topic_feed", F.col("feed_url").contains(urls.AGGREGATOR_HOST))


def library_path(article_id: Column, root: str) -> Column:
    """SRC-11: where an article's page lives; derived, never stored."""
    return F.concat(F.lit(root.rstrip("/") + "/articles/"), article_id, F.lit("/index.html"))
