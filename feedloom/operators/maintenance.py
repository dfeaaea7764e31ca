"""Pruning, repair, deletion and user-driven changes of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom import schema as S
from feedloom.functions import text, urls
from feedloom.operators.library import missing_content
from feedloom.operators.skew import beyond_top_k, first_per_key, lookup


def prune_excess(
    article: DataFrame, source: DataFrame, limit: int = S.DEFAULT_ARTICLE_LIMIT
) -> DataFrame:
    """WIN-05: readable rows past the newest ``limit`` of a source.

    ``action`` is ``delete`` for unsaved rows and ``detach`` for saved ones, which move to the
    hidden source and keep, or get, their attribution. Uncached rows do not count.
    """
    pool = article.filter(
        F.col("fetch_status").isin(*S.READABLE) & (F.col("source_id") != S.SAVED_PAGES_ID)
    ).withColumn("moment", S.newest())
    excess = beyond_top_k(pool, ["source_id"], "moment", "id", limit)
    return _detach(
        excess.withColumn("action", F.when(F.col("is_saved"), "detach").otherwise("delete")),
        source, F.col("action") == "detach",
    ).drop("moment")


def _detach(df: DataFrame, source: DataFrame, cond: Column) -> DataFrame:
    """Move rows to the hidden source where ``cond`` holds, stamping the attribution."""
    names = source.select(
        F.col("id").alias("source_id"), F.col("title").alias("_title"), F.col("icon_url").alias("_icon")
    )
    d = lookup(df, names, ["source_id"], "left", "id")
    return (
        d.withColumn("original_source_name",
                     F.when(cond, F.coalesce("original_source_name", "_title"))
                     .otherwise(F.col("original_source_name")))
        .withColumn("original_source_icon_url",
                    F.when(cond, F.coalesce("original_source_icon_url", "_icon"))
                    .otherwise(F.col("original_source_icon_url")))
        .withColumn("former_source_id", F.col("source_id"))
        .withColumn("source_id", F.when(cond, F.lit(S.SAVED_PAGES_ID)).otherwise(F.col("source_id")))
        .drop("_title", "_icon")
    )


def prune_pending(article: DataFrame, limit: int = S.DEFAULT_ARTICLE_LIMIT) -> DataFrame:
    """WIN-06: uncached rows past the newest ``limit`` of a source; all are deleted."""
    pool = article.filter(
        F.col("fetch_status").isin(*S.UNCACHED) & (F.col("source_id") != S.SAVED_PAGES_ID)
    ).withColumn("moment", S.newest())
    return beyond_top_k(pool, ["source_id"], "moment", "id", limit).drop("moment")


def status_rank(status: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in S.STATUS_RANK.items():
        rank = F.when(status == name, F.lit(value)).otherwise(rank)
    return rank


def title_keepers(article: DataFrame) -> DataFrame:
    """The row to keep per (source, title): best status, then oldest, then smallest id."""
    order = [-status_rank(F.col("fetch_status")), F.col("added_at"), F.col("id")]
    return first_per_key(article, ["source_id", "title"], order, ["id"])


def dedup_titles(article: DataFrame) -> DataFrame:
    """WIN-07: one article per title within a source."""
    return article.join(title_keepers(article).select("id"), "id", "left_semi")


def reset_stuck(article: DataFrame) -> DataFrame:
    """UPD-05: interrupted fetches wait again."""
    return article.withColumn(
        "fetch_status",
        F.when(F.col("fetch_status") == "fetching", "pending").otherwise(F.col("fetch_status")),
    )


def reset_missing(article: DataFrame, content: DataFrame) -> DataFrame:
    """UPD-06: readable articles without usable content wait again."""
    have = content.select(F.col("article_id").alias("id"), F.col("content_chars").alias("_chars"))
    d = article.join(have, "id", "left")
    gone = F.col("fetch_status").isin(*S.READABLE) & (F.coalesce("_chars", F.lit(0)) < S.MIN_CONTENT_CHARS)
    return d.withColumns({
        "fetch_status": F.when(gone, "pending").otherwise(F.col("fetch_status")),
        "cached_at": F.when(~F.coalesce(gone, F.lit(False)), F.col("cached_at")),
        "cache_size_bytes": F.when(~F.coalesce(gone, F.lit(False)), F.col("cache_size_bytes")),
    }).drop("_chars")


def drop_lost_pages(page: DataFrame, article: DataFrame, content: DataFrame) -> DataFrame:
    lost = missing_content(article, content).select(F.col("id").alias("article_id"))
    return page.join(lost, "article_id", "left_anti")


def orphan_saved(article: DataFrame) -> DataFrame:
    """UPD-07: rows of the hidden source that nobody saved."""
    return article.filter((F.col("source_id") == S.SAVED_PAGES_ID) & ~F.col("is_saved"))


def delete_orphan_saved(article: DataFrame) -> DataFrame:
    return article.filter(~((F.col("source_id") == S.SAVED_PAGES_ID) & ~F.col("is_saved")))


def integrity_job(
    article: DataFrame, page: DataFrame, content: DataFrame, asset_pool: DataFrame
) -> dict[str, DataFrame]:
    """UPD-15: start-up repair, each step a transform over the step before."""
    step = dedup_titles(reset_stuck(article))
    repaired = delete_orphan_saved(reset_missing(step, content))
    kept = page.join(
        repaired.filter(F.col("fetch_status").isin(*S.READABLE))
        .select(F.col("id").alias("article_id")),
        "article_id", "left_semi",
    )
    used = kept.select(F.explode("asset_manifest").alias("asset_key")).distinct()
    return {
        "article": repaired,
        "cached_page": kept,
        "asset_pool": asset_pool.join(used, "asset_key", "left_semi"),
    }


# ---- deletion ------------------------------------------------------------------------


def cascade_delete(
    deleted: DataFrame, source: DataFrame, article: DataFrame, page: DataFrame
) -> dict[str, DataFrame]:
    """JOIN-13: rows that survive when sources, with all they own, go."""
    ids = deleted.select(F.col("id").alias("source_id")).distinct()
    kept = article.join(ids, "source_id", "left_anti")
    return {
        "source": source.join(deleted.select("id").distinct(), "id", "left_anti"),
        "article": kept,
        "cached_page": page.join(kept.select(F.col("id").alias("article_id")), "article_id", "left_semi"),
    }


def delete_source(
    deleted: DataFrame, source: DataFrame, article: DataFrame, page: DataFrame
) -> dict[str, DataFrame]:
    """UPD-08: saved articles move to the hidden source first, the rest cascades."""
    ids = deleted.select(F.col("id").alias("source_id"), F.lit(True).alias("_gone")).distinct()
    marked = lookup(article, ids, ["source_id"], "left", "id")
    saved_and_gone = F.coalesce("_gone", F.lit(False)) & F.col("is_saved")
    moved = _detach(marked, source, saved_and_gone).drop("_gone", "former_source_id")
    return cascade_delete(deleted, source, moved, page)


def delete_articles(ids: DataFrame, article: DataFrame, page: DataFrame) -> dict[str, DataFrame]:
    """UPD-18: an article goes with its page row."""
    gone = ids.select("id").distinct()
    return {
        "article": article.join(gone, "id", "left_anti"),
        "cached_page": page.join(gone.select(F.col("id").alias("article_id")), "article_id", "left_anti"),
    }


# ---- fetch results -------------------------------------------------------------------


def apply_fetch(article: DataFrame, response: DataFrame, now: Column) -> DataFrame:
    """UPD-02: fold one fetch attempt into its article row.

    ``article`` carries ``has_content`` and ``cache_level``. ``response`` has, per article id,
    status, content type, body size, new headers and what extraction of page and feed content
    gave: ``text_chars``, ``word_count``, ``any_failed``, ``rss_chars``, ``rss_word_count``,
    ``total_bytes``. A missing response row is a network error.
    """
    r = response.select(
        "id", F.lit(True).alias("_answered"), F.col("status").alias("_status"),
        F.lower(F.coalesce("content_type", F.lit(""))).alias("_type"),
        F.col("body_bytes").alias("_bytes"), F.col("etag").alias("_etag"),
        F.col("last_modified").alias("_lm"), F.col("text_chars").alias("_chars"),
        F.col("word_count").alias("_words"), F.col("any_failed").alias("_assets_failed"),
        F.col("rss_chars").alias("_rss_chars"), F.col("rss_word_count").alias("_rss_words"),
        F.col("total_bytes").alias("_total"),
    )
    d = article.join(r, "id", "left")
    has_rss = F.coalesce(F.col("rss_content_html") != "", F.lit(False))
    valid = (
        (F.col("_status") == 200) & F.col("_type").contains("text/html") & (F.col("_bytes") > 1000)
    )
    chars, words = F.coalesce("_chars", F.lit(0)), F.coalesce("_words", F.lit(0))
    long_enough = chars >= S.MIN_CONTENT_CHARS
    # Full mode only rejects thin pages when feed content can replace them.
    wordy = (words >= S.MIN_CONTENT_WORDS) | ((F.col("cache_level") == "full") & ~has_rss)
    page_ok = valid & long_enough & wordy
    rss_ok = has_rss & (F.coalesce("_rss_chars", F.lit(0)) >= S.MIN_CONTENT_CHARS)
    outcome = (
        F.when(F.col("_answered").isNull(), "network_error")
        .when(F.col("_status") == 304, F.when(F.col("has_content"), "not_modified").otherwise("lost"))
        .when(~valid & ~has_rss, "rejected")
        .when(page_ok, "page")
        .when(rss_ok, "feed_content")
        .otherwise("failed")
    )
    d = d.withColumn("outcome", outcome)
    o = F.col("outcome")
    stored = o.isin("page", "feed_content")
    # Stored content was already wiped when extraction fails, but not on a failed request.
    survives = o.isin("network_error", "rejected") & (F.col("fetch_status") == "cached") & F.col("has_content")
    status = (
        F.when(stored, F.when(F.coalesce("_assets_failed", F.lit(False)), "partial").otherwise("cached"))
        .when((o == "not_modified") | survives, "cached")
        .otherwise("failed")
    )
    failed = ~stored & (o != "not_modified") & ~survives
    headers = F.col("_answered").isNotNull() & (F.col("_status") != 304)
    used_words = F.when(o == "page", words).otherwise(F.coalesce("_rss_words", F.lit(0)))
    return d.select(
        "id", "source_id", "title", "article_url", "outcome",
        status.alias("fetch_status"),
        (F.col("retry_count") + F.when(failed, 1).otherwise(0)).alias("retry_count"),
        F.when(o == "lost", F.lit(None)).when(headers, F.coalesce("_etag", "etag"))
        .otherwise(F.col("etag")).alias("etag"),
        F.when(o == "lost", F.lit(None)).when(headers, F.coalesce("_lm", "last_modified"))
        .otherwise(F.col("last_modified")).alias("last_modified"),
        F.when(stored | (o == "not_modified"), now).otherwise(F.col("cached_at")).alias("cached_at"),
        F.when(stored, F.lit(200)).when(F.col("_answered") & ~valid & (F.col("_status") != 304), F.col("_status"))
        .otherwise(F.col("last_http_status")).alias("last_http_status"),
        F.when(stored, F.col("_total").cast("int")).otherwise(F.col("cache_size_bytes")).alias("cache_size_bytes"),
        F.when(stored, text.reading_minutes(used_words)).otherwise(F.col("reading_minutes")).alias("reading_minutes"),
        # UPD-04: feed content is dropped once the page itself could be used.
        F.when(o != "page", F.col("rss_content_html")).alias("rss_content_html"),
    )


def clear_feed_content(article: DataFrame, used_fallback: Column) -> DataFrame:
    """UPD-04 on its own."""
    return article.withColumn("rss_content_html", F.when(used_fallback, F.col("rss_content_html")))


def set_hero_thumbnail(article: DataFrame, extract: DataFrame) -> DataFrame:
    """UPD-03: the page's hero replaces the feed thumbnail when there is one."""
    hero = extract.select("id", "hero_image_url", "page_url")
    d = article.join(hero, "id", "left")
    resolved = urls.resolve_url(
        F.coalesce("page_url", "article_url"), F.col("hero_image_url"), upgrade=False
    )
    return d.withColumn("thumbnail_url", F.coalesce(resolved, F.col("thumbnail_url"))).drop(
        "hero_image_url", "page_url"
    )


# ---- user changes --------------------------------------------------------------------


def toggle_save(article: DataFrame, source: DataFrame, toggles: DataFrame) -> DataFrame:
    """UPD-09: flip the saved flag of the listed articles.

    ``toggles`` has ``id`` and ``at``, one row per tap; an even number of taps changes
    nothing. Unsaving a hidden-source article deletes it.
    """
    taps = toggles.groupBy("id").agg(
        (F.count("*") % 2 == 1).alias("_flip"), F.max("at").alias("_at")
    )
    names = source.select(
        F.col("id").alias("source_id"), F.col("title").alias("_title"), F.col("icon_url").alias("_icon")
    )
    d = lookup(article.join(taps, "id", "left"), names, ["source_id"], "left", "id")
    flip = F.coalesce("_flip", F.lit(False))
    now_saved, now_unsaved = flip & ~F.col("is_saved"), flip & F.col("is_saved")
    d = d.filter(~(now_unsaved & (F.col("source_id") == S.SAVED_PAGES_ID)))

    def stamped(col: str, value: Column) -> Column:
        return F.when(now_saved, value).when(now_unsaved, F.lit(None)).otherwise(F.col(col)).alias(col)

    out = {
        "is_saved": (F.col("is_saved") != flip).alias("is_saved"),
        "saved_at": stamped("saved_at", F.col("_at")),
        "original_source_name": stamped("original_source_name", F.col("_title")),
        "original_source_icon_url": stamped("original_source_icon_url", F.col("_icon")),
    }
    return d.select(*[out.get(c, F.col(c)) for c in article.columns])


def read_state(actions: DataFrame, keys: list[str]) -> DataFrame:
    """UPD-10: read flag after ``read`` (sets) and ``toggle_read`` (flips), in (ts, seq) order.

    The flag is the parity of the toggles after the last mark, starting from true, or from
    the stored value where no mark exists. Two pre-aggregated passes, no ordered fold.
    """
    moment = F.struct("ts", "seq")
    mark = actions.filter(F.col("action") == "read").groupBy(*keys).agg(F.max(moment).alias("_mark"))
    toggles = actions.filter(F.col("action") == "toggle_read").select(*keys, moment.alias("_at"))
    after = (
        toggles.join(mark, keys, "left")
        .filter(F.col("_mark").isNull() | (F.col("_at") > F.col("_mark")))
        .groupBy(*keys).agg(F.count("*").alias("_n"))
    )
    return mark.join(after, keys, "full").select(
        *keys,
        F.col("_mark").isNotNull().alias("marked"),
        (F.coalesce("_n", F.lit(0)) % 2 == 1).alias("odd_toggles"),
    )


def apply_read_state(article: DataFrame, state: DataFrame) -> DataFrame:
    d = article.join(state, "id", "left")
    base = F.coalesce("marked", F.lit(False)) | F.col("is_read")
    return d.withColumn("is_read", base != F.coalesce("odd_toggles", F.lit(False))).drop(
        "marked", "odd_toggles"
    )


def save_page(article: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """UPD-11: saved addresses. Known articles are marked, others start in the hidden source.

    ``requests`` has ``url`` and an optional ``title``; repeated requests count once.
    """
    url = text.trim_ws(F.col("url"))
    wanted = (
        requests.select(url.alias("article_url"), F.trim(F.coalesce("title", F.lit(""))).alias("_t"))
        .groupBy("article_url").agg(F.max("_t").alias("_t"))
    )
    known = article.join(wanted.drop("_t").withColumn("_hit", F.lit(True)), "article_url", "left")
    newly = F.coalesce("_hit", F.lit(False)) & ~F.col("is_saved")
    marked = (
        known.withColumn("saved_at", F.when(newly, now).otherwise(F.col("saved_at")))
        .withColumn("is_saved", F.col("is_saved") | newly)
        .drop("_hit")
    )
    host = F.nullif(urls.host(F.col("article_url")), F.lit(""))
    fresh = wanted.join(article.select("article_url"), "article_url", "left_anti").select(
        urls.deterministic_id(F.col("article_url")).alias("id"),
        F.lit(S.SAVED_PAGES_ID).alias("source_id"),
        F.coalesce(F.nullif("_t", F.lit("")), host, F.lit("Untitled")).alias("title"),
        "article_url", now.alias("published_at"), now.alias("added_at"),
        F.lit("pending").alias("fetch_status"),
        F.lit(False).alias("is_read"), F.lit(True).alias("is_saved"), now.alias("saved_at"),
        F.replace(host, F.lit("www."), F.lit("")).alias("original_source_name"),
        F.lit(0).alias("retry_count"),
    )
    return marked.unionByName(fresh, allowMissingColumns=True)


def add_source(source: DataFrame, added: DataFrame, owner: str) -> DataFrame:
    """UPD-12: sources after the listed owners each add one; at the limit nothing changes.

    ``added`` has the owner, ``id``, ``title``, ``feed_url``, ``site_url`` and ``added_at``.
    """
    held = source.filter(F.col("id") != S.SAVED_PAGES_ID).groupBy(owner).agg(F.count("*").alias("_n"))
    accepted = (
        added.join(held, owner, "left").filter(F.coalesce("_n", F.lit(0)) < S.MAX_SOURCES).drop("_n")
    )
    grows = accepted.select(owner, F.lit(1).alias("_grow")).distinct()
    moved = source.join(grows, owner, "left").withColumn(
        "sort_order",
        F.when(F.col("id") == S.SAVED_PAGES_ID, F.col("sort_order"))
        .otherwise(F.col("sort_order") + F.coalesce("_grow", F.lit(0))),
    ).drop("_grow")
    fresh = (
        accepted.withColumn("sort_order", F.lit(0)).withColumn("cache_level", F.lit("standard"))
        .withColumn("fetch_frequency", F.lit("automatic")).withColumn("fetch_status", F.lit("idle"))
        .withColumn("is_collapsed", F.lit(False))
    )
    return moved.unionByName(fresh, allowMissingColumns=True)


def refetch(article: DataFrame, source: DataFrame, page: DataFrame) -> DataFrame:
    """UPD-16: articles to fetch again on request, with the level to use.

    Hidden-source articles repeat the level of their stored page, others follow their source.
    """
    levels = source.select(F.col("id").alias("source_id"), F.col("cache_level").alias("_source_level"))
    used = page.select(F.col("article_id").alias("id"), F.col("cache_level_used").alias("_page_level"))
    d = lookup(article.join(used, "id", "left"), levels, ["source_id"], "left", "id")
    hidden = F.col("source_id") == S.SAVED_PAGES_ID
    level = F.when(hidden, F.col("_page_level")).otherwise(F.col("_source_level"))
    return (
        d.withColumn("retry_count", F.lit(0))
        .withColumn("refetch_level", F.coalesce(level, F.lit("standard")))
        .drop("_source_level", "_page_level")
    )


def update_source(source: DataFrame, changes: DataFrame) -> DataFrame:
    """UPD-17: single-field updates; the latest change of each field wins.

    ``changes`` has ``id``, ``field`` (title or is_collapsed), ``value`` and ``at``.
    """
    latest = changes.groupBy("id").agg(
        F.max_by(F.when(F.col("field") == "title", F.col("value")),
                 F.when(F.col("field") == "title", F.struct("at", "seq"))).alias("_title"),
        F.max_by(F.when(F.col("field") == "is_collapsed", F.col("value")),
                 F.when(F.col("field") == "is_collapsed", F.struct("at", "seq"))).alias("_collapsed"),
    )
    return (
        source.join(latest, "id", "left")
        .withColumn("title", F.coalesce("_title", "title"))
        .withColumn("is_collapsed", F.coalesce(F.col("_collapsed").cast("boolean"), F.col("is_collapsed")))
        .drop("_title", "_collapsed")
    )


def upsert(current: DataFrame, changes: DataFrame, key: str, version: Column) -> DataFrame:
    """SRC-08: insert or replace by key; of several changes to a key the latest wins.

    Changed keys are usually few, so the table is anti-joined with them and the winners are
    appended, rather than shuffling every column of both sides.
    """
    cols = [F.col(c) for c in current.columns]
    winner = changes.groupBy(key).agg(F.max_by(F.struct(*current.columns), version).alias("_row"))
    fresh = winner.select("_row.*").select(*cols)
    return current.join(fresh.select(key), key, "left_anti").select(*cols).unionByName(fresh)
