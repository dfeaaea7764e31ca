"""From feed items to library articles: windowing, matching and the fetch plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom import schema as S
from feedloom.functions import urls
from feedloom.operators.library import newest_first
from feedloom.operators.skew import first_per_key, lookup, rank_within, top_k


def article_limit(cache_level: Column, user_limit: int = S.DEFAULT_ARTICLE_LIMIT) -> Column:
    """How many feed items a source takes in at once."""
    per_level = F.when(cache_level == "full", S.FULL_LEVEL_LIMIT).otherwise(S.DEFAULT_ARTICLE_LIMIT)
    return F.least(per_level, F.lit(user_limit if user_limit > 0 else S.DEFAULT_ARTICLE_LIMIT))


def first_of_both(items: DataFrame, keys: tuple[str, ...] = ("url", "title")) -> DataFrame:
    """Items that are the newest of their URL and of their title within the feed.

    An item dropped for its URL still reserves its title, so both firsts are taken over all
    items. They are minima over narrow rows, which map tasks pre-aggregate.
    """
    order = [F.col("published_at").isNull(), -F.unix_micros("published_at"), F.col("pos")]
    firsts = None
    for key in keys:
        one = first_per_key(items, ["source_id", key], order, ["pos"]).select("source_id", "pos")
        firsts = one if firsts is None else firsts.join(one, ["source_id", "pos"])
    return items.join(firsts, ["source_id", "pos"], "left_semi")


def feed_window(
    items: DataFrame, source: DataFrame, user_limit: int = S.DEFAULT_ARTICLE_LIMIT
) -> DataFrame:
    """WIN-01: newest distinct items of each feed, capped by the source's cache level.

    ``items`` carries ``source_id`` and a feed-unique ``pos``.
    """
    levels = source.select(
        F.col("id").alias("source_id"),
        F.coalesce("cache_level", F.lit("standard")).alias("cache_level"),
    )
    order = [F.col("published_at").desc_nulls_last(), F.col("pos")]
    narrow = first_of_both(items).select("source_id", "pos", "published_at")
    capped = top_k(narrow, ["source_id"], order, min(user_limit or 25, S.DEFAULT_ARTICLE_LIMIT), "window_rank")
    kept = capped.join(levels, "source_id").filter(
        F.col("window_rank") <= article_limit(F.col("cache_level"), user_limit)
    )
    # The wide item columns join only after the cap, at most 25 rows a source.
    return items.join(kept.drop("published_at"), ["source_id", "pos"])


def existing_by_title(article: DataFrame) -> DataFrame:
    """One article per (source, title): the oldest, then the smallest id."""
    return first_per_key(article, ["source_id", "title"], [F.col("added_at"), F.col("id")], ["id"])


def match_existing(window: DataFrame, article: DataFrame) -> DataFrame:
    """JOIN-01: the library article an item stands for: same URL first, else same title.

    A literal OR condition would be a nested loop; two keyed joins are not.
    """
    by_url = article.select(
        "source_id", F.col("article_url").alias("url"), F.col("id").alias("_by_url")
    )
    by_title = existing_by_title(article).withColumnRenamed("id", "_by_title")
    return (
        window.join(by_url, ["source_id", "url"], "left")
        .join(by_title, ["source_id", "title"], "left")
        .withColumn("existing_id", F.coalesce("_by_url", "_by_title"))
        .withColumn(
            "matched_by",
            F.when(F.col("_by_url").isNotNull(), "url").when(F.col("_by_title").isNotNull(), "title"),
        )
        .drop("_by_url", "_by_title")
    )


def reattach_saved(window: DataFrame, article: DataFrame) -> DataFrame:
    """JOIN-02: saved rows of the hidden source whose URL reappears move to that source."""
    detached = article.filter((F.col("source_id") == S.SAVED_PAGES_ID) & F.col("is_saved"))
    target = first_per_key(window, ["url"], [F.col("source_id")], ["source_id"]).select(
        F.col("url").alias("article_url"), F.col("source_id").alias("_target")
    )
    return (
        detached.join(target, "article_url").withColumn("source_id", F.col("_target")).drop("_target")
    )


def new_items(items: DataFrame, article: DataFrame) -> DataFrame:
    """JOIN-03: items the library lacks, by URL anywhere and by title within the source.

    Non-article addresses are skipped before a title is reserved; both keys are distinct in
    the result.
    """
    # Decided on narrow rows; the content joins once, at the end.
    fresh = items.select("source_id", "pos", "url", "title", "published_at").filter(~urls.is_non_article_url(F.col("url")))
    known_urls = article.select(F.col("article_url").alias("url"))
    known_titles = article.select("source_id", "title").distinct()
    order = [F.col("published_at").isNull(), -F.unix_micros("published_at"), F.col("pos")]
    by_title = first_per_key(fresh, ["source_id", "title"], order, ["pos"])
    kept = fresh.join(by_title.select("source_id", "pos"), ["source_id", "pos"], "left_semi")
    kept = kept.join(known_urls, "url", "left_anti").join(
        known_titles, ["source_id", "title"], "left_anti"
    )
    once = first_per_key(kept, ["url"], [F.col("source_id"), *order], ["source_id", "pos"])
    return items.join(once, ["source_id", "pos", "url"], "left_semi")


def resolve_redirects(items: DataFrame, redirect: DataFrame, article: DataFrame) -> DataFrame:
    """FLT-03: aggregator links become the real address; unresolved or known ones go."""
    to_url = redirect.select(F.col("from_url").alias("url"), "to_url")
    mapped = items.join(to_url, "url", "left")
    is_agg = urls.is_aggregator_url(F.col("url"))
    kept = mapped.filter(~is_agg | (F.col("to_url").isNotNull() & (F.col("to_url") != F.col("url"))))
    kept = kept.withColumn("resolved_url", F.when(is_agg, F.col("to_url")).otherwise(F.col("url")))
    known = article.select(F.col("article_url").alias("resolved_url"), F.lit(True).alias("_known"))
    return (
        kept.join(known, "resolved_url", "left")
        .filter(~is_agg | F.col("_known").isNull())
        .drop("_known", "to_url")
    )


def plan_fetch(
    window: DataFrame, article: DataFrame, page: DataFrame, content: DataFrame,
    redirect: DataFrame,
) -> DataFrame:
    """UPD-01: what to do with each item of the intake window.

    Actions: ``delete`` (a stored non-article), ``ignore``, ``queue``, ``reset`` (interrupted
    fetch), ``give_up`` (retries spent), ``requeue_missing`` and ``requeue_level`` (both clear
    the conditional headers), ``keep``, ``reattach``, ``unresolved``, ``duplicate``, ``insert``.
    """
    state = (
        article.select(
            F.col("id").alias("existing_id"), "fetch_status", "retry_count",
        )
        .join(page.select(F.col("article_id").alias("existing_id"), "cache_level_used"), "existing_id", "left")
        .join(content.select(F.col("article_id").alias("existing_id"), "content_chars"), "existing_id", "left")
    )
    owner = article.select(
        F.col("article_url").alias("resolved_url"),
        F.col("source_id").alias("owner_id"), F.col("is_saved").alias("owner_saved"),
    )
    to_url = redirect.select(F.col("from_url").alias("url"), "to_url")
    m = (
        match_existing(window, article)
        .join(to_url, "url", "left")
        # Never a null join key: those rows would all meet in one task.
        .withColumn("resolved_url", F.coalesce("to_url", "url"))
        .join(owner, "resolved_url", "left")
        .withColumn("_key", F.coalesce("existing_id", F.concat(F.lit("new:"), "source_id", F.lit(":"), F.col("pos").cast("string"))))
        .join(state.withColumnRenamed("existing_id", "_key"), "_key", "left")
    )
    can_retry = F.col("retry_count") < S.MAX_AUTO_RETRIES
    has_content = F.coalesce("content_chars", F.lit(0)) >= S.MIN_CONTENT_CHARS
    is_agg = urls.is_aggregator_url(F.col("url"))
    action = (
        F.when(urls.is_non_article_url(F.col("url")),
               F.when(F.col("existing_id").isNotNull(), "delete").otherwise("ignore"))
        .when(F.col("existing_id").isNotNull(),
              F.when(F.col("fetch_status").isin("pending", "failed"),
                     F.when(can_retry, "queue").otherwise("give_up"))
              .when(F.col("fetch_status") == "fetching",
                    F.when(can_retry, "reset").otherwise("give_up"))
              .when(~has_content, "requeue_missing")
              .when(F.col("cache_level_used") != F.col("cache_level"), "requeue_level")
              .otherwise("keep"))
        .when(~is_agg & (F.col("owner_id") == S.SAVED_PAGES_ID) & F.col("owner_saved"), "reattach")
        .when(is_agg & F.col("to_url").isNull(), "unresolved")
        .when(F.col("owner_id").isNotNull(), "duplicate")
        .otherwise("insert")
    )
    return m.withColumn("action", action).select(
        "source_id", "pos", "url", "resolved_url", "title", "published_at", "window_rank",
        "existing_id", "matched_by", "action",
        F.col("action").isin("queue", "reset", "requeue_missing", "requeue_level", "insert")
        .alias("needs_caching"),
        F.col("action").isin("requeue_missing", "requeue_level").alias("clear_headers"),
    )


def priority_split(queue: DataFrame, k: int = S.VISIBLE_ARTICLES, order=None) -> DataFrame:
    """WIN-02: the first ``k`` of each source come first, the rest is backfill.

    The whole queue is split. A source may hold any share of it, so ranks are counted over
    range partitions.
    """
    ranked = rank_within(queue, "source_id", order or newest_first(), "queue_rank")
    return ranked.withColumn(
        "phase", F.when(F.col("queue_rank") <= k, "priority").otherwise("backfill")
    )


def round_robin(queue: DataFrame) -> DataFrame:
    """WIN-03: one article of each source in turn, over the whole queue.

    The queue has no cap here, so ranks come from the range-partitioned count. Sources go by
    their newest article.
    """
    q = queue.withColumn("moment", S.newest())
    ranked = rank_within(q, "source_id", [F.col("moment").desc(), F.col("id")], "turn")
    lead = q.groupBy("source_id").agg(F.max("moment").alias("source_newest"))
    return lookup(ranked, lead, ["source_id"], "inner", "id").orderBy(
        "turn", F.col("source_newest").desc(), "source_id"
    )


def _levels(source: DataFrame) -> DataFrame:
    return source.select(
        F.col("id").alias("source_id"),
        F.coalesce("cache_level", F.lit("standard")).alias("cache_level"),
    )


def retry_queue(article: DataFrame, source: DataFrame) -> DataFrame:
    """WIN-09: unfinished articles to try again, newest 10 or 25 a source, headers cleared.

    The user's own limit does not apply here. Non-article rows are marked for deletion.
    """
    waiting = article.filter(
        F.col("fetch_status").isin(*S.UNCACHED) & (F.col("retry_count") < S.MAX_AUTO_RETRIES)
    )
    ranked = top_k(waiting, ["source_id"], newest_first(), S.DEFAULT_ARTICLE_LIMIT)
    return (
        ranked.join(_levels(source), "source_id")
        .filter(F.col("rn") <= article_limit(F.col("cache_level")))
        .withColumn("etag", F.lit(None).cast("string"))
        .withColumn("last_modified", F.lit(None).cast("string"))
        .withColumn(
            "action",
            F.when(urls.is_non_article_url(F.col("article_url")), "delete").otherwise("cache"),
        )
    )


def backfill_queue(
    article: DataFrame, source: DataFrame, user_limit: int = S.DEFAULT_ARTICLE_LIMIT
) -> DataFrame:
    """WIN-10: newest waiting articles of a source; non-article rows count but are skipped."""
    waiting = article.filter(
        F.col("fetch_status").isin("pending", "fetching")
        & (F.col("retry_count") < S.MAX_AUTO_RETRIES)
    )
    ranked = top_k(waiting, ["source_id"], newest_first(), S.DEFAULT_ARTICLE_LIMIT)
    return (
        ranked.join(_levels(source), "source_id")
        .filter(F.col("rn") <= article_limit(F.col("cache_level"), user_limit))
        .filter(~urls.is_non_article_url(F.col("article_url")))
    )
