"""STR-01 to STR-08 as micro-batch steps over versioned tables.

Late items are welcome: a new subscription delivers its backlog, so no watermark drops rows.
The article table is the memory of what is known; pruning keeps it bounded per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom import schema as S
from feedloom.functions import urls
from feedloom.operators import intake, library as L, maintenance as M
from feedloom.operators.skew import lookup, top_k
from feedloom.sources import feeds
from feedloom.streaming.tables import BUCKETS, Batch, Store, VersionedTable, bucket_of
from feedloom.streaming.views import TopList, TopView

REFRESH_EVERY = "15 minutes"
PROCESS_EVERY = "1 hour"

SUMMARY = "source_id STRING, article_count BIGINT, unread_count BIGINT, reading_minutes_total BIGINT"
LEAD = ("home INT, list STRING, id STRING, source_id STRING, title STRING, saved_at TIMESTAMP, added_at TIMESTAMP, moment TIMESTAMP, turn INT, "
        "source_newest TIMESTAMP")
ACCESSORIES = ("rectangular", "circular", "inline", "corner")  # display sizes without pictures
BALANCED = "id STRING, source_id STRING, turn INT, source_newest TIMESTAMP"
SAVED = "id STRING, title STRING, saved_at TIMESTAMP"
STALE = "id STRING, priority STRING"
PLACE = "id STRING, source_id STRING"
ADDRESS = "article_url STRING, id STRING, source_id STRING"
LOG = "article_id STRING, kind STRING, ts TIMESTAMP, seq BIGINT, n BIGINT"
WIDGETS = "size STRING, rn INT, id STRING, source_id STRING, title STRING"
SAVED_SIZE = 10
TAIL = 256  # events of an article that are kept one by one
FETCHED = "source_id STRING, last_fetched_at TIMESTAMP"


def without_deleted(batch: DataFrame, tombstone: DataFrame, key: str = "source_id") -> DataFrame:
    """STR-07: updates for sources deleted meanwhile are dropped."""
    return batch.join(tombstone.select(key).distinct(), key, "left_anti")


def _when(batch: DataFrame):
    return F.struct("change_at", "change_seq") if "change_at" in batch.columns else F.struct("added_at", "id")


def latest_changes(batch: DataFrame, cols: list[str]) -> DataFrame:
    """One row an article: of several changes in a batch the latest."""
    order = _when(batch)
    return batch.groupBy("id").agg(F.max_by(F.struct(*cols), order).alias("_row")).select("_row.*").select(*cols)


def replace_rows(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Current rows without those that changed or are gone, and the changed ones.

    ``changes`` has a row marked ``_gone`` for an article in the source that it left.
    """
    stay = current.join(changes.select("id", "source_id").distinct(), ["id", "source_id"], "left_anti")
    return stay.select(*current.columns).unionByName(changes.filter(~F.col("_gone")).select(*current.columns))


def replace_by_key(key: str):
    def merge(current: DataFrame, rows: DataFrame) -> DataFrame:
        """Rows of the batch's keys are replaced; a row marked ``_gone`` only removes."""
        fresh = rows.filter(~F.col("_gone")) if "_gone" in rows.columns else rows
        return current.join(rows.select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(fresh.select(*current.columns))

    return merge


def _balanced():
    return [F.col("turn"), F.col("source_newest").desc(), F.col("source_id")]


class View:
    """A result that is worked out from a job's tables when it is read."""

    def __init__(self, read) -> None:
        self.read = read


def _illustrated():
    return F.col("fetch_status").isin(*S.READABLE) & (F.col("source_id") != S.SAVED_PAGES_ID) & F.col("thumbnail_url").isNotNull()


class LiveLibrary:
    """STR-01, STR-02 and STR-08: lists that follow changes of the article table.

    Articles lie by source, since lists are by source; their bodies lie where they were first
    stored, for no list looks at them. A small table keeps the source of each
    article, so that one that moves leaves its old source, whose lists are refreshed as well.
    The sources' latest and illustrated articles and each bucket's saved ones are kept by what
    changes (``TopView``). Of these lists every bucket has its own best rows of both carousels
    and of the widgets, made anew for touched buckets; the snapshots are the best of the buckets'
    best. All tables of a batch are committed together.
    """

    def __init__(self, root: str, limit: int = S.DEFAULT_ARTICLE_LIMIT, buckets: int = BUCKETS) -> None:
        self.store, self.limit = Store(root), limit
        self.article = self.store.text_table("article", S.ARTICLE, "source_id", ["rss_content_html"], buckets)
        self.place = self.store.table("place", PLACE, "id", buckets)
        self.summary = self.store.table("summary", SUMMARY, "source_id", buckets)
        newest = lambda: (S.newest(), F.lit(None).cast("timestamp"))
        self.lists = TopView(self.store, "lists", self.article, "source_id STRING, title STRING, published_at TIMESTAMP, added_at TIMESTAMP, saved_at TIMESTAMP", [
            TopList("latest", lambda: F.col("source_id"), lambda: F.col("fetch_status").isin(*S.READABLE), newest, S.VISIBLE_ARTICLES),
            TopList("illustrated", lambda: F.col("source_id"), _illustrated, newest, L.CAROUSEL_SIZE),
            TopList("saved", lambda: bucket_of("source_id", buckets).cast("string"),
                    lambda: F.col("is_saved") & (F.col("fetch_status") != "failed") & F.col("thumbnail_url").isNotNull(),
                    lambda: (F.col("saved_at"), F.col("added_at")), SAVED_SIZE),
        ])
        self.lead = self.store.table("lead", LEAD, "home", buckets)
        self.balanced = self.store.snapshot("balanced", BALANCED)
        self.saved = self.store.snapshot("saved", SAVED)
        self.widgets = self.store.snapshot("widgets", WIDGETS)
        self.latest = View(lambda spark: self.lists.rows(spark, "latest").select("source_id", "id", "rn"))

    def step(self, rows: DataFrame, batch_id: int) -> None:
        """Apply changes, then refresh the touched sources' lists and the small snapshots."""
        with self.store.batch(rows.sparkSession, batch_id) as batch:
            if batch.done:
                return
            self.article.gather(batch, batch.read(self.place).count())
            came = self.article.add(batch, rows)
            latest = batch.stage(latest_changes(came, S.columns(self.article.schema)), "latest")
            old = batch.read(self.place, self.place.touched(latest)).withColumnRenamed("source_id", "_old")
            left = batch.stage(latest.select("id", "source_id").join(old, "id").filter(F.col("source_id") != F.col("_old")).select(
                "id", F.col("_old").alias("source_id")), "left")
            changes = latest.withColumn("_gone", F.lit(False)).unionByName(left.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
            batch.update(self.article, changes, replace_rows)
            batch.update(self.place, latest.select("id", "source_id"), replace_by_key("id"))
            touched = batch.stage(changes.select("source_id").distinct(), "sources")
            mine = batch.read(self.article, self.article.touched(touched)).join(touched, "source_id", "left_semi")
            fresh = L.source_summary(mine, self.limit)
            batch.update(self.summary, touched, lambda current, keys: current.join(keys, "source_id", "left_anti").unionByName(
                fresh.select(*current.columns)))
            self.lists.update(batch, changes)
            self._carousels(batch, touched)

    def _carousels(self, batch: Batch, touched: DataFrame) -> None:
        """The best rows of the touched sources' buckets, then the best of all buckets."""
        homes = touched.select(bucket_of("source_id", self.article.buckets).alias("home")).distinct()
        lists = batch.read(self.lists.table, self.lists.table.touched(homes)).join(homes, "home", "left_semi").withColumn("moment", S.newest())
        shown = self.lists.first(lists, "illustrated")
        turns = shown.join(shown.groupBy("source_id").agg(F.max("moment").alias("source_newest")), "source_id").withColumn("turn", F.col("rn")).drop("rn")
        plain = self.lists.first(lists, "latest").filter(F.col("source_id") != S.SAVED_PAGES_ID)
        newest = [F.col("moment").desc(), F.col("id")]
        most = {need: max(k for size, k in L.DISPLAY_ROWS.items() if (size in ACCESSORIES) != need) for need in (True, False)}
        best = {
            "balanced": top_k(turns, ["home"], _balanced(), L.CAROUSEL_SIZE),
            "saved": self.lists.first(lists, "saved"),
            "pictures": top_k(shown.drop("rn"), ["home"], newest, most[True]),
            "plain": top_k(plain.drop("rn"), ["home"], newest, most[False]),
        }
        lead = None
        for name, rows in best.items():
            part = S.conform(rows.withColumn("list", F.lit(name)), LEAD)
            lead = part if lead is None else lead.unionByName(part)
        batch.update(self.lead, homes, lambda current, keys: current.join(keys, "home", "left_anti").select(*lead.columns).unionByName(lead))
        lead = batch.stage(batch.read(self.lead), "lead-now")  # a few rows a bucket
        part = lambda name, order, k: lead.filter(F.col("list") == name).orderBy(*order).limit(k)
        batch.write(self.balanced, part("balanced", _balanced(), L.CAROUSEL_SIZE).select("id", "source_id", "turn", "source_newest"))
        batch.write(self.saved, part("saved", [F.col("saved_at").desc(), F.col("added_at").desc(), F.col("id")], SAVED_SIZE).select("id", "title", "saved_at"))
        widgets = None
        for name, need in (("pictures", True), ("plain", False)):
            sizes = [F.struct(F.lit(size).alias("size"), F.lit(k).alias("k")) for size, k in L.DISPLAY_ROWS.items() if (size in ACCESSORIES) != need]
            # At most ten rows: their rank is a position in one small array.
            ranked = part(name, newest, most[need]).agg(F.sort_array(F.collect_list(F.struct(
                -F.unix_micros("moment"), "id", "source_id", "title"))).alias("_rows")).select(F.posexplode("_rows").alias("pos", "r"))
            one = ranked.withColumn("s", F.explode(F.array(*sizes))).filter(F.col("pos") < F.col("s.k")).select(
                F.col("s.size").alias("size"), (F.col("pos") + 1).alias("rn"), "r.id", "r.source_id", "r.title")
            widgets = one if widgets is None else widgets.unionByName(one)
        batch.write(self.widgets, widgets)


class RefreshStream:
    """STR-03: feed documents arriving continuously become pending articles, then pruning.

    A table keyed by address knows every article of the library. A known address adds nothing,
    wherever it is; if it is a saved article of the hidden source, that moves to the feed's.
    After a refresh, ``limit`` prunes pending and readable articles of the touched sources;
    saved ones among these move to the hidden source. Without a limit nothing is pruned.
    """

    def __init__(self, root: str, limit: int | None = S.DEFAULT_ARTICLE_LIMIT, buckets: int = BUCKETS, source: DataFrame | None = None) -> None:
        self.store, self.limit, self.source = Store(root), limit, source
        self.article = self.store.table("article", S.ARTICLE, "source_id", buckets)
        self.address = self.store.table("address", ADDRESS, "article_url", buckets)

    def load(self, articles: DataFrame, batch_id: int) -> None:
        """Take over an existing library, before the first batch."""
        with self.store.batch(articles.sparkSession, batch_id) as batch:
            if not batch.done:
                rows = articles.select(*S.columns(S.ARTICLE)).withColumn("_gone", F.lit(False))
                batch.update(self.article, rows, replace_rows)
                batch.update(self.address, rows.select("article_url", "id", "source_id"), replace_by_key("article_url"))

    def step(self, documents: DataFrame, batch_id: int) -> None:
        """``documents`` has source_id, feed_url, xml and fetched_at; each is parsed once.
        Articles and addresses are committed together."""
        with self.store.batch(documents.sparkSession, batch_id) as batch:
            if not batch.done:
                self._apply(batch, documents)

    def _apply(self, batch: Batch, documents: DataFrame) -> None:
        spark = batch.spark
        _, items = feeds.read_feeds(documents.select("feed_url", "xml"))
        owner = documents.groupBy("feed_url").agg(F.max("source_id").alias("source_id"), F.max("fetched_at").alias("added_at"))
        found = batch.stage(items.join(owner, "feed_url").withColumn(
            "pos", F.concat_ws("#", "feed_url", F.lpad(F.col("pos").cast("string"), 9, "0"))), "items")
        touched = found.select("source_id").distinct()
        hidden = spark.createDataFrame([(S.SAVED_PAGES_ID,)], "source_id string")
        mine = batch.read(self.article, self.article.touched(touched)).join(touched, "source_id", "left_semi").select(*S.columns(S.ARTICLE))
        urls_of = found.select(F.col("url").alias("article_url")).distinct()
        known = batch.read(self.address, self.address.touched(urls_of)).join(urls_of, "article_url", "left_semi")
        library = mine.select("source_id", "title", "article_url").unionByName(
            known.select("article_url").withColumns({"source_id": F.lit(None).cast("string"), "title": F.lit(None).cast("string")}))
        added = intake.new_items(found, library).select(
            urls.deterministic_id(F.col("url")).alias("id"), "source_id", "title", F.col("url").alias("article_url"),
            "published_at", "added_at", "thumbnail_url", F.lit("pending").alias("fetch_status"),
            F.lit(False).alias("is_read"), F.lit(False).alias("is_saved"),
            F.col("source_name").alias("original_source_name"), F.lit(0).alias("retry_count"),
            F.col("content_html").alias("rss_content_html"),
        )
        detached = batch.read(self.article, self.article.touched(hidden))
        back = intake.reattach_saved(found.filter(~urls.is_non_article_url(F.col("url"))), detached).select(*S.columns(S.ARTICLE))
        rows = batch.stage(mine.unionByName(back).unionByName(added, allowMissingColumns=True), "rows")
        changes = batch.stage(self._pruned(rows).unionByName(
            back.select("id", "article_url").withColumn("source_id", F.lit(S.SAVED_PAGES_ID)).withColumn("_gone", F.lit(True)),
            allowMissingColumns=True), "changes")
        batch.update(self.article, changes, replace_rows)
        here = changes.filter(~F.col("_gone")).select("article_url", "id", "source_id", "_gone")
        away = changes.filter("_gone").join(here.select("id"), "id", "left_anti").select(*here.columns)
        batch.update(self.address, here.unionByName(away), replace_by_key("article_url"))

    def _pruned(self, rows: DataFrame) -> DataFrame:
        """Rows of the touched sources after pruning: changed ones, and marks of those that left."""
        kept = rows.withColumn("_gone", F.lit(False))
        if self.limit is None:
            return kept
        source = self.source if self.source is not None else rows.sparkSession.createDataFrame([], S.SOURCE)
        excess = M.prune_excess(rows, source, self.limit)
        out = M.prune_pending(rows, self.limit).select("id", "source_id", "article_url").unionByName(
            excess.select("id", F.col("former_source_id").alias("source_id"), "article_url"))
        moved = excess.filter(F.col("action") == "detach").select(*S.columns(S.ARTICLE)).withColumn("_gone", F.lit(False))
        stay = kept.join(out.select("id"), "id", "left_anti").select(*kept.columns)
        return stay.unionByName(moved).unionByName(out.withColumn("_gone", F.lit(True)), allowMissingColumns=True)


def since_mark(log: DataFrame) -> DataFrame:
    """What still counts of marks and events: the last mark of each article, and what follows it.

    However late an item arrives, the last mark and the events after it are what an ordered
    replay of everything would leave. Rows of other kinds stay.
    """
    moment = F.struct("ts", "seq")
    mark = log.filter("kind = 'mark'").groupBy("article_id").agg(F.max(moment).alias("_mark"))
    kept = lookup(log, mark, ["article_id"], "left", "seq").filter(
        ~F.col("kind").isin("mark", "event") | F.col("_mark").isNull() | (moment > F.col("_mark")) | ((F.col("kind") == "mark") & (moment == F.col("_mark"))))
    return kept.select(*log.columns)


def compacted(log: DataFrame, tail: int = TAIL) -> DataFrame:
    """A log of bounded length for each article, whatever it has been through.

    The last ``tail`` events stay as they are; older ones become one row, which stands at the
    latest of them and counts them all. Events can be added in any order: one that is older than
    that row is counted with it later on. A mark that comes so late that it is older than the row
    does not end what the row counts. Flags are one row a kind.
    """
    moment = F.struct("ts", "seq")
    events = log.filter("kind = 'event'")
    # The first of the events that stay; few rows of an article leave a task.
    cut = top_k(events, ["article_id"], [F.col("ts").desc(), F.col("seq").desc()], tail).filter(F.col("rn") == tail).select(
        "article_id", moment.alias("_cut"))
    cut = cut.groupBy("article_id").agg(F.min("_cut").alias("_cut"))
    placed = lookup(events, cut, ["article_id"], "left", "seq")
    old = F.coalesce(moment < F.col("_cut"), F.lit(False))
    folded = placed.filter(old).groupBy("article_id").agg(F.max(moment).alias("_at"), F.sum("n").alias("n")).select(
        "article_id", F.lit("event").alias("kind"), F.col("_at.ts").alias("ts"), F.col("_at.seq").alias("seq"), "n")
    marks = log.filter("kind = 'mark'").groupBy("article_id").agg(F.max(moment).alias("_at")).select(
        "article_id", F.lit("mark").alias("kind"), F.col("_at.ts").alias("ts"), F.col("_at.seq").alias("seq"), F.lit(1).cast("bigint").alias("n"))
    flags = log.filter(~F.col("kind").isin("mark", "event")).groupBy("article_id", "kind").agg(F.sum("n").alias("n")).select(
        "article_id", "kind", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("seq"), "n")
    return placed.filter(~old).select(*log.columns).union(folded.select(*log.columns)).union(marks.select(*log.columns)).union(flags.select(*log.columns))


class EventLog:
    """Marks, events since the last of them, and flags of articles, in a log of bounded length."""

    def __init__(self, root: str, buckets: int = BUCKETS, tail: int = TAIL) -> None:
        self.log, self.tail = VersionedTable(f"{root}/log", LOG, "article_id", buckets), tail
        self.state = View(self.result)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """``rows`` has article_id, kind, ts and seq. Repeated rows are events of their own."""
        new = rows.withColumn("n", F.lit(1).cast("bigint")).select("article_id", "kind", "ts", "seq", "n")
        self.log.update(new, batch_id, lambda current, more: compacted(since_mark(current.unionByName(more)), self.tail))

    def folded(self, spark) -> DataFrame:
        """One row an article: marked, events, and the sums of flags by kind."""
        count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
        return self.log.read(spark).groupBy("article_id").agg(
            F.bool_or(F.col("kind") == "mark").alias("marked"), count("event").alias("events"), count("save").alias("saves"), count("delete").alias("deletes"))


class UserActions(EventLog):
    """STR-04: ordered read, save and delete actions folded into article flags.

    Marks and toggles are kept from the last mark on, so that late ones find their place; the
    other actions do not depend on their order. No per-row state function is needed.
    """

    def step(self, batch: DataFrame, batch_id: int) -> None:
        kinds = {"read": "mark", "toggle_read": "event", "toggle_save": "save", "delete": "delete"}
        kind = F.lit("other")
        for action, name in kinds.items():
            kind = F.when(F.col("action") == action, name).otherwise(kind)
        self.add(batch.select("article_id", kind.alias("kind"), "ts", "seq"), batch_id)

    def result(self, spark) -> DataFrame:
        return self.folded(spark).select(
            "article_id", (F.col("marked") != (F.col("events") % 2 == 1)).alias("is_read"), (F.col("saves") % 2 == 1).alias("is_saved"),
            (F.col("deletes") > 0).alias("deleted"))


class RetryCounter(EventLog):
    """STR-05: failures per article since its last success or manual refetch, late ones included."""

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` has article_id, ts, seq and outcome (ok, failed or refetch)."""
        rows = batch.filter(F.col("outcome").isin("ok", "refetch", "failed")).select(
            "article_id", F.when(F.col("outcome") == "failed", "event").otherwise("mark").alias("kind"), "ts", "seq")
        self.add(rows, batch_id)

    def result(self, spark) -> DataFrame:
        return self.folded(spark).select("article_id", F.col("events").alias("retry_count"))


class StaleSources:
    """STR-06: last fetch per source, and the plan a resume at the batch's time would make.

    ``streaming/timers.py`` has the plan that also changes while nothing arrives.
    """

    def __init__(self, root: str, source: DataFrame, active: str | None, buckets: int = BUCKETS) -> None:
        self.store = Store(root)
        self.fetched = self.store.table("fetched", FETCHED, "source_id", buckets)
        self.plan = self.store.snapshot("plan", STALE)
        self.source, self.active = source, active

    def step(self, fetches: DataFrame, batch_id: int) -> None:
        """``fetches`` has source_id and ts, one row per finished fetch."""
        with self.store.batch(fetches.sparkSession, batch_id) as batch:
            if not batch.done:
                done = fetches.groupBy("source_id").agg(F.max("ts").alias("last_fetched_at"))
                batch.update(self.fetched, done, lambda current, new: current.unionByName(new).groupBy("source_id").agg(
                    F.max("last_fetched_at").alias("last_fetched_at")))
                batch.write(self.plan, self.plan_at(batch, fetches))

    def plan_at(self, batch: Batch, fetches: DataFrame) -> DataFrame:
        known = batch.read(self.fetched).withColumnRenamed("source_id", "id")
        clock = fetches.agg(F.max("ts").alias("now")).withColumn("_one", F.lit(1))
        d = self.source.filter(F.col("id") != S.SAVED_PAGES_ID).drop("last_fetched_at").join(known, "id", "left")
        d = d.withColumn("_one", F.lit(1)).join(clock, "_one").drop("_one")
        due = L.stale_sources(d, F.col("now"))
        first = F.lit(True) if self.active is None else F.col("id") == self.active
        return due.select("id", F.when(first, "now").otherwise("deferred").alias("priority"))
