"""The library as stored tables: lookups that leave it where it lies, deletions in one commit.

``LibraryIndex`` (JOIN-01) holds the two keys an item is known by as bucketed tables. A join on
them deals out the items alone: Spark takes the tables as they are stored.

``LibraryStore`` (JOIN-13, SRC-08, UPD-08) holds sources, articles, pages and addresses in one
store. A change reads and writes the buckets it touches, and all tables change together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom import schema as S
from feedloom.operators import maintenance as M
from feedloom.operators.intake import existing_by_title
from feedloom.streaming.jobs import ADDRESS, replace_by_key, replace_rows
from feedloom.streaming.tables import BUCKETS, Batch, Folder, Store, VersionedTable


class LibraryIndex:
    """Ids of articles by address and by title, bucketed by that key alone: a hot source, which
    all its articles share, does not share a bucket."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets
        self.tables: dict[str, str] = {}

    def build(self, article: DataFrame) -> LibraryIndex:
        version = uuid.uuid4().hex
        by_url = article.select("source_id", F.col("article_url").alias("url"), F.col("id").alias("_by_url"))
        by_title = existing_by_title(article).withColumnRenamed("id", "_by_title")
        for key, rows in (("url", by_url), ("title", by_title)):
            name = f"library_{key}_{version}"
            # Dealt as the buckets are, so that every bucket is one file.
            rows.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key).option(
                "path", f"{self.root}/{name}").saveAsTable(name)
            self.tables[key] = name
        return self

    def match(self, window: DataFrame) -> DataFrame:
        """JOIN-01 over the stored keys: same address first, else same title."""
        by_url, by_title = (self.spark.table(self.tables[k]) for k in ("url", "title"))
        return (
            window.join(by_url, ["source_id", "url"], "left").join(by_title, ["source_id", "title"], "left")
            .withColumn("existing_id", F.coalesce("_by_url", "_by_title"))
            .withColumn("matched_by", F.when(F.col("_by_url").isNotNull(), "url").when(F.col("_by_title").isNotNull(), "title"))
            .drop("_by_url", "_by_title")
        )

    def drop(self) -> None:
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


class LibraryStore:
    def __init__(self, root: str, buckets: int = BUCKETS) -> None:
        self.store = Store(root)
        self.source = self.store.table("source", S.SOURCE, "id", buckets)
        self.article = self.store.table("article", S.ARTICLE, "source_id", buckets)
        self.page = self.store.table("cached_page", S.CACHED_PAGE, "article_id", buckets)
        self.address = self.store.table("address", ADDRESS, "article_url", buckets)

    def load(self, source: DataFrame, article: DataFrame, page: DataFrame, batch_id: int) -> None:
        """Take over a library, or add rows whose keys are new."""
        with self.store.batch(source.sparkSession, batch_id) as batch:
            if not batch.done:
                rows = article.select(*S.columns(S.ARTICLE))
                for table, part in ((self.source, source.select(*S.columns(S.SOURCE))), (self.article, rows),
                                    (self.page, page.select(*S.columns(S.CACHED_PAGE))),
                                    (self.address, rows.select("article_url", "id", "source_id"))):
                    batch.update(table, part, lambda current, new: current.unionByName(new))

    def delete_sources(self, deleted: DataFrame, batch_id: int) -> None:
        """UPD-08 for the ids of ``deleted``: saved articles move to the hidden source with their
        attribution; the other articles go, with their pages and addresses."""
        with self.store.batch(deleted.sparkSession, batch_id) as batch:
            if not batch.done:
                self._delete(batch, deleted.select("id").distinct())

    def _delete(self, batch: Batch, ids: DataFrame) -> None:
        keys = ids.withColumnRenamed("id", "source_id")
        owned = batch.read(self.article, self.article.touched(keys)).join(keys, "source_id", "left_semi").select(*S.columns(S.ARTICLE))
        source = batch.read(self.source, self.source.touched(ids))
        # Of the rows that the sources own, those that stay are the saved ones, moved.
        moved = M.delete_source(ids, source, owned, batch.read(self.page, set()))["article"].select(*S.columns(S.ARTICLE))
        changes = batch.stage(moved.withColumn("_gone", F.lit(False)).unionByName(
            owned.select("id", "source_id", "article_url").withColumn("_gone", F.lit(True)), allowMissingColumns=True), "changes")
        stays = changes.filter(~F.col("_gone")).select("id")
        gone = changes.filter("_gone").join(stays, "id", "left_anti")
        batch.update(self.article, changes, replace_rows)
        batch.update(self.source, ids, lambda current, rows: current.join(rows, "id", "left_anti"))
        batch.update(self.page, gone.select(F.col("id").alias("article_id")), lambda current, rows: current.join(rows, "article_id", "left_anti"))
        addresses = changes.filter(~F.col("_gone")).select("article_url", "id", "source_id", "_gone").unionByName(
            gone.select("article_url", "id", "source_id", "_gone"))
        batch.update(self.address, addresses, replace_by_key("article_url"))

    def read(self, spark: SparkSession) -> dict[str, DataFrame]:
        """All tables as of one commit."""
        state = self.store.state(Folder(spark, self.store.root))
        tables: dict[str, VersionedTable] = {"source": self.source, "article": self.article, "cached_page": self.page, "address": self.address}
        return {name: table.files(spark, state.get(name, {})) for name, table in tables.items()}
