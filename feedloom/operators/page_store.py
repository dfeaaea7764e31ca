"""Tables of one page job, stored between its steps.

A checkpoint holds rows as they are in memory and loses how they were dealt out, so that every
step that reads it hashes the rows by page again. Here they lie compressed, one bucket of pages a
file, each in page order: steps read the columns they need and neither shuffle nor sort them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from feedloom.session import shared_dir, with_settings
from feedloom.streaming.tables import STORED, Folder

# Bytes of input files that a bucket holds at most, and at least if the session asks for more partitions.
# Its node rows take some twenty times that in memory, more where the files are packed tighter.
BUCKET_BYTES, LEAST_BYTES = 2 << 20, 256 << 10
# What a shuffle moves in blocks is maps times buckets: beyond this many, buckets grow instead.
MOST_BUCKETS = 4096
# A plan's size where Spark knows none.
UNKNOWN_BYTES = 1 << 50

_SETTINGS = {
    "spark.sql.constraintPropagation.enabled": "false",  # as for materialize()
    # Buckets are single sorted files, so their order holds.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # Compressed node rows are many times larger in memory, where broadcasts go.
    "spark.sql.sources.fileCompressionFactor": "8.0",
}


def bucket_count(pages: DataFrame) -> int:
    """Buckets for the pages of an input, all cores' worth at least."""
    spark = pages.sparkSession
    cores, asked = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_BYTES:
        return max(cores, asked)
    needed = max(size // BUCKET_BYTES + 1, min(asked, size // LEAST_BYTES))
    return max(cores, min(cores * -(-needed // cores), MOST_BUCKETS))


class PageStore:
    """Stored tables that have ``page_id``, for as long as the ``with`` block; results stay."""

    def __init__(self, pages: DataFrame) -> None:
        self.spark, self.buckets = pages.sparkSession, bucket_count(pages)
        # What is joined with the tables is dealt out as they are; with another count Spark may deal them anew.
        self._settings = _SETTINGS | {"spark.sql.shuffle.partitions": str(self.buckets)}
        self.root = f"{shared_dir(self.spark)}/pages-{uuid.uuid4().hex}"
        self._folder = Folder(self.spark, self.root)

    def __enter__(self) -> PageStore:
        return self

    def __exit__(self, *_) -> None:
        for name in self._folder.names(""):
            if not name.startswith("result"):
                self.drop(name)

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """Store rows that are dealt out as the buckets are."""
        order = [c for c in ("page_id", "pre") if c in rows.columns]
        table = f"{name}_{uuid.uuid4().hex}"
        with with_settings(self.spark, self._settings):
            rows.write.option("compression", STORED).bucketBy(self.buckets, "page_id").sortBy(*order).option(
                "path", f"{self.root}/{name}").saveAsTable(table)
        kept = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # its name; the files stay, and ``kept`` reads them
        return kept

    def drop(self, name: str) -> None:
        self._folder.remove(name)

    def result(self, rows: DataFrame) -> DataFrame:
        """Store rows that outlast the other tables."""
        path = f"{self.root}/result"
        with with_settings(self.spark, self._settings):
            rows.write.option("compression", STORED).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
