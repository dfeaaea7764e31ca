"""Directory files, crawl logs and table outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom import schema as S
from feedloom.functions import text as T, urls


def read_directory(spark: SparkSession, path: str, arrays: bool = True) -> DataFrame:
    """SRC-06: every ``.json`` file of a folder, tagged with its file stem.

    Hand-kept files hold one JSON array each. Files written by ``write_directory`` hold one
    object per line, which splits across tasks; read those with ``arrays=False``.
    """
    rows = (
        spark.read.schema(S.DIRECTORY_FEED).option("multiLine", arrays)
        .option("pathGlobFilter", "*.json").json(path)
    )
    stem = F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows.select(
        "id", "name", F.col("feedURL").alias("feed_url"), F.col("siteURL").alias("site_url"), "description",
        "category", "country", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("lastVerified").alias("last_verified"), stem.alias("slug"),
    )


def _as_files(feeds: DataFrame, with_date: bool) -> DataFrame:
    cols = [
        "id", "name", F.col("feed_url").alias("feedURL"), F.col("site_url").alias("siteURL"), "description",
        "category", "country", "tags",
    ]
    return feeds.select(*cols, *([F.col("last_verified").alias("lastVerified")] if with_date else []))


def write_directory(feeds: DataFrame, path: str) -> None:
    """SRC-09: one folder per category slug, sorted by name without regard to case.

    Overwriting the whole path removes the categories that no longer have feeds. A large
    category spans several files, each sorted, split by name range.
    """
    out = _as_files(feeds, True).withColumn("slug", T.slugify(F.col("category")))
    by_name = F.collate(F.col("name"), "UNICODE_CI")
    (
        out.repartitionByRange("slug", "name").sortWithinPartitions("slug", by_name, "id")
        .write.partitionBy("slug").mode("overwrite").json(path)
    )


def published_feeds(feeds: DataFrame) -> DataFrame:
    """SRC-10 rows: no verification date, secure addresses, sorted by name."""
    d = feeds.withColumn("feed_url", urls.upgrade_https(F.col("feed_url"))).withColumn(
        "site_url", urls.upgrade_https(F.col("site_url"))
    )
    return _as_files(d, False).orderBy(F.collate(F.col("name"), "UNICODE_CI"), "id")


def publish_directory(feeds: DataFrame, path: str) -> None:
    published_feeds(feeds).write.mode("overwrite").json(path)


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: crawl results as a table; column pruning keeps bodies out of narrow reads."""
    return spark.read.schema(S.FETCH_LOG).parquet(path)


def stream_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(S.FETCH_LOG).parquet(path)


def latest_attempt(log: DataFrame, key: str = "url") -> DataFrame:
    """The last attempt per address."""
    payload = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*payload), "attempt").alias("_r")).select(key, "_r.*")


def valid_page(log: DataFrame) -> DataFrame:
    """FLT-06: answers that can be an article page."""
    return log.filter(
        (F.col("status") == 200) & F.lower("content_type").contains("text/html")
        & (F.octet_length("body") > 1000)
    )


def write_library(df: DataFrame, path: str, bucket: str = "source_id", buckets: int = 64) -> None:
    """Article table output, split by a hash of the source so that reads prune by source.

    A hot source still writes many files: rows spread over tasks by source and id.
    """
    out = df.withColumn("source_bucket", F.pmod(F.xxhash64(bucket), F.lit(buckets)).cast("int"))
    out.write.partitionBy("source_bucket").mode("overwrite").parquet(path)
