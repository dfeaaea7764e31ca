"""Home screen: the balanced reading list joined with each source's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.catalog import derive
from feedloom.catalog.registry import big, ts
from feedloom.functions import text
from feedloom.operators import library as L


def home_list(article: DataFrame, source: DataFrame) -> DataFrame:
    latest = L.balanced_latest(article)
    summary = L.source_summary(article)
    names = source.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"))
    return (
        latest.join(summary, "source_id").join(names, "source_id")
        .withColumn("reading_time", text.format_minutes(F.col("reading_minutes_total")))
        .orderBy("turn", F.col("source_newest").desc(), "source_id")
    )


def home_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return home_list(derive.article(spark, sf_dir), derive.source(spark, sf_dir)).select(
        "id", "title", "source_id", "source_title", big("turn"), ts("source_newest"),
        big("article_count"), big("unread_count"), big("reading_minutes_total"), "reading_time",
    )
