"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom.session import ensure_checkpoint_dir

WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs reread it from the shared folder, whoever is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Every row with its gapless position (from 0) in the whole order. One shuffle.

    Rows are range-partitioned and sorted, and each takes its partition number and position
    from ``monotonically_increasing_id``; a checkpoint makes that split permanent. Only the
    row count of each partition is gathered. A key with many rows is spread as soon as
    ``order`` ends in a column that tells its rows apart; equal rows stay in some fixed order.
    The input is read twice, to find the bounds and to deal it out: give it a narrow, stored
    table.
    """
    placed = keep(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33).cast("int")
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a partition
    first, shifts = 0, [0] * (1 + max((r["part"] for r in counts), default=0))
    for r in counts:
        shifts[r["part"]] = first
        first += r["count"]
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(rank, at + F.get(F.lit(shifts), part)).drop("_at")
