"""Vectors as integers, and gapless numbers for the rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import keep

MOST = float(1 << 60)  # integers beyond are held to this


def finite(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, vector) without the vectors that are null, empty, hold null or non-finite
    components, or have another length than most (of equally frequent lengths, the least)."""
    usable = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(
        F.col("vector").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    length = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return usable.filter(F.size("vector") == (length["n"] if length else 0))


def floored(vector: Column, scale: int = 64, plus: int = 0) -> Column:
    """floor(scale * x) + plus of each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(MOST)), F.lit(-MOST))) + F.lit(plus).cast("long"))


def numbered(df: DataFrame, number: str = "at") -> DataFrame:
    """Every row with a number from 0, gapless, in no stated order. No shuffle.

    A checkpoint makes the split into partitions permanent; only the row count of each
    partition is gathered.
    """
    placed = keep(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a partition
    first, shifts = 0, [0] * (1 + max((r["part"] for r in counts), default=0))
    for r in counts:
        shifts[r["part"]] = first
        first += r["count"]
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(number, at + F.get(F.lit(shifts), part)).drop("_at")
