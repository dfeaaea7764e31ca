"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.session import ensure_checkpoint_dir

SALTS = 16


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key.

    Phrased as ``row_number() <= k``: Spark then adds a group limit before the shuffle, so
    each map task sends at most ``k`` rows of a key, however hot the key is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def lookup(
    big: DataFrame, small: DataFrame, on: list[str], how: str, spread: str, salts: int = SALTS
) -> DataFrame:
    """Join a large table with one that has one row per key, spreading hot keys.

    The small side is repeated once per salt, the large side picks a salt from ``spread``
    (a row identifier). No side is hinted: Spark broadcasts the small side only where its
    measured size allows, and otherwise the salted keys keep the shuffle even.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def beyond_top_k(df: DataFrame, keys: list[str], order: str, tie: str, k: int) -> DataFrame:
    """Rows past the newest ``k`` per key, newest first by ``order``, then ``tie`` ascending.

    Ranking a whole hot key in one task is avoided: the k-th row of each key is found with
    the pre-limited rank, and all rows are compared with that cutoff.
    """
    w = [F.col(order).desc(), F.col(tie)]
    cut = (
        top_k(df.select(*keys, order, tie), keys, w, k)
        .filter(F.col("rn") == k)
        .select(*keys, F.col(order).alias("_cut"), F.col(tie).alias("_cut_tie"))
    )
    past = (F.col(order) < F.col("_cut")) | (
        (F.col(order) == F.col("_cut")) & (F.col(tie) > F.col("_cut_tie"))
    )
    return lookup(df, cut, keys, "inner", tie).filter(past).drop("_cut", "_cut_tie")


def rank_within(df: DataFrame, key: str, order: list[Column], rank: str = "rn") -> DataFrame:
    """Exact rank of every row within its key, without a cap and without one task per key.

    Rows are range-partitioned by key and order, so a hot key spans many partitions. The
    partition number is made permanent with a reliable checkpoint; ranks are counted inside
    each partition and shifted by the rows of the key in the partitions before it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (
        df.repartitionByRange(F.col(key), *order)
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    inside = Window.partitionBy("_part", key).orderBy(*order)
    # One row per (partition, key): as many rows as partitions plus keys.
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        ranged.groupBy("_part", key).agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        ranged.withColumn("_local", F.row_number().over(inside))
        .join(shift, ["_part", key])
        .withColumn(rank, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .drop("_part", "_local", "_shift")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """One row per key, the least by ``order``. A minimum, so map tasks pre-aggregate."""
    ordering = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    picked = F.min_by(F.struct(*payload), ordering).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")
