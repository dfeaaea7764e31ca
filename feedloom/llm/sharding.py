"""Shards cut from the Hilbert order of several metadata columns.

Each column is quantised to a grid, rows are ordered by the curve index of their cells, and the
order is cut into runs of equal row counts. A shard then spans few cells in every column, so a
predicate on any of them prunes whole shards by the ranges in ``manifest``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from feedloom.llm.common import keep, ranked
from feedloom.llm.hilbert import hilbert_index
from feedloom.operators.skew import lookup

BITS = 5
ACCURACY = 10_000


def quantised(rows: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """A cell from 0 to 2**bits - 1 for each column.

    Numbers go by approximate quantiles of the whole column, so that cells have about equal row
    counts however the values lie; other types go by a hash, which needs no table of values.
    A null is in cell 0.
    """
    cells = 1 << bits
    numbers = [d for d in dims if isinstance(rows.schema[d].dataType, NumericType)]
    shares = [k / cells for k in range(1, cells)]
    cuts = rows.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, ACCURACY).alias(d) for d in numbers]).first() if numbers else {}

    def cell(d: str) -> Column:
        if d not in numbers:
            return F.coalesce(F.pmod(F.xxhash64(F.col(d).cast("string")), F.lit(cells)).cast("int"), F.lit(0))
        edges = sorted(set(cuts[d] or []))
        value = F.col(d).cast("double")
        return sum((F.coalesce(value > e, F.lit(False)).cast("int") for e in edges), F.lit(0)) if edges else F.lit(0)

    return [cell(d).alias(d) for d in dims]


def curve(cells: Column, bits: int = BITS) -> Column:
    """Curve index of an array of cells."""
    @F.pandas_udf("long")
    def index(batch):
        import pandas as pd

        return pd.Series(hilbert_index(np.stack(batch.to_numpy()), bits) if len(batch) else [], dtype="int64")

    return index(cells)


def shard(rows: DataFrame, dims: list[str], shards: int, tie: list[str], bits: int = BITS) -> DataFrame:
    """Adds ``curve``, ``shard`` and ``slot`` to narrow rows; columns of these names are replaced.

    Shard row counts differ by one at most, slots are gapless from 0 in each shard. Rows with
    one curve index follow in the order of ``tie``; a hot cell is cut like any other run. Equal
    rows each get a slot; an empty table stays empty. ``rows`` is stored once, before the
    columns' quantiles are taken, so that what makes it runs once.
    """
    rows = keep(rows.drop("curve", "shard", "slot"))
    placed = rows.withColumn("curve", curve(F.array(*quantised(rows, dims, bits)), bits))
    out = ranked(keep(placed), [F.col("curve"), *map(F.col, tie)], "_rank")
    n = rows.count()
    if not n:
        return out.drop("_rank").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    number = F.expr(f"cast((_rank * {shards}L) div {n}L as int)")
    first = F.expr(f"({n}L * shard + {shards - 1}L) div {shards}L")
    return out.withColumn("shard", number).withColumn("slot", F.col("_rank") - first).drop("_rank")


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """One row a shard: rows, and the least and greatest value of each column."""
    ends = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *ends)


def write(table: DataFrame, sharded: DataFrame, key: str, path: str) -> None:
    """The table's rows as Parquet, a folder for each shard, in slot order.

    Rows meet their shard by a unique key. A shard's rows go to several tasks by slot, so that no
    task or file grows with the shard.
    """
    spread = F.floor(F.col("slot") / 1_000_000)
    (
        table.join(sharded.select(key, "shard", "slot"), key)
        .repartition(F.col("shard"), spread).sortWithinPartitions("shard", "slot")
        .write.mode("errorifexists").partitionBy("shard").parquet(path)
    )


def together(rows: DataFrame, group: list[str], dims: list[str], order: list[str]) -> DataFrame:
    """Adds ``like_<dim>``: each column's value in the least row, by ``order``, of the group.

    Rows of a group so share a cell, and with the group's columns first in the tie order they
    stand side by side. Null group columns are a value of their own. A hot group is spread.
    """
    key = F.xxhash64(*group)  # groups that it mixes up share a cell, no more
    least = rows.withColumn("_key", key).groupBy("_key").agg(F.min(F.struct(*order, *dims)).alias("_least"))
    least = least.select("_key", *[F.col("_least")[d].alias(f"like_{d}") for d in dims])
    return lookup(rows.withColumn("_key", key), least, ["_key"], "inner", order[0]).drop("_key")


def document_rows(docs: DataFrame) -> DataFrame:
    """What ordering documents needs: id, size (UTF-8 bytes of the text and 8), checksums, metadata."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("text_hash"),
        F.col("source").alias("source"), F.col("lang").alias("lang"))
