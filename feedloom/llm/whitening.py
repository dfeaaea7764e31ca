"""Whitening of embeddings along the leading components of their covariance.

Spark makes four passes over narrow rows, none of which shuffles a vector: exact sums of each
dimension, sums of products of centred rows, the check of the result, and the result itself.
Every task adds up its rows and gives one number for each pair of dimensions, so the driver sees
a matrix of dimensions only, whatever the number of rows. The eigenpairs of that matrix are
found there by slicing its spectrum (``llm/spectrum.py``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.spectrum import leading
from feedloom.llm.vectors import finite, floored

COMPONENTS = 32


def _vectors(column) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(rows: DataFrame, of, kind: str = "double") -> list:
    """Sums over all rows of what ``of`` makes from a matrix of some of them, in order.

    Every task gives its own totals once, whatever the number of its batches.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_vectors(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            whole = kind != "double"
            values = pa.array([str(v) for v in total]) if whole else pa.array(np.asarray(total, float))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], names=["pos", "v"])

    told = rows.select("x").mapInArrow(run, f"pos int, v {'double' if kind == 'double' else 'string'}")
    return [r["v"] for r in told.groupBy("pos").agg(F.sum(F.col("v").cast(kind)).alias("v")).orderBy("pos").collect()]


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows, and each dimension's exact sum, of ``x`` (array of long)."""
    def add(x: np.ndarray) -> np.ndarray:
        most = int(np.abs(x).max())
        told = x.sum(axis=0) if most * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
        return np.array([len(x), *[int(v) for v in told]], object)

    got = [int(v) for v in _added(rows, add, "decimal(38,0)")]
    return (got[0], got[1:]) if got else (0, [])


def _centred(n: int, total: list[int]):
    """Function from x to x - S/n in doubles; the whole part of S/n goes first, exactly."""
    whole = np.array([s // n for s in total], np.int64)
    part = np.array([(s % n) / n for s in total])
    return lambda x: (x - whole).astype(float) - part


def _products(rows: DataFrame, n: int, total: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Covariance of x, or of its centred rows times ``project``, with divisor n."""
    centre, width = _centred(n, total), len(total) if project is None else project.shape[1]

    def add(x: np.ndarray) -> np.ndarray:
        y = centre(x) if project is None else centre(x) @ project
        y = np.column_stack([y, np.ones(len(y))])
        return (y.T @ y).ravel()

    got = np.array(_added(rows, add)).reshape(width + 1, width + 1) / n
    mean = got[:width, width]  # what rounding left
    return got[:width, :width] - np.outer(mean, mean)


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2, exact; null where they pass 64 bits."""
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([s % n for s in total], object)
    y = x - whole
    if (int(np.abs(y).max(initial=0)) + 1) ** 2 * n * n * len(total) < 1 << 63:
        return ((n * y - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in ((n * y.astype(object) - rest) ** 2).sum(axis=1)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, plus: int = 1_000_000,
           most: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one for each
    vector that takes part and each component up to ``most``.

    A component c of a vector counts as the long x = floor(scale * c) + plus. Vectors that are
    null, empty, hold null or non-finite components, or have another length than most take no
    part. Null and repeated ids are kept: each row is a vector. There are as many components as
    the covariance has eigenvalues above 1e-10 of the first, ``most`` at most: vectors that are
    all equal, or a single one, give no rows, as does an empty table. ``deviation`` is null
    where it passes 64 bits. Components are held to 2^60 either way. Other columns are not read.
    """
    rows = finite(vectors, id_col, vector_col).select(F.col("id").alias(id_col), floored(F.col("vector"), scale, plus).alias("x"))
    n, total = sums(rows)
    covariance = _products(rows, n, total) if n else np.zeros((0, 0))
    values, axes = leading(covariance, most)
    project = axes / np.sqrt(values)
    count = len(values)
    error = float(np.abs(_products(rows, n, total, project) - np.eye(count)).max()) if count else 0.0
    explained = values / np.trace(covariance) if count else values
    centre = _centred(n, total) if n else None

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x = _vectors(batch.column(1))
            rows_, ids = len(x), np.repeat(np.arange(len(x)), count)
            deviation = pa.array(_deviation(x, n, total), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(ids)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows_)),
                pa.array(np.full(rows_ * count, n, np.int64)), deviation.take(pa.array(ids)), pa.array((centre(x) @ project).ravel()),
                pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * count, error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
