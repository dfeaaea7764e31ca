"""Nearest neighbours by several shifted Hilbert orderings of projected vectors.

Each ordering projects the vectors on a few random directions, shifts the grid and sorts by the
Hilbert index of the cells; Spark range-partitions all orderings at once. A query's window in an
ordering is a fixed share of its rows around it. Windows are met in blocks of rows: every group
that is compared has at most ``BLOCK`` candidates and ``BLOCK * SPREAD`` rows' queries. The best
of all windows are merged and ranked by the exact cosine.

Rows with equal vectors are one point of the orderings, which stands for its smallest ids: with
ties going to smaller ids, no others can be among the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import keep, ranked
from feedloom.llm.hilbert import hilbert_index
from feedloom.operators.skew import top_k

ORDERINGS = 4
SHARE = 0.4  # of the rows of an ordering that a window holds
DIRECTIONS, BITS = 4, 8
BLOCK = 2048
SPREAD = 50  # a chunk of queries comes from so many blocks
AT_ONCE = 1024  # queries that meet a block at once


def projection(ordering: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal directions and the shift of the grid, fixed by the ordering's number."""
    rng = np.random.default_rng([20240, ordering])
    m = min(DIRECTIONS, dims)
    return np.linalg.qr(rng.standard_normal((dims, m)))[0], rng.uniform(0, 0.3, m)


def curve_keys(units: np.ndarray, ordering: int) -> np.ndarray:
    """Hilbert index of unit vectors. The grid spans a few deviations of a random direction."""
    directions, shift = projection(ordering, units.shape[1])
    reach = 5 / np.sqrt(units.shape[1])
    cells = ((units @ directions / reach + 1) / 2 + shift) / 1.3 * (1 << BITS)
    return hilbert_index(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, of vectors as they are."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _best(k: int):
    """The best classes of a block for each query of a chunk."""
    def best(candidates, queries):
        import pandas as pd

        out = []
        if len(candidates) and len(queries):
            candidates = candidates.sort_values(["first", "cls"])
            ids, firsts, vectors = candidates["cls"].to_numpy(), candidates["first"].to_numpy(), _matrix(candidates["vector"])
            units = _units(vectors)
            for a in range(0, len(queries), AT_ONCE):
                part = queries.iloc[a:a + AT_ONCE]
                mine = _matrix(part["vector"])
                near = _units(mine) @ units.T
                n = min(k, near.shape[1])
                # Ids ascend, and the sort is stable: of equal nearness the smaller id is first.
                top = np.argsort(-near, axis=1, kind="stable")[:, :n] if near.shape[1] <= 4 * k else _top(near, n)
                q = np.repeat(np.arange(len(part)), n)
                c = top.ravel()
                out.append(pd.DataFrame({"qcls": part["cls"].to_numpy()[q], "ccls": ids[c], "first": firsts[c], "score": cosine(mine[q], vectors[c])}))
        none = {c: pd.Series(dtype=t) for c, t in (("qcls", "int64"), ("ccls", "int64"), ("first", "int64"), ("score", "float64"))}
        return pd.concat(out) if out else pd.DataFrame(none)

    return best


def _top(near: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n greatest of each row, in order; ties to the left, also at the border."""
    least = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n]
    order = np.where(near >= least[:, None], -near, np.inf)
    row, col = np.nonzero(near >= least[:, None])
    by = np.lexsort((col, order[row, col], row))
    row, col = row[by], col[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return col[place < n].reshape(len(near), n)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5,
           orderings: int = ORDERINGS, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    Queries are the rows whose id is divisible by ``every``; candidates all rows with another
    id. Rows with a null id, and vectors that are null, zero, hold null or non-finite
    components, or have another length than most, take no part. Repeated rows of one id are
    candidates each; a query id with several vectors is searched by each and keeps the nearest.
    Other columns are not read.
    """
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0))
    length = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = keep(usable.filter(F.size("vector") == (length["n"] if length else 0)))
    # A point has a number of its own, since an id may have several vectors.
    points = keep(rows.groupBy("vector").agg(F.min("id").alias("first")).withColumn("cls", F.monotonically_increasing_id()))
    n = points.count()
    of = rows.join(points, "vector").select("id", "cls")
    members = top_k(of, ["cls"], [F.col("id")], k + 1).select(F.col("cls").alias("ccls"), F.col("id").alias("vec_id"))
    queries = of.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("cls").alias("qcls")).distinct()

    def keys(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            units = _units(_matrix(batch.column(1).to_pylist())) if batch.num_rows else None
            for r in range(orderings if batch.num_rows else 0):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, r, np.int32)), pa.array(curve_keys(units, r)), batch.column(0)], names=["o", "key", "cls"])

    placed = ranked(keep(points.select("cls", "vector").mapInArrow(keys, "o int, key long, cls long")), [F.col("o"), F.col("key"), F.col("cls")], "at")
    placed = placed.select("o", "cls", (F.col("at") - F.col("o") * n).alias("at"))  # position in its ordering
    width = max(1, min(n, int(np.ceil(share * n))))
    asking = placed.join(queries.select(F.col("qcls").alias("cls")).distinct(), "cls")
    low = F.least(F.greatest(F.col("at") - width // 2, F.lit(0)), F.lit(max(0, n - width)))
    asking = asking.withColumn("low", low).select(
        "o", "cls", F.expr(f"at div {block * SPREAD}L").alias("chunk"),
        F.explode(F.sequence(F.expr(f"low div {block}L"), F.expr(f"(low + {width - 1}L) div {block}L"))).alias("block"))
    meets = asking.select("o", "block", "chunk").distinct()
    blocks = placed.select("o", "cls", F.expr(f"at div {block}L").alias("block")).join(meets, ["o", "block"]).join(points, "cls")
    asking = asking.join(points.select("cls", "vector"), "cls")
    # New column names' ids: both sides come from the same tables.
    blocks, asking = blocks.toDF(*blocks.columns), asking.toDF(*asking.columns)
    found = blocks.groupBy("o", "block", "chunk").cogroup(asking.groupBy("o", "block", "chunk")).applyInPandas(
        _best(k + 1), "qcls long, ccls long, first long, score double")
    best = top_k(found.groupBy("qcls", "ccls", "first").agg(F.max("score").alias("score")), ["qcls"],
                 [F.desc("score"), F.col("first"), F.col("ccls")], k + 1)
    near = best.drop("rn", "first").join(queries, "qcls").join(members, "ccls").filter(F.col("vec_id") != F.col("query_id"))
    return top_k(near, ["query_id"], [F.desc("score"), F.col("vec_id")], k, "rank").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
