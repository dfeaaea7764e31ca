"""Exact top-k by integer inner product: a uniform threshold in three phases.

The components are dealt to ``SLICES`` lists. In a list a candidate has the part of its score
that the list's components make, so a score is a sum over the lists, and no place holds it whole.

1. Every block of a list gives each query its best entries. The exact scores of these
   candidates give each query a safe cutoff: its (k + 1)-th best of them.
2. A score of at least the cutoff has a part of at least ``cutoff / SLICES`` in some list. Each
   list gives all entries that reach it. Scores known in all lists raise the cutoff; with a list
   missing, what it may add is less than the threshold, which rules most candidates out.
3. The parts that are still missing are looked up, and the best exact scores are the result.

Components are moved by whole numbers close to their means. That changes all scores of a query
alike, keeps them whole, and brings parts of lists about zero, where the threshold cuts best.

Queries meet candidates in tiles of bounded size, of one list each. Rows with equal integer
vectors are one candidate, which stands for its least ids, and one query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from feedloom.llm.common import keep
from feedloom.llm.vectors import finite, floored, numbered
from feedloom.operators.skew import lookup, top_k

SLICES = 2
DEPTH = 4  # so many times k entries a query and list, at least, in the first phase
BLOCK = 4096  # candidates of a tile
CHUNK = 2048  # queries of a tile
AT_ONCE = 256  # queries whose parts are in memory at once

_TILE = ["slice", "block", "chunk"]
_ENTRY = "q long, c long, slice int, part long"


def _bundles(rows: DataFrame, number: str, size: int, centre: list[int], slices: int) -> DataFrame:
    """Rows (bundle, slice, data) of up to ``size`` numbered vectors: the list's components."""
    def bundle(pdf):
        import pandas as pd

        x = np.stack(pdf.sort_values(number)["x"].to_numpy()).astype(np.int64) - np.array(centre, np.int64)
        n = int(pdf["bundle"].iloc[0])
        return pd.DataFrame([(n, s, np.ascontiguousarray(x[:, s::slices]).tobytes()) for s in range(slices)], columns=["bundle", "slice", "data"])

    return rows.select(number, "x", F.expr(f"{number} div {size}L").alias("bundle")).groupBy("bundle").applyInPandas(
        bundle, "bundle long, slice int, data binary")


class _Parts:
    """A tile's vectors: parts of scores of any of its queries and candidates."""

    def __init__(self, pdf, dims: list[int], exact_double: bool, block: int, chunk: int):
        first = pdf.iloc[0]
        self.slice, self.q0, self.c0 = int(first["slice"]), int(first["chunk"]) * chunk, int(first["block"]) * block
        kind = np.float64 if exact_double else np.int64
        data = {int(k): np.frombuffer(d, np.int64).reshape(-1, dims[self.slice]).astype(kind) for k, d in zip(pdf["kind"], pdf["data"])}
        self.candidates, self.queries = data[0], data[1]

    def portions(self):
        """(first query, its parts and those of the queries after it, with all candidates)."""
        for a in range(0, len(self.queries), AT_ONCE):
            yield a, self.queries[a:a + AT_ONCE] @ self.candidates.T

    def entries(self, found):
        import pandas as pd

        q, c, part = ([np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3)
        return pd.DataFrame({"q": q + self.q0, "c": c + self.c0, "slice": np.int32(self.slice), "part": part.astype(np.int64)})

    def pairs(self, q, c):
        q, c = q.to_numpy(np.int64) - self.q0, c.to_numpy(np.int64) - self.c0
        at = range(0, len(q), 1 << 16)
        return self.entries([(q[a:a + (1 << 16)], c[a:a + (1 << 16)],
                              (self.queries[q[a:a + (1 << 16)]] * self.candidates[c[a:a + (1 << 16)]]).sum(axis=1)) for a in at])


def _best(depth: int, *kind):
    def best(pdf):
        tile = _Parts(pdf, *kind)
        n, found = min(depth, len(tile.candidates)), []
        for a, parts in tile.portions():
            c = np.argpartition(parts, parts.shape[1] - n, axis=1)[:, parts.shape[1] - n:]
            found.append((np.repeat(np.arange(a, a + len(parts)), n), c.ravel(), np.take_along_axis(parts, c, 1).ravel()))
        return tile.entries(found)

    return best


def _reaching(*kind):
    """All entries of a list that reach their query's threshold; without one, all."""
    def reaching(pdf, cuts):
        import pandas as pd

        if not len(pdf) or not len(cuts):
            return pd.DataFrame({"q": [], "c": [], "slice": [], "part": []}).astype({"q": "int64", "c": "int64", "slice": "int32", "part": "int64"})
        tile, found = _Parts(pdf, *kind), []
        least = cuts.sort_values("q")["least"]
        free, least = least.isna().to_numpy(), least.fillna(0).to_numpy(np.int64)
        for a, parts in tile.portions():
            q, c = np.nonzero((parts >= least[a:a + len(parts), None]) | free[a:a + len(parts), None])
            found.append((q + a, c, parts[q, c]))
        return tile.entries(found)

    return reaching


def _looked_up(*kind):
    def looked_up(pdf, pairs):
        import pandas as pd

        if not len(pdf) or not len(pairs):
            return pd.DataFrame({"q": [], "c": [], "slice": [], "part": []}).astype({"q": "int64", "c": "int64", "slice": "int32", "part": "int64"})
        return _Parts(pdf, *kind).pairs(pairs["q"], pairs["c"])

    return looked_up


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, every: int = 20, k: int = 20,
           slices: int = SLICES, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` highest scores, exactly.

    A component x counts as floor(scale * x). Queries are the rows whose id is divisible by
    ``every``; candidates all rows with another id; ties go to the smaller id. Rows with a null
    id take no part, nor vectors that are null, empty, hold null or non-finite components, or
    have another length than most. Of several rows of one id that with the least vector counts.
    A query with fewer candidates than ``k`` has them all; an empty table gives no rows. Other
    columns are not read. Components are held to 2^60 either way; where scores may pass 2^53,
    one list holds all components and sums wrap as 64-bit integers do.
    """
    named = finite(vectors, id_col, vector_col).select(F.col("id").cast("long").alias("id"), floored(F.col("vector"), scale).alias("x"))
    rows = keep(named.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("x").alias("x")))
    points = numbered(rows.groupBy("x").agg(F.min("id").alias("first")))
    spans = points.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(
        F.avg("v").alias("mean"), F.max(F.abs("v")).alias("most")).orderBy("pos").collect()  # one row a component
    most = max((r["most"] for r in spans), default=0)
    exact_double = 2 * len(spans) * most * most < 1 << 53
    slices = max(1, min(slices, len(spans))) if exact_double else 1
    centre = [round(r["mean"]) if exact_double else 0 for r in spans]
    kind = [len(range(s, len(spans), slices)) for s in range(slices)], exact_double, block, chunk
    of = keep(rows.join(points.select("x", F.col("at").alias("c")), "x").select("id", "c"))
    asked = of.filter(F.col("id") % every == 0)
    asks = numbered(points.join(asked.select(F.col("c").alias("at")).distinct(), "at"), "q")
    n, blocks, chunks = points.count(), 0, 0
    if n:
        blocks, chunks = -(-n // block), -(-asks.count() // chunk)
    if not chunks:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("c").alias("vec_id"), F.col("c").alias("score")).limit(0)

    # Every block meets every chunk: both are repeated, so that tiles spread evenly.
    one = _bundles(points, "at", block, centre, slices).select(
        "slice", F.col("bundle").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(0).alias("kind"), "data")
    other = _bundles(asks, "q", chunk, [0] * len(spans), slices).select(
        "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.col("bundle").alias("chunk"), F.lit(1).alias("kind"), "data")
    tiles = keep(one.unionByName(other).repartition(*_TILE)).groupBy(*_TILE)

    def placed(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("block", F.expr(f"c div {block}L")).withColumn("chunk", F.expr(f"q div {chunk}L"))

    def summed(entries: DataFrame) -> DataFrame:
        """One row a pair: its score so far, and the lists that are in it."""
        return entries.groupBy("q", "c").agg(F.sum("part").alias("score"), F.bit_or(F.expr("shiftleft(1, slice)")).alias("have"))

    def resolved(pairs: DataFrame) -> DataFrame:
        """The same pairs with the parts of all lists in their scores."""
        lists = F.array(*[F.when(F.col("have").bitwiseAND(F.lit(1 << s)) == 0, F.lit(s)) for s in range(slices)])
        missing = placed(pairs.select("q", "c", F.explode(F.array_compact(lists)).alias("slice")))
        parts = tiles.cogroup(missing.groupBy(*_TILE)).applyInPandas(_looked_up(*kind), _ENTRY)
        return pairs.select("q", "c", "score").union(parts.select("q", "c", "part")).groupBy("q", "c").agg(F.sum("score").alias("score"))

    def reached(scores: DataFrame) -> DataFrame:
        """The (k + 1)-th best score of each query that has as many: one may be its own."""
        return top_k(scores, ["q"], [F.desc("score")], k + 1).filter(F.col("rn") == k + 1).select("q", F.col("score").alias("cut"))

    depth = min(k + 1, -(-DEPTH * (k + 1) // blocks))
    first = keep(summed(tiles.applyInPandas(_best(depth, *kind), _ENTRY)))
    cuts = keep(asks.select("q").join(reached(resolved(first)), "q", "left")
                .withColumn("least", F.expr(f"cut div {slices}L + if(cut % {slices}L > 0, 1L, 0L)")))  # rounded up
    told = cuts.select("q", "least", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.expr(f"q div {chunk}L").alias("chunk")
                       ).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = keep(summed(tiles.cogroup(told.groupBy(*_TILE)).applyInPandas(_reaching(*kind), _ENTRY)))
    whole = F.col("have") == (1 << slices) - 1
    cuts = cuts.join(reached(found.filter(whole)).withColumnRenamed("cut", "cut2"), "q", "left").select(
        "q", "least", F.greatest("cut", "cut2").alias("cut"))
    unseen = F.lit(slices) - F.bit_count("have")
    alive = keep(found.join(cuts, "q").filter(
        F.col("cut").isNull() | (F.col("score") + F.when(whole, F.lit(0)).otherwise(unseen * (F.col("least") - 1)) >= F.col("cut"))))
    scores = alive.filter(whole).select("q", "c", "score").union(resolved(alive.filter(~whole).select("q", "c", "score", "have")))

    # Ties at the border stay until their least ids are known.
    leading = scores.withColumn("place", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("place") <= k + 1)
    leading = leading.join(points.select(F.col("at").alias("c"), "first"), "c")
    leading = top_k(leading, ["q"], [F.desc("score"), F.col("first")], k + 1).select("q", "c", "score")
    members = top_k(of, ["c"], [F.col("id")], k + 1).select("c", "id")
    near = top_k(leading.join(members, "c"), ["q"], [F.desc("score"), F.col("id")], k + 1)
    near = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rn", "id", "score"))).alias("near"))  # k + 1 a query
    moved = F.aggregate(F.zip_with("x", F.lit(centre), lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v) if exact_double else F.lit(0).cast("long")
    near = near.join(asks.select("q", F.col("at").alias("c"), moved.alias("moved")), "q").select("c", "near", "moved")
    mine = lookup(asked.select(F.col("id").alias("query_id"), "c"), near, ["c"], "inner", "query_id")
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", "moved", F.posexplode(others).alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (F.col("e.score") + F.col("moved")).alias("score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
