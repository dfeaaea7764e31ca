"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import keep


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): each node of an edge with the smallest node of its component.

    Edges are undirected; loops, repeats and nulls add nothing. Every node hands its neighbours
    the smallest node it knows of: larger neighbours in the large star, smaller ones and itself
    in the small star. Both keep components whole, and the edges end as stars around the
    smallest nodes after about log(nodes) rounds. Each round is a minimum per node, which tasks
    pre-aggregate, and a join on the node, whose hot nodes Spark splits. Rounds are stored.
    """
    known = keep(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = None
    while (state := _state(known)) != before:
        before = state
        known = keep(_small_star(keep(_large_star(known))))
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    larger = both.filter(F.col("v") > F.col("u"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))  # u is the larger end of every edge
    smaller = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.union(least.select("u", F.col("m").alias("v"))).distinct()
