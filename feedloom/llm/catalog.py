"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.llm import (
    ann, bpe, compress_quality, langid, lexical, line_blocks, packing, quality_rules, roles, sharding, simhash, threshold_search, whitening,
)
from feedloom.llm.common import keep, table
from feedloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
    return fn


@query
def op1_hilbert_shards(spark, sf_dir):
    rows = keep(sharding.document_rows(table(spark, sf_dir, "documents")))
    # Equal texts share a cell: of a group's rows only a cut between two shards parts them.
    rows = sharding.together(rows, ["text_hash", "text_crc32", "size"], ["source", "lang"], ["doc_id"])
    placed = sharding.shard(rows, ["like_source", "like_lang", "size"], 24, ["text_crc32", "text_hash", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, table(spark, sf_dir, "labels")).drop("text")


@query
def op3_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op4_role_repair(spark, sf_dir):
    return roles.repair(table(spark, sf_dir, "conversations"))


@query
def op5_hilbert_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


@query
def op6_line_blocks(spark, sf_dir):
    return line_blocks.extract(table(spark, sf_dir, "pages"))


@query
def op7_simhash_golay(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_language_fusion(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op9_compression_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return compress_quality.score(docs, compress_quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query
def op11_uniform_threshold(spark, sf_dir):
    return threshold_search.search(table(spark, sf_dir, "embeddings"))


@query
def op12_spectrum_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_dual_tree(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can state; tests/llm compares the others with brute force."""
    return {"op11_uniform_threshold": threshold_search.SQL, "op13_dual_tree": lexical.SQL}
