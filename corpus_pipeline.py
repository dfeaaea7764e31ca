"""A training corpus in four stages: classified, ruled, free of near-duplicates, packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import compress_quality, packing, quality_rules, simhash
from feedloom.llm.common import table
from feedloom.session import configure, shared_dir
from feedloom.streaming.tables import Folder


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score reaches the threshold.

    Null and empty texts share one score; repeated rows stay or go together; an empty table
    stays empty. All columns are kept as they are, whatever their names.
    """
    model = compress_quality.fit(docs, table(configure(spark), sf_dir, "labels"))
    return compress_quality.accepted(docs, model)


def rule(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams resemble the trusted ones'.

    Null, empty and very short texts fail the base rules; repeated rows stay or go together; an
    empty table stays empty. All columns are kept as they are, whatever their names.
    """
    return quality_rules.accepted(docs, table(configure(spark), sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id (null last).

    Texts without words, null ones included, are one group; of repeated rows one stays; an empty
    table stays empty. All columns are kept as they are, whatever their names.
    """
    configure(spark)
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens.

    A null or empty text is its end id alone; repeated rows and null ids are documents of their
    own; an empty table gives no pieces. Columns but the id and the text are not read.
    """
    configure(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rule),
    ("near-duplicates", deduplicate),
    ("packing", pack),
]

# Compression, token ids and XXH64 can't be stated in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result stored in the shared folder and read again.

    A stored stage is removed as soon as the next one is stored; the last is the result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    stored = Folder(spark, folder)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            stored.remove(str(k - 1))
    return docs
