"""FLT-13 and FLT-14 by an index: substring search that reads what can match.

Every text is stored with its id, and every run of three characters of its lower-case form as a
posting. A query of three characters or more reads the postings' buckets of its own runs, keeps
the ids that have all of them, and verifies these against the texts. A shorter query has no run
of its own: it scans the texts, which are far narrower than articles.

Texts and postings are tables of one store, so that a batch's changes to both appear together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.streaming.tables import BUCKETS, Store

GRAM = 3
FIELD_END = "\x00"  # between fields, so that no match spans two


def grams(text: Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a text, none where it is shorter.

    The text is taken apart once: cutting a run out by its place walks there from the start.
    """
    ends = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    runs = F.transform(F.array(F.split(text, "")), lambda c: F.transform(
        ends, lambda i: F.concat(*[F.get(c, i + (k - 1)) for k in range(GRAM)])))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.get(runs, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def searched(*fields: Column) -> Column:
    """What a row is found by: its fields in lower case, null ones empty."""
    return F.lower(F.concat_ws(FIELD_END, *[F.coalesce(f, F.lit("")) for f in fields]))


class SearchIndex:
    def __init__(self, root: str, buckets: int = BUCKETS) -> None:
        self.store = Store(root)
        self.texts = self.store.table("texts", "id STRING, text STRING", "id", buckets)
        self.postings = self.store.table("postings", "gram STRING, id STRING", "gram", buckets)

    def update(self, changes: DataFrame, batch_id: int) -> None:
        """``changes`` has id and text (``searched``), one row an id; a null text takes the id
        out. Only postings that a text lost or gained are touched."""
        with self.store.batch(changes.sparkSession, batch_id) as batch:
            if batch.done:
                return
            new = batch.stage(changes.select("id", "text"), "new")
            old = batch.read(self.texts, self.texts.touched(new)).withColumnRenamed("text", "old")
            both = new.join(old, "id", "left")
            none = F.array().cast("array<string>")
            had, has = F.coalesce(grams(F.col("old")), none), F.coalesce(grams(F.col("text")), none)
            edits = batch.stage(both.select("id", F.explode(F.concat(
                F.transform(F.array_except(has, had), lambda g: F.struct(g.alias("gram"), F.lit(False).alias("gone"))),
                F.transform(F.array_except(had, has), lambda g: F.struct(g.alias("gram"), F.lit(True).alias("gone"))))).alias("e")).select(
                "e.gram", "id", "e.gone"), "edits")
            batch.update(self.texts, new, lambda current, rows: current.join(rows.select("id"), "id", "left_anti").unionByName(
                rows.filter(F.col("text").isNotNull())))
            batch.update(self.postings, edits, lambda current, rows: current.join(
                rows.filter("gone").select("gram", "id"), ["gram", "id"], "left_anti").unionByName(rows.filter(~F.col("gone")).select("gram", "id")))

    def candidates(self, spark, query: str) -> DataFrame | None:
        """Ids that have all runs of the query; None where it has none."""
        q = query.lower()
        wanted = sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})
        if not wanted:
            return None
        keys = spark.createDataFrame([(g,) for g in wanted], "gram string")
        rows = self.postings.read(spark, None, self.postings.touched(keys)).filter(F.col("gram").isin(wanted))
        return rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id")

    def search(self, spark, query: str) -> DataFrame:
        """Ids whose text contains the query, in any case; an empty query finds all."""
        found = self.candidates(spark, query)
        if found is None:
            texts = self.texts.read(spark)
        else:
            texts = self.texts.read(spark, None, self.texts.touched(found)).join(found, "id", "left_semi")
        return texts.filter(F.col("text").contains(query.lower())).select("id")
