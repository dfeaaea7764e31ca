"""Quality rules in native expressions: base counts, and a log-likelihood ratio of hashed n-grams.

Words and pairs of words are hashed into buckets. Two multinomials over the buckets are
counted: of trusted documents, and of the whole corpus. A document's score is the mean, over
its n-grams, of log(p_trusted / p_corpus); it is kept if the score reaches a fixed threshold.

Everything about a document is computed in its row, so texts are never shuffled: the corpus
counts are pre-aggregated to one row a bucket in every task, and the weights come back as one
array of ``BUCKETS`` doubles. All trusted documents count. Their ids are broadcast where they are
counted to be at most ``BROADCAST``, else the texts meet them in an ordinary join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import WORD_BREAK

BUCKETS = 1 << 14
BROADCAST = 500_000  # ids
THRESHOLD = -0.06
WINDOW = 5


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, wherever the optimizer moves the expression.

    A column that a lambda refers to may be replaced by its definition, which would then run
    for every element; a lambda's own argument may not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_BREAK), lambda x: x != "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _windows(h: Column, n: int) -> Column:
    """Hashes of all runs of n elements, in order; ``h`` is a lambda's argument."""
    return F.when(F.size(h) >= n, F.transform(
        F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
    )).otherwise(F.array().cast("array<bigint>"))


def _grams(h: Column) -> Column:
    return F.transform(F.concat(h, _windows(h, 2)), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def grams_of(text: Column) -> Column:
    """Buckets of all words and pairs of words of the text."""
    return let(_hashes(words_of(text)), _grams)


def _repeated(pairs: Column) -> Column:
    """Positions of the hashes found twice or more in sorted (hash, position) pairs, in order."""
    before = F.concat(F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i"))),
                      F.slice(pairs, 1, F.size(pairs) - 1))
    found = F.zip_with(pairs, before, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(found, lambda x: x.isNotNull()))))


def _covered(spots: Column) -> Column:
    """Words in the windows at these positions: each covers the words up to the next, ``WINDOW`` at most."""
    following = F.concat(F.slice(spots, 2, F.size(spots)), F.array(F.lit(2_000_000_000)))
    return F.aggregate(
        F.zip_with(spots, following, lambda a, b: F.least(b - a, F.lit(WINDOW))),
        F.lit(0).cast("bigint"), lambda s, x: s + x)


def _repeat_words(windows: Column) -> Column:
    """Words in windows found twice or more. Equal windows stand side by side once sorted."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, let(let(pairs, _repeated), _covered)).otherwise(F.lit(0)).cast("long")


def _mean_weight(grams: Column, weight: Column) -> Column:
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(weight, g))
    return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))


def verdict(text: Column, weight: Column, threshold: float = THRESHOLD) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept.

    A null text has no words. A text without n-grams has the score 0 and fails the base rules.
    Windows are told apart by a 64-bit hash of their words' 64-bit hashes.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measures(w: Column) -> Column:
        return let(_hashes(w), lambda h: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(_windows(h, WINDOW), _repeat_words).alias("n_repeat_words"),
            let(_grams(h), lambda g: _mean_weight(g, weight)).alias("llr")))

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(*[m[x].alias(x) for x in names], failed.alias("base_failed"), (~failed & (m["llr"] >= threshold)).alias("kept"))

    return let(let(words_of(whole), measures), judged)


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST) -> Column:
    """The constant array of log(p_trusted / p_corpus) by bucket, with one added to each count.

    A document counts as trusted whatever the number of rows with its id in ``trusted``; without
    trusted documents all ratios are those of the added ones.
    """
    trusted = trusted.select(F.col(id_col).alias("_trusted")).filter(F.col("_trusted").isNotNull()).distinct()
    few = trusted.limit(most + 1).count() <= most
    counts = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(trusted) if few else trusted, F.col("_id") == F.col("_trusted"), "left")
        # The outer form: the plain one would add a filter that makes the n-grams once more.
        .select(F.explode_outer(grams_of(F.col("_text"))).alias("_bucket"), F.col("_trusted").isNotNull().cast("long").alias("_t"))
        .groupBy("_bucket").agg(F.sum("_t").alias("t"), F.count("*").alias("c"))
        .filter(F.col("_bucket").isNotNull()).collect()  # one row a bucket
    )
    ones = {r["_bucket"]: (r["t"] + 1, r["c"] + 1) for r in counts}
    both = [ones.get(k, (1, 1)) for k in range(BUCKETS)]
    t, c = (sum(x) for x in zip(*both))
    found = [math.log(a / t) - math.log(b / c) for a, b in both]
    return F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All ids labelled good and not toxic."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull())
    return good.select(id_col).distinct()


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with those of ``verdict``; columns of these names are replaced.

    Repeated rows and rows with a null id are judged like others.
    """
    weight = weights(docs, trusted_ids(labels, id_col=id_col), id_col, text_col)
    own = "_v"
    while own in docs.columns:
        own += "_"
    rows = docs.withColumn(own, verdict(F.col(text_col), weight, threshold))
    added = rows.schema[own].dataType.names
    return rows.select(*[c for c in docs.columns if c not in added], *[F.col(own)[c].alias(c) for c in added])


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns alone."""
    weight = weights(docs, trusted_ids(labels, id_col=id_col), id_col, text_col)
    return docs.filter(verdict(F.col(text_col), weight, threshold)["kept"])
