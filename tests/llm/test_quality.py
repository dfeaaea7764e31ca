"""Quality rules and the compression classifier."""
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.llm import compress_quality, quality_rules
from feedloom.llm.common import table


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, table(spark, sf, "documents")):
        judged = quality_rules.judge(docs, no_labels(spark)).collect()
        assert Counter(tuple(r[c] for c in COUNTS) for r in judged) == Counter(plain_counts(r.text) for r in docs.collect())
    assert quality_rules.judge(no_docs, no_labels(spark)).count() == 0
    assert quality_rules.accepted(odd_docs, no_labels(spark)).columns == odd_docs.columns


def test_score_is_the_mean_log_ratio(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    labels = labels.union(labels)  # repeated labels count once
    trusted = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()}
    hashed = docs.select("doc_id", "text", F.transform(quality_rules.words_of(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    pairs = hashed.select("*", F.transform(F.expr("sequence(0, size(h) - 2)"), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1))).alias("p")).filter("size(h) > 1")
    rows = {r.doc_id: [x % quality_rules.BUCKETS for x in r.h + r.p] for r in pairs.collect()}
    t, c = Counter(), Counter()
    for i, grams in rows.items():
        c.update(grams)
        if i in trusted:
            t.update(grams)
    judged = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert set(rows) == set(judged)  # no text of one word here
    b = quality_rules.BUCKETS
    ts, cs = sum(t.values()) + b, sum(c.values()) + b
    for i, grams in rows.items():
        score = sum(math.log((t[g] + 1) / ts) - math.log((c[g] + 1) / cs) for g in grams) / len(grams)
        assert judged[i].llr == pytest.approx(score, abs=1e-9)
        if abs(score - quality_rules.THRESHOLD) > 1e-6:
            assert judged[i].kept == (not judged[i].base_failed and score >= quality_rules.THRESHOLD)


def test_all_trusted_documents_count_either_way(spark, sf, odd_docs):
    """The counts are the same whether ids are few enough to be broadcast or not."""
    docs, trusted = table(spark, sf, "documents"), quality_rules.trusted_ids(table(spark, sf, "labels"))
    assert trusted.count() == table(spark, sf, "labels").filter("quality = 1 and toxic = 0").select("doc_id").distinct().count()
    rows = docs.withColumn("_v", F.lit("clash"))
    one, other = (rows.select("doc_id", quality_rules.verdict(F.col("text"), quality_rules.weights(docs, trusted, most=n))["llr"].alias("x")).collect()
                  for n in (quality_rules.BROADCAST, 3))
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))
    judged = quality_rules.judge(rows, table(spark, sf, "labels"))
    assert {r["_v"] for r in judged.select("_v").collect()} == {"clash"}


def test_native_and_without_text_shuffle(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    plan = quality_rules.judge(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_compression_score_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = compress_quality.score(docs, compress_quality.fit(docs, labels))
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_no_text_is_too_long_to_teach(spark):
    """Only long texts: their blocks come from the whole length, in a bounded sample."""
    good, bad = "some quite ordinary words about gardens and rivers ", "BUY n0w!!! cl1ck h3re $$$ "
    rows = [(i, "".join(f"{x}{(j * 7 + i) % 97} " for j in range(1500)), y) for i in range(40) for y, x in ((i % 2, (bad, good)[i % 2]),)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    assert min(len(r[1]) for r in rows) > 2 * 16_384
    got = compress_quality.score(docs, compress_quality.fit(docs, labels)).collect()
    assert min(r.score for r in got if r.doc_id % 2) > max(r.score for r in got if r.doc_id % 2 == 0)
    one = docs.limit(1).select(compress_quality._sampled(F.col("text").cast("binary"), F.col("doc_id"), 16_384).alias("b"), "text").first()
    blocks = [one.text.encode()[k:k + 8192] for k in range(0, len(one.text), 8192)]
    places = [blocks.index(bytes(b)) for b in one.b]
    assert len(places) == 2 and places == sorted(places)


def test_scores_by_recomputation(spark, sf):
    """Every score anew from the model's dictionaries, with the library alone."""
    import zstandard

    docs = table(spark, sf, "documents")
    model = compress_quality.fit(docs, table(spark, sf, "labels"))
    coders = []
    for raw in (model.good, model.bad):
        held = zstandard.ZstdCompressionDict(raw)
        coders.append(zstandard.ZstdCompressor(level=compress_quality.LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in compress_quality.score(docs, model).collect():
        t = texts[r.doc_id]
        a, b = (sum(len(c.compress(t[k:k + 8192])) for k in range(0, len(t), 8192)) for c in coders)
        x = (b - a) / (len(t) + 16) * model.weights[0] + math.log((a + 16) / (len(t) + 16)) * model.weights[1] + model.weights[2]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, x)))), abs=1e-9)


def test_compression_of_odd_rows(spark, odd_docs, no_docs):
    ids = [(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, None, None), (3, 1, 1), (9999, 0, 0)]
    labels = spark.createDataFrame(ids, "doc_id long, quality int, toxic int")
    model = compress_quality.fit(odd_docs, labels)
    rows = compress_quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (100, 101)}) == 1
    kept = compress_quality.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert compress_quality.score(no_docs, model).count() == 0
    blank = compress_quality.fit(no_docs, no_labels(spark))
    assert {r.score for r in compress_quality.score(odd_docs, blank).collect()} == {0.5}
