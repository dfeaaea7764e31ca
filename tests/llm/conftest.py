import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose
    names clash with what the operators add."""
    rng = random.Random(7)
    words = ["ab", "The", "née", "x1", "don't", "###", "日本", "\t\n", "zebra", "q" * 700]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "de", "s1", 0), (None, "ab The née", "en", "s1", 9), (None, None, None, None, None),
             (102, "word " * 30_000, "en", "s0", 150_000), (103, " \n\t ", "fr", "s2", 4), (104, "y" * 5000, "en", None, 5000)]
    rows += [rows[3]] * 3 + [(200 + k, texts[5], "en", "s0", 1) for k in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("length", "shard", "slot", "curve", "kept", "n_words", "sequence_id", "score", "ids", "_fp", "_rank"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
