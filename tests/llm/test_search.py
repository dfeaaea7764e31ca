import math
import random

import numpy as np
import pytest

from feedloom.llm import ann
from feedloom.llm.common import table


def brute(rows, every, k):
    """(query id, [(score, id)]) over all rows with another id."""
    x = np.array([v for _, v in rows], float)
    units = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for i, (q, _) in enumerate(rows):
        if q % every == 0:
            near = sorted((-round(float(s), 12), j) for s, (j, _) in zip(units @ units[i], rows) if j != q)
            out[q] = [(-s, j) for s, j in near[:k]]
    return out


def test_recall_and_exact_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want, got = brute(rows, 50, 5), {}
    at = dict(rows)
    for r in ann.search(table(spark, sf, "embeddings")).orderBy("query_id", "rank").collect():
        a, b = np.array(at[r.query_id], float), np.array(at[r.vec_id], float)
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & {j for _, j in want[q]}) for q in want) / (5 * len(want)) >= 0.9


def test_equal_vectors_ties_and_unusable_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(50, rows[3][1]), (7, rows[9][1])]
    bad = [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0, 0, 0, 0]), (203, [math.nan] * 6), (204, [math.inf] + [0.0] * 5), (205, [1.0]),
           (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], "clash") for i, v in rows + bad],
                               "vec_id long, embedding array<float>, score string").select("vec_id", "embedding", "score")
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    got = {}
    for r in ann.search(df, every=10, share=1.0, block=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.score, 12), r.vec_id))
    want = brute(kept, 10, 5)
    assert set(got) == set(want)
    for q in want:
        assert [j for _, j in got[q]] == [j for _, j in want[q]], q
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id = 0")).count() == 0  # no candidate
    assert len(ann.search(df.filter("vec_id in (0, 1, 2)")).collect()) == 2
