import math
import random

import numpy as np
import pytest

from feedloom.llm import threshold_search as ts
from feedloom.llm.common import table


def brute(rows, every, k):
    """(query id, rank, id, score) from whole scores; ``rows`` are (id, vector)."""
    whole = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows]
    out = []
    for q, x in whole:
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in whole if j != q)[:k]
            out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def found(df, **kw):
    return sorted(tuple(r) for r in ts.search(df, **kw).select("query_id", "rank", "vec_id", "score").collect())


def test_equals_brute_force_on_the_table(spark, sf):
    df = table(spark, sf, "embeddings")
    assert found(df) == brute([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)


@pytest.mark.parametrize("slices", [1, 2, 5, 64])
def test_any_number_of_lists_and_tiles(spark, slices):
    """Copies, ties, vectors far from zero, and one query that is zero: all candidates tie."""
    rng = random.Random(slices)
    rows = [(i, [5.0 + rng.gauss(0, 1) * (j + 1) for j in range(5)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(60)] + [(1000, [0.0] * 5), (1001, [0.001] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert found(df, every=10, k=4, slices=slices, block=16, chunk=8) == brute(rows, 10, 4)


def test_few_and_unusable_rows_and_clashing_names(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [-3.0, 0.5]), (3, [0.2, 0.1])]
    bad = [(40, None), (60, []), (80, [1.0, None]), (100, [math.nan, 1.0]), (120, [math.inf, 1.0]), (140, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows + bad + rows[:2] * 2], "vec_id long, embedding array<float>, q string, score string")
    assert found(df) == brute(rows, 20, 20)  # fewer than k; repeated rows count once
    again = df.select("vec_id", "embedding").union(spark.createDataFrame([(3, [9.0, 9.0])], "vec_id long, embedding array<float>"))
    assert found(again) == brute(rows, 20, 20)  # the least vector of an id counts
    assert found(df.limit(0)) == [] and found(df.filter("vec_id = 0")) == [] and found(df.filter("vec_id = 3")) == []
    assert ts.search(df.limit(0)).dtypes == ts.search(df).dtypes


def test_huge_components_use_whole_numbers(spark):
    rows = [(i, [float((i * 7919) % 1000 - 500) * 2.0 ** 14, float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, every=10, k=3) == brute(rows, 10, 3)  # beyond what doubles hold exactly
    far = spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert len(found(far)) == 2


def test_thresholds_leave_most_pairs_out(spark):
    """What the second phase gathers is a small part of all pairs, and the third part smaller."""
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.normal(0, 0.125, (2000, 64)))
    q, least = x[:50], []
    whole = q @ x.T
    cut = np.partition(whole, 2000 - 21, axis=1)[:, 2000 - 21]
    parts = [q[:, s::2] @ x[:, s::2].T for s in range(2)]
    least = [(p >= np.ceil(cut / 2)[:, None]) for p in parts]
    assert ((whole >= cut[:, None]) <= (least[0] | least[1])).all()
    assert (least[0] | least[1]).mean() < 0.1
