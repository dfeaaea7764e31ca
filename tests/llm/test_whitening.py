import math

import numpy as np
import pytest

from feedloom.llm import spectrum, whitening
from feedloom.llm.common import table


def matrix(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = (q * np.array(values, float)) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "spread": np.linspace(1, 40, 40), "repeated": np.repeat([9.0, 5.0, 5.0, 2.0], 4), "equal": np.ones(12), "falling": 10.0 ** -np.arange(9),
    "pairs": np.sort(np.concatenate([np.arange(1, 9), np.arange(1, 9) + 1e-9])), "one": [3.0], "low rank": [4.0, 2.0, 0.0, 0.0, 0.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_counts_and_pairs_against_a_library(name):
    a = matrix(SPECTRA[name], 3)
    want = np.linalg.eigvalsh(a)[::-1]
    top = max(want)
    for shift in [*np.linspace(-0.1, 1.1, 23) * top, *want]:
        n = spectrum.count_above(a, shift)
        assert (want > shift + 1e-13 * top).sum() <= n <= (want > shift - 1e-13 * top).sum()
    values, axes = spectrum.leading(a, 32)
    m = len(values)
    assert m == min(32, (want > 1e-10 * top).sum())
    assert np.allclose(values, want[:m], rtol=0, atol=1e-13 * top) and (np.diff(values) <= 1e-13 * top).all()
    assert np.abs(axes.T @ axes - np.eye(m)).max() < 1e-12
    assert np.abs(a @ axes - axes * values).max() < 1e-11 * top


def test_counts_with_zero_pivots():
    a = np.array([[0.0, 1, 0], [1, 0, 0], [0, 0, 0]])
    assert [spectrum.count_above(a, s) for s in (-2, -0.5, 0.5, 2)] == [3, 2, 1, 0]
    assert spectrum.leading(np.zeros((3, 3)), 5)[1].shape == (3, 0)


def check(rows, got, most):
    """Against exact sums and a library's eigenvalues; ``rows`` are (id, vector)."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, total = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, total)] for v in x])
    cov = y.T @ y / n
    values = np.linalg.eigvalsh(cov)[::-1][:most]
    m = sum(values > 1e-10 * values[0])
    deviation = {}
    for (i, _), v in zip(rows, x):
        deviation.setdefault(i, set()).add(sum((n * c - s) ** 2 for c, s in zip(v, total)))
    assert len(got) == n * m and {r.component for r in got} == set(range(1, m + 1))
    assert all(r.n == n and r.deviation in deviation[r.vec_id] and r.identity_error <= 1e-8 for r in got)
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-8)
    by = sorted(got, key=lambda r: r.component)
    w = np.array([r.whitened for r in by]).reshape(m, n)
    assert np.abs(w @ w.T / n - np.eye(m)).max() < 1e-8 and np.abs(w.mean(axis=1)).max() < 1e-9


def test_table(spark, sf):
    df = table(spark, sf, "embeddings")
    got = whitening.whiten(df.repartition(5)).collect()
    check([(r.vec_id, r.embedding) for r in df.collect()], got, 32)
    # Rows are x - S/n projected on one axis for all: the same however the rows are dealt.
    again = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(df).collect()}
    for r in got:
        assert abs(again[r.vec_id, r.component]) == pytest.approx(abs(r.whitened), abs=1e-9)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 3).tolist()) for i in range(30)]
    rows += [(5, rows[5][1])] * 2 + [(None, [0.5, 0.5, 0.5])]
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0]), (93, [math.nan] * 3), (94, [math.inf, 0.0, 0.0]), (95, [1.0])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, component int")
    check(rows, whitening.whiten(df).collect(), 32)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 1")).count() == 0  # no variance
    flat = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_long_sums_stay_exact(spark):
    far = [(0, [2.0 ** 52, 0.25]), (1, [-(2.0 ** 52), 0.5]), (2, [2.0 ** 40, 0.75])]
    df = spark.createDataFrame(far, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert got and all(r.deviation is None for r in got)  # they pass 64 bits
    n, total = whitening.sums(df.selectExpr("array(bigint(embedding[0] * 64), 9223372036854775807) x"))
    assert n == 3 and total == [2 ** 46, 3 * (2 ** 63 - 1)]
