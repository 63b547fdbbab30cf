"""Whitening against dense linear algebra and exact integers."""
import math
from fractions import Fraction

import numpy as np
import pytest

from evlens.llm import whitening


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))
    a = (q * np.array(values, float)) @ q.T
    return (a + a.T) / 2


SPECTRA = [
    list(np.linspace(1, 50, 40)), [5.0] * 6 + [1.0] * 6, [1e6, 1e3, 1.0, 1e-3, 1e-6], [3.0], [2.0, 2.0 + 1e-9, 1.0], [0.0, 0.0, 4.0],
    list(np.exp(np.linspace(-8, 3, 64)))]


@pytest.mark.parametrize("values", SPECTRA)
def test_inertia_counts(values):
    a = symmetric(values)
    for shift in [-1.0, 0.5, 1.5, 2.5, 10.25, 49.5, 1e7]:
        assert whitening.above(a, shift) == sum(v > shift for v in values)


@pytest.mark.parametrize("values", SPECTRA)
@pytest.mark.parametrize("k", [1, 5, 32])
def test_components_of_known_spectra(spark, values, k):
    a = symmetric(values, 3)
    got, vector = whitening.components(spark, a, k)
    want = sorted(values, reverse=True)[:k]
    want = [v for v in want if v > 1e-12 * want[0]]
    assert len(got) == len(want)
    assert np.allclose(got, want, rtol=1e-10, atol=1e-13 * max(values))
    assert np.abs(vector.T @ vector - np.eye(len(got))).max() < 1e-13
    assert np.abs(a @ vector - vector * got).max() < 1e-12 * max(values)


def test_intervals_hold_what_they_say():
    values = list(np.random.default_rng(1).exponential(3, 64))
    a = symmetric(values)
    cuts = whitening.intervals(a, 32)
    assert sum(c for _, _, c in cuts) >= 32 and all(c <= whitening.PER_INTERVAL for _, _, c in cuts)
    for low, high, count in cuts:
        assert count == sum(low < v <= high for v in values)


def brute(vectors, k=32):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [[n * r[j] - s[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in dev), n ** 3)) for j in range(d)] for i in range(d)])
    value, vec = np.linalg.eigh(cov)
    value, vec = value[::-1][:k], vec[:, ::-1][:, :k]
    real = value > 1e-12 * value[0]
    w = (np.array(dev, float) / n) @ (vec[:, real] / np.sqrt(value[real]))
    return n, [sum(c * c for c in r) for r in dev], w, value[real] / np.trace(cov)


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("n,d", [(300, 12), (60, 40), (5, 8), (700, 3)])
def test_whole_table(spark, n, d):
    rng = np.random.default_rng(n)
    data = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d))).astype(np.float32)
    odd = [(-1, None), (-2, [1.0] * (d - 1) + [None]), (-3, [float("nan")] * d), (-4, [float("inf")] + [0.0] * (d - 1)), (-5, []),
           (-6, [1.0] * (d + 1))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + odd, SCHEMA).repartition(5)
    got = whitening.whiten(table).collect()
    count, deviation, w, explained = brute(data)
    assert len(got) == n * w.shape[1] and {r.vec_id for r in got} == set(range(n))
    found = np.zeros_like(w)
    for r in got:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.n == count and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-8
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-8
    sign = np.sign((found * w).sum(axis=0))
    assert np.abs(found - w * sign).max() < 1e-6


def test_order_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 6)).astype(np.float32))]
    one = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    two = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()}
    assert one.keys() == two.keys() and max(abs(one[x] - two[x]) for x in one) < 1e-12


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 5, SCHEMA)
    assert whitening.whiten(same).collect() == []
    clash = spark.createDataFrame([(1, [1.0, 2.0], 7, 8.0), (None, [2.0, 5.0], 7, 8.0), (1, [2.0, 1.0], 7, 8.0), (1, [2.0, 1.0], 7, 8.0)],
                                  "vec_id long, embedding array<float>, component int, v double")
    got = whitening.whiten(clash).collect()
    assert len(got) == 8 and {r.n for r in got} == {4} and sum(r.vec_id is None for r in got) == 2
    large = spark.createDataFrame([(i, [float(x), 1e30 if i == 9 else 0.0]) for i, x in enumerate([1, 2 ** 35, 7, -2 ** 35, 5, 1, 1, 1, 1, 1])], SCHEMA)
    got = whitening.whiten(large).collect()
    assert {r.n for r in got} == {9} and {r.component for r in got} == {1} and all(r.identity_error < 1e-4 for r in got)
    exact = brute([[x, 0.0] for x in [1, 2 ** 35, 7, -2 ** 35, 5, 1, 1, 1, 1]])[1]
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 2 ** 63 else None) for r in got)
