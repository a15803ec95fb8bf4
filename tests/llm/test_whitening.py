"""Whitening against numpy on the whole matrix, and the cases that the operator defines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component int, sums string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", "n", 2, "s") for i, v in vectors], SCHEMA)


def plain(vectors, k=4):
    own = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in vectors]
    x = np.array([v for _, v in own])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    z = fit - sums / n
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    w = (x - sums / n) @ q / np.sqrt(e)
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return n, w, deviation, e / np.trace(v)


def compare(rows, vectors, k=4):
    n, w, deviation, share = plain(vectors, k)
    assert len(rows) == k * len(vectors)
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(1, k + 1):
        own = np.array([got[(i, c)][0].whitened for i, _ in vectors])
        sign = np.sign(own @ w[:, c - 1])
        assert np.abs(own * sign - w[:, c - 1]).max() < 1e-6
        assert all(r.n == n and r.deviation == d and abs(r.explained / share[c - 1] - 1) < 1e-9 for (i, _), d in zip(vectors, deviation, strict=True) for r in got[(i, c)])
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


@pytest.mark.parametrize(("d", "n"), [(3, 40), (16, 300), (60, 500)])
def test_random_vectors(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = [(i, (rng.normal(size=d) * np.linspace(1, 0.1, d)).tolist()) for i in range(n)]
    vectors += [(n + i, vectors[7][1]) for i in range(n // 2)]  # one vector makes up a third of all rows
    compare(whitening.whitened(frame(spark, vectors).repartition(5)).collect(), vectors, min(d, 4))


def test_steps_of_a_wide_space():
    """Far more dimensions than the block searches at once, and close eigenvalues: components are those of numpy."""
    rng = np.random.default_rng(3)
    d = 300
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = np.concatenate([[5, 4.99, 4.98, 4.97], np.linspace(4.8, 0.01, d - 4)])
    v = (q * e) @ q.T
    values, basis, residuals, steps = whitening.lobpcg(lambda block: v @ block, d, 4)
    assert steps > 3 and np.abs(values - e[:4]).max() < 1e-9 and residuals.max() < 1e-10
    assert np.abs(np.abs((basis * q[:, :4]).sum(axis=0)) - 1).max() < 1e-12


def test_equal_eigenvalues():
    for e in (np.ones(100), np.concatenate([[2, 2, 2, 2, 2], np.linspace(1, 0.1, 95)]), np.concatenate([[3.0], np.zeros(99)])):
        values, basis, residuals, _ = whitening.lobpcg(lambda block, e=e: e[:, None] * block, 100, 4)
        assert np.abs(values - np.sort(e)[::-1][:4]).max() < 1e-9 and residuals.max() < 1e-9
        assert np.abs(basis.T @ basis - np.eye(4)).max() < 1e-9


def test_what_is_dropped(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=5).tolist()) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, []), (105, [1.0, 2.0])]
    compare(whitening.whitened(frame(spark, vectors + odd)).collect(), vectors)
    rows = whitening.whitened(frame(spark, [*vectors, (None, vectors[3][1]), vectors[4]])).collect()
    assert sum(r.vec_id is None for r in rows) == 4 and sum(r.vec_id == 4 for r in rows) == 8


def test_no_variance_and_empty(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, None)])).collect() == []
    rows = whitening.whitened(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)}
    flat = [(i, [i / 8, 0.0, 0.0]) for i in range(9)]
    rows = whitening.whitened(frame(spark, flat)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in rows) and rows[0].identity_error < 1e-9


def test_deviation_beyond_a_long():
    m = np.array([[1 << 40, 0], [3, 1]], np.int64)
    got = whitening.deviations(m, [5, 7], 1 << 29)
    assert got == [None, (3 * (1 << 29) - 5) ** 2 + ((1 << 29) - 7) ** 2]


def test_partial_sums_are_whole(spark):
    x = spark.range(1000).select(F.array("id", F.col("id") * 2).alias("x")).repartition(7)
    assert whitening.added(x, 2, lambda m: m.sum(axis=0).astype(float)).tolist() == [499500.0, 999000.0]
