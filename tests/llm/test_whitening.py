"""Whitening against numpy: exact deviations, components up to their sign, and what can't be used."""

import numpy as np
import pytest
from pyspark.sql import Row

from tracewell.llm import whitening


def expected(vectors, k=8):
    x = np.floor(1024 * np.asarray(vectors, dtype=float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    exact = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    return exact, ((x - s / n) @ u) / np.sqrt(e), e / np.trace(v)


def check(rows, vectors, k=8):
    exact, white, explained = expected(vectors, k)
    rows = sorted(rows, key=lambda r: (r.vec_id, r.component))
    got = np.array([r.whitened for r in rows]).reshape(len(vectors), -1)
    assert got.shape == white.shape
    assert np.allclose(got * np.sign((got * white).sum(axis=0)), white, atol=1e-8)
    assert [r.deviation_exact for r in rows[:: white.shape[1]]] == list(map(str, exact))
    assert np.allclose([r.explained for r in rows[: white.shape[1]]], explained, rtol=1e-9)
    assert all(r.n == len(vectors) and r.identity_error < 1e-9 for r in rows)


def test_against_numpy(spark):
    made = np.random.default_rng(3).normal(size=(300, 24)) * np.linspace(1, 4, 24)
    df = spark.createDataFrame([(i, list(map(float, v)), "kept out") for i, v in enumerate(made)], "vec_id long, embedding array<double>, x string").repartition(7)
    rows = whitening.whiten(df).collect()
    check(rows, made)
    assert all(r.deviation == int(r.deviation_exact) for r in rows)


def test_deviation_beyond_a_long(spark):
    made = np.random.default_rng(4).normal(size=(40, 3)) * 1e9
    rows = whitening.whiten(spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(made)], "vec_id long, embedding array<double>")).collect()
    exact, _, _ = expected(made)
    assert {r.vec_id: (r.deviation_exact, r.deviation) for r in rows} == {i: (str(e), e if e < 2**63 else None) for i, e in enumerate(exact)}
    assert any(r.deviation is None for r in rows)


def test_what_cannot_be_used(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [0.5, 0.25]]
    bad = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1e300, 1.0], [], [1.0], [1.0, 2.0, 3.0]]
    rows = [Row(vec_id=i if i != 2 else None, embedding=v, label=1) for i, v in enumerate(good + bad)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted({(-1 if r.vec_id is None else r.vec_id) for r in got.collect()}) == [-1, 0, 1, 3]
    assert {r.component for r in got.collect()} == {1, 2} and {r.n for r in got.collect()} == {4}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]], [None]])
def test_without_variance(spark, vectors):
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"))
    assert got.count() == 0 and got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rank_below_k(spark):
    made = [[float(i), 2.0 * i, 0.0] for i in range(9)]
    rows = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(made)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-9
