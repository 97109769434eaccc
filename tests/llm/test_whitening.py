"""Jacobi-Davidson and whitening against a dense eigensolver and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from helixframe.llm import whitening


def test_pairs_are_those_of_a_dense_solver():
    rng = np.random.default_rng(1)
    for width, k in ((64, 8), (200, 5), (7, 8), (1, 3)):
        a = rng.standard_normal((3 * width, width)) * np.linspace(1, 3, width)
        v = a.T @ a / len(a)
        values, vectors, residuals = whitening.leading(lambda q: v @ q, width, k)  # noqa: B023
        want, dense = np.linalg.eigh(v)
        k = min(k, width)
        assert values == pytest.approx(want[::-1][:k], rel=1e-13) and residuals.max() < 1e-13 * values[0]
        assert np.abs((vectors * dense[:, ::-1][:, :k]).sum(axis=0)) == pytest.approx(1, abs=1e-11)


def test_equal_and_missing_eigenvalues():
    v = np.diag([5.0, 5.0, 5.0, 2.0, 2.0, 1.0, *[0.0] * 14])
    values, vectors, residuals = whitening.leading(lambda q: v @ q, 20, 8)
    assert values == pytest.approx([5, 5, 5, 2, 2, 1, 0, 0], abs=1e-13) and residuals.max() < 1e-13
    assert vectors.T @ vectors == pytest.approx(np.eye(8), abs=1e-13)


def test_minres_solves():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 3))
    shift = np.array([0.0, 0.5, 3.0])
    x = whitening.minres(lambda z: a @ z - z * shift, b, 200, 1e-12)
    assert a @ x - x * shift == pytest.approx(b, abs=1e-7)


def brute(rows, k=8):
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n = len(kept)
    x = np.array([v for _, v in kept], object)
    s = x.sum(axis=0)
    exact = [[Fraction(int(a)) - Fraction(int(b), n) for a, b in zip(r, s)] for r in x]
    c = np.array([[float(v) for v in r] for r in exact])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    z = c @ u / np.sqrt(e)
    return {(i, j + 1): (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r], s)), abs(z[r, j]), e[j] / np.trace(c.T @ c / n)) for r, (i, _) in enumerate(kept) for j in range(len(e))}


def test_whitening_is_the_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(12) * np.linspace(1, 2, 12)).astype(np.float32).tolist()) for i in range(500)]
    rows += [(500, None), (501, []), (502, [None] * 12), (503, [float("nan")] * 12), (504, [float("inf")] * 12), (505, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, i int").repartition(4)
    out, model = whitening.whiten(df)
    got = {(r.vec_id, r.component): (r.n, r.deviation, abs(r.whitened), r.explained, r.identity_error) for r in out.collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and model["residuals"].max() < 1e-13
    for key, w in want.items():
        g = got[key]
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-9) and g[3] == pytest.approx(w[3], rel=1e-12) and g[4] < 1e-12


def test_whitened_test_table_has_unit_covariance(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    p = whitening.whiten(df)[0].toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.cov(p.T, bias=True) == pytest.approx(np.eye(8), abs=1e-12) and p.mean(axis=0) == pytest.approx(0, abs=1e-12)


def test_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([]))[0].count() == 0
    assert whitening.whiten(make([(1, None), (2, [])]))[0].count() == 0
    assert whitening.whiten(make([(1, [0.5, 0.5])]))[0].count() == 0
    assert whitening.whiten(make([(1, [0.5, 0.5]), (2, [0.5, 0.5])]))[0].count() == 0
    flat = whitening.whiten(make([(None, [0.5, 1.0]), (None, [0.5, 2.0]), (3, [9.0]), (3, [0.5, 2.0])]))[0].collect()
    assert len(flat) == 3 and {r.component for r in flat} == {1} and {r.vec_id for r in flat} == {None, 3} and {r.n for r in flat} == {3}
    huge = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]))[0].collect()
    assert len(huge) > 0 and {r.deviation for r in huge} >= {None}
