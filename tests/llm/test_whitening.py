"""Operator 12 against a dense eigensolver, and its defined cases."""

import math

import numpy as np
import pytest

from skyledger.llm import whitening as w


def dense(vectors, k=16):
    """By brute force: rows of levels, n, sums, eigenvalues, eigenvectors, trace."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    return x, n, s, e[::-1][:k], v[:, ::-1][:, :k], np.trace(cov)


def compare(rows, vectors, ids, k=16):
    x, n, s, e, v, trace = dense(vectors, k)
    want = (x - s / n) @ v / np.sqrt(e)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(by) == len(ids) * len(e)
    got = np.array([[by[i, c + 1]["whitened"] for c in range(len(e))] for i in ids])
    sign = np.sign((want * got).sum(axis=0))
    assert np.abs(want * sign - got).max() < 1e-8
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1)
    for i, d in zip(ids, deviation, strict=True):
        r = by[i, 1]
        assert r["n"] == n and r["deviation"] == d and r["identity_error"] < 1e-10
    for c in range(len(e)):
        assert by[ids[0], c + 1]["explained"] == pytest.approx(e[c] / trace, rel=1e-10)


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    compare(w.op12(spark, sf).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_many_passes_and_restarts():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((900, 300)) * np.linspace(1, 1.2, 300)
    cov = a.T @ a / 900
    e, v = np.linalg.eigh(cov)
    for most in (2048, 96):
        values, vectors, passes = w.subspace(lambda q: cov @ q, 300, 16, 32, basis_most=most)
        assert passes > 2
        assert values == pytest.approx(e[::-1][:16], rel=1e-12)
        assert np.abs(np.abs((vectors * v[:, ::-1][:, :16]).sum(axis=0)) - 1).max() < 1e-10
        assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12


def test_passes_over_rows_of_many_dimensions(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((700, 90)) * np.linspace(0.3, 3, 90)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    compare(w.whiten(df, block=20).collect(), vectors, list(range(700)))


def test_equal_eigenvalues_and_rank(spark):
    # The corners of a square: two equal eigenvalues, and a dimension without variance.
    df = spark.createDataFrame([(1, [1.0, 1.0, 5.0]), (2, [1.0, -1.0, 5.0]), (3, [-1.0, 1.0, 5.0]), (4, [-1.0, -1.0, 5.0]), (4, [-1.0, -1.0, 5.0])], "vec_id long, embedding array<double>")
    got = w.whiten(df).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 10
    for i in (1, 2, 3):
        assert sum(r["whitened"] ** 2 for r in got if r["vec_id"] == i) == pytest.approx(2)
    assert {r["deviation"] for r in got} == {2 * (4 * 64) ** 2} and {r["n"] for r in got} == {4}
    assert all(r["explained"] == pytest.approx(0.5) for r in got)


def test_defined_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [0.0, 1.0], "a"), (2, [1.0, 0.25], "b"), (None, [0.5, 0.5], "c"), (2, [1.0, 0.25], "b"), (3, None, "d"), (4, [nan, 0.0], "e"), (5, [inf, 0.0], "f"), (6, [None, 0.0], "g"), (7, [], "h"), (8, [1.0], "i"), (9, [1.005, 0.25], "same level as 2")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")
    got = w.whiten(df).collect()
    assert sorted((r["vec_id"] or 0) for r in got if r["component"] == 1) == [0, 1, 2, 2, 9]
    assert {r["n"] for r in got} == {3}
    same = {r["whitened"] for r in got if r["vec_id"] in (2, 9) and r["component"] == 1}
    assert len(same) == 1
    for few in (df.limit(0), df.where("vec_id = 2"), df.where("vec_id = 3"), df.where("vec_id = 7")):
        assert w.whiten(few).collect() == []
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1e9])], "vec_id long, embedding array<double>")
    assert {r["vec_id"] for r in w.whiten(huge).collect()} == {1, 2, 3}


def test_equal_rows_give_equal_values_wherever_they_stand():
    rng = np.random.default_rng(1)
    row, on = rng.normal(0, 1e5, 64), rng.normal(0, 1, (64, 16))
    want = w.projected(row[None], on).tobytes()
    for n in (1, 2, 3, 5, 17, 100):
        x = rng.normal(0, 1e5, (n + 1, 64))
        x[n] = x[0] = row
        got = w.projected(x, on)
        assert got[0].tobytes() == got[n].tobytes() == want and np.allclose(got, x @ on)
