"""Quantiles of columns by their bits against a sort, on values that lie closely together."""

import math

import numpy as np
import pytest

from skyledger.operators import ranks


@pytest.mark.parametrize("listed,sorted_at,buckets", [(1 << 20, 1 << 17, 1 << 18), (0, 50, 8), (300, 400, 100)])
def test_quantiles_of_columns_are_those_of_a_sort(spark, monkeypatch, listed, sorted_at, buckets):
    for k, v in (("LISTED", listed), ("SORTED", sorted_at), ("BUCKETS", buckets)):
        monkeypatch.setattr(ranks, k, v)
    rng = np.random.default_rng(8)
    n = 900
    close = 0.5 + rng.random(n) * 1e-9  # within one bucket of a thousandth, and of 24 bits
    columns = [rng.normal(0, 1e6, n), close, rng.integers(-3, 3, n) * 0.5, np.full(n, 7.25), np.full(n, math.nan), np.where(rng.random(n) < 0.5, math.nan, -close), np.array([1e300, -1e300, 0.0, -0.0, math.inf] * (n // 5))]
    rows = [tuple(None if j == 0 and i % 50 == 0 else float(c[i]) for j, c in enumerate(columns)) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(len(columns)))).repartition(3)
    at = [0.0, 0.013, 0.25, 1 / 3, 0.5, 0.77, 1.0]
    got = ranks.quantiles_of_columns(df, at)
    columns[0] = columns[0][np.arange(n) % 50 != 0]
    for own, c in zip(got, columns, strict=True):
        u = np.sort(c[~np.isnan(c)])
        if not len(u):
            assert len(own) == 0
            continue
        p = [q * (len(u) - 1) for q in at]
        with np.errstate(invalid="ignore"):
            want = [u[math.floor(x)] + (u[math.ceil(x)] - u[math.floor(x)]) * (x - math.floor(x)) for x in p]
        assert np.array_equal(own, want, equal_nan=True)
    assert [len(x) for x in ranks.quantiles_of_columns(df.limit(0), at)] == [0] * len(columns)
