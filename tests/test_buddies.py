"""The buddy test by tiles of places: the same rows as with a row a pair and date."""

import datetime as dt
import math

import numpy as np
import pytest

from skyledger.functions import numeric
from skyledger.functions.numeric import beyond_one, beyond_qn, without
from skyledger.operators import chain


@pytest.mark.parametrize("n", [1, 2, 3, 6, 40, 401])
def test_bound_by_counts_is_the_bound_by_qn(n):
    rng = np.random.default_rng(n)
    for values in (rng.normal(10, 3, n), rng.integers(0, 9, n) / 4, np.round(rng.normal(0, 1, n), 2), np.where(rng.random(n) < 0.8, 1.0, rng.random(n)), np.append(rng.normal(0, 1, n), [np.nan, np.inf])):
        u = np.sort(values)
        for low, high in ((-1.4, 1.4), (-0.2, 2.0)):
            assert beyond_qn(u, values, low, high).tolist() == [beyond_one(without(u, v), v, low, high) for v in values]
            far = rng.normal(10, 9, 7)
            assert beyond_qn(u, far, low, high, False).tolist() == [beyond_one(u, v, low, high) for v in far]


@pytest.mark.parametrize("seed", range(6))
def test_most_bounds_need_no_count_of_pairs(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    n = 1200
    monkeypatch.setattr(numeric, "ROUGH_FROM", 200)
    monkeypatch.setattr(numeric, "MANY", 1000 if seed % 2 else 1 << 30)
    u = np.sort([rng.normal(10, 3, n), np.round(rng.normal(0, 1, n), 2), rng.random(n) ** 4, np.append(rng.normal(0, 1, n - 1), 1e7), rng.integers(0, 60, n) / 4, np.concatenate([rng.normal(0, 1, n // 2), rng.normal(50, 1, n // 2)])][seed])
    values, made = rng.choice(u, 60, replace=False), []
    for held, v in ((True, values), (False, np.concatenate([values + 0.37, rng.normal(0, 40, 20)]))):
        got = numeric.beyond_qn(u, v, -1.4, 1.1, held)
        assert got.tolist() == [beyond_one(without(u, x) if held else u, x, -1.4, 1.1) for x in v]
    pairs = numeric._pairs_within
    monkeypatch.setattr(numeric, "_pairs_within", lambda *a: made.append(1) or pairs(*a))
    for x in values.reshape(12, 5):
        numeric.beyond_qn(u, x, -1.4, 1.1)
    assert seed == 3 or len(made) < 2 * 12  # seed 3: one value far out makes wide bins


def panel(spark, stations, odd=()):
    """Several places in several tiles, values of few levels, gaps, repeated rows, and stations without a place."""
    rng = np.random.default_rng(5)
    meta = [(s, 47 + s % 7 * 0.011 + s % 3 * 0.2, 8 + s % 5 * 0.013, 400.0 + 90 * (s % 4)) for s in range(stations)] + [(9000, None, 8.0, 400.0), (9001, 47.0, 8.0, None), *odd]
    rows = []
    for s in [*range(stations), 9000, 9001, 9002, None]:
        for h in range(6):
            temp = None if rng.random() < 0.1 else math.nan if rng.random() < 0.004 else float(np.round(rng.normal(10, 4), 1))
            for again in range(1 + (rng.random() < 0.05)):
                rows.append((None if rng.random() < 0.02 else dt.datetime(2024, 1, 1, h), s, f"n{again}", temp if not again else 30.0))
    return spark.createDataFrame(rows, "date timestamp, station_id long, network string, temp double"), spark.createDataFrame(meta, "station_id long, lat double, long double, elev double")


@pytest.mark.parametrize("odd", [(), [(3, 47.0, 8.0, 400.0), (4, 47.2, 8.0, 400.0), (4, 47.2, 8.0, 400.0)]])
def test_tiles_give_what_pairs_give(spark, odd):
    obs, meta = panel(spark, 300, odd)
    listed = lambda df: sorted(map(str, df.select("date", "station_id", "network", "temp").collect()))
    want = chain.buddy_test(obs, chain.buddy_pairs(meta, 3000.0))
    got = chain.buddy_test_near(obs, meta, 3000.0)
    assert listed(got) == listed(want) and got.columns == obs.columns
    assert want.where("temp IS NULL").count() > obs.where("temp IS NULL").count() + 20


def test_no_exchange_grows_with_the_pairs(spark):
    # All stations at one place: the pairs of a date are 400 times its rows.
    obs, meta = panel(spark, 1)
    meta = spark.range(400).selectExpr("id AS station_id", "47.0D AS lat", "8.0D AS long", "400.0D AS elev")
    obs = spark.range(400 * 24).selectExpr("timestamp_seconds(id DIV 400 * 3600) AS date", "id % 400 AS station_id", "CAST(hash(id) % 1000 AS DOUBLE) AS temp")
    got = chain.buddy_test_near(obs, meta)
    got.collect()

    def rows(plan):
        out = [plan.metrics().apply("numOutputRows").value()] if plan.metrics().contains("numOutputRows") else []
        for i in range(plan.children().size()):
            out += rows(plan.children().apply(i))
        for inner in ("executedPlan", "plan"):
            if plan.nodeName() == "AdaptiveSparkPlan" and inner == "executedPlan" or plan.nodeName().endswith("QueryStage") and inner == "plan":
                out += rows(getattr(plan, inner)())
        return out

    assert 400 * 24 <= max(rows(got._jdf.queryExecution().executedPlan())) <= 400 * 24 + 16
