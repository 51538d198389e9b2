"""Numeric functions against direct forms, and edge cases of the time axis, gaps and models."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import numeric
from skyledger.operators import timeline as tl
from skyledger.plans import products

SF = "/root/testdata/sf0.001"


def test_qn_without_pairs_equals_all_pairs(monkeypatch):
    x = np.random.default_rng(1).normal(size=400).round(2)
    want = numeric.qn(x)
    monkeypatch.setattr(numeric, "QN_DIRECT", 10)
    assert abs(numeric.qn(x) - want) < 1e-9
    assert numeric.qn([1.0]) is None and numeric.qn([2.0] * 5) == 0


@pytest.mark.parametrize("n", [4, 5, 9])
def test_spline_returns_cubics(n):
    x = np.cumsum(np.random.default_rng(n).uniform(0.5, 2, n))
    at = np.linspace(x[0], x[-1], 17)
    cubic = lambda t: 2 - t + 0.5 * t**2 - 0.1 * t**3
    assert np.allclose(numeric.spline(x, cubic(x), at), cubic(at))
    assert np.allclose(numeric.spline(x[:3], x[:3] ** 2, at[:2]), at[:2] ** 2)
    assert np.allclose(numeric.spline(x[:2], x[:2], x[:1]), x[:1])


def test_spring_gap_and_autumn_overlap(spark):
    df = spark.createDataFrame([("2021-03-28 02:30:00",), ("2021-10-31 02:30:00",), ("2021-07-01 12:00:00",)], "t string")
    got = [r[0] for r in df.select(F.date_format(tl.to_utc(F.to_timestamp("t"), "Europe/Zurich"), "MM-dd HH:mm")).collect()]
    assert got == ["03-28 01:00", "10-31 00:30", "07-01 10:00"]


def rows(spark, values, minutes):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t + dt.timedelta(minutes=minutes * i), 1, "cws", v) for i, v in enumerate(values)], "date timestamp, station_id long, network string, temp double")


def temps(df):
    return [r["temp"] for r in df.orderBy("date").collect()]


def test_single_slots_are_filled(spark):
    assert temps(tl.half_hours(rows(spark, [None, 1.0, None, 3.0, None], 30))) == [None, 1, 2, 3, 3]
    assert temps(tl.half_hours(rows(spark, [1.0, None, None, 4.0], 30))) == [1, None, None, 4]
    assert tl.half_hours(rows(spark, [], 30)).count() == 0


def test_spline_fills_single_gaps_only(spark):
    got = temps(tl.spline_fill(rows(spark, [None, 1.0, None, 3.0, 4.0, None, None, 7.0, None], 60)))
    assert got[0] is None and abs(got[2] - 2) < 1e-9 and got[5] is None and got[6] is None and got[8] is None


@pytest.mark.parametrize("name", [n for n in products.QUERIES if n not in products.ORACLES])
def test_queries_without_sql(spark, name):
    df = products.QUERIES[name](spark, SF)
    assert df.count() > 0
    if name.startswith("risk"):
        assert df.where("risk < 0 OR risk > 1 OR risk IS NULL").count() == 0


def test_order_statistics_are_lazy_and_scan_once(spark, monkeypatch):
    from skyledger.operators import features, ranks

    df = spark.createDataFrame([(g, float(v), g) for g in ("a", None) for v in (-5, -1e-9, 0, 0, 0, 3, 7e9)] + [("b", None, "b")], "g string, v double, h string")

    def no_job(*_):
        raise AssertionError("a job ran while the plan was made")

    for name in ("collect", "count", "first", "take", "head"):
        monkeypatch.setattr(type(df), name, no_job)
    made = ranks.quantiles(df, ["g"], "v", {"low": 0.0, "q": 0.75, "high": 1.0}), features.robust_sigma(df, ["g"], "v"), ranks.running(ranks.counted(df, ["g"], "v"), ["g"], "_v", {"upto": "_n"}, descending=True)
    monkeypatch.undo()
    q, sigma, run = ([tuple(r) for r in m.collect()] for m in made)
    assert sorted(q, key=str) == sorted([("a", 7, -5.0, 1.5, 7e9), (None, 7, -5.0, 1.5, 7e9)], key=str)
    assert {r[0] for r in sigma} == {"a", None} and all(abs(s - 1.4826 * 1e-9) < 1 and s == 0.2 or s > 1 for _, _, s in sigma)
    assert sorted(r[-1] for r in run if r[0] == "a") == [1, 2, 5, 6, 7]
    plan = made[1]._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("Scan ExistingRDD") + final.count("LocalTableScan") <= 1


def test_blocks_are_numbered_without_a_gap_and_drawn_by_day(spark):
    from skyledger.operators import robust

    rows = [("cws", s, f"2024-01-0{d} 05:00:00") for s in range(40) for d in (1, 2)] + [("ows", None, None)]
    df = spark.createDataFrame(rows, "network string, station_id long, date string").withColumn("date", F.col("date").cast("timestamp"))
    assert robust.with_block(df).select("block").distinct().count() == 41
    blocks = robust.with_block(df, "station_day").select("block").distinct()
    got = robust.drawn(blocks, 20).groupBy("b").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    assert len(got) == 20 and {r["w"] for r in got} == {81} and all(30 < r["n"] < 81 for r in got)
    assert "ows::Missing::NaT" in {r[0] for r in blocks.collect()}
    with pytest.raises(ValueError, match="unit"):
        robust.with_block(df, "month")
