"""What sources see, on hand-made rows."""

import datetime as dt

import pytest

from skyledger.operators import environment as en
from skyledger.operators import features as ft

T = dt.datetime(2024, 5, 1, 12)


def at(h):
    return T + dt.timedelta(hours=h)


def frames(spark):
    keys = spark.createDataFrame([(at(0), 1), (at(0), 1), (at(0), 2), (at(9), 1)], "date timestamp, station_id long")
    pairs = spark.createDataFrame([(1, 10, 1, 1.0, 0.6), (1, 11, 2, 2.0, 0.3), (1, 12, 3, 4.0, 0.1)], "station_id long, source_id long, rank int, km double, weight double")
    env = spark.createDataFrame([(at(-2), 10, 20.0), (at(0), 11, 26.0), (at(1), 11, 99.0), (at(0), 12, None), (at(3), 12, 30.0), (at(4), 10, 50.0)], "date timestamp, station_id long, lst double")
    return keys, pairs, env


def test_values_as_of_the_hour_are_weighed(spark):
    got = {(r["date"], r["station_id"]): r for r in en.local_environment(*frames(spark), "lst", "x").collect()}
    assert len(got) == 3
    r = got[at(0), 1]
    assert (r["x_n"], r["x_mean"], r["x_median"], r["x_min"], r["x_max"], r["x_range"]) == (3, pytest.approx(76 / 3), 26.0, 20.0, 30.0, 10.0)
    assert r["x_idw"] == pytest.approx(0.6 * 20 + 0.3 * 26 + 0.1 * 30) and r["x_weight"] == pytest.approx(1)
    assert (r["x_nearest"], r["x_nearest_rank"], r["x_age_nearest"], r["x_age_median"], r["x_age_idw"]) == (20.0, 1, 2.0, 2.0, pytest.approx(0.6 * 2 + 0.1 * 3))
    # No sources, or sources without a value in time: the row stays.
    assert (got[at(0), 2]["x_n"], got[at(0), 2]["x_idw"], got[at(0), 2]["x_mean_km"]) == (0, None, None)
    assert (got[at(9), 1]["x_n"], got[at(9), 1]["x_weight"], got[at(9), 1]["x_min_km"]) == (0, 0.0, 1.0)


def test_nearest_few_and_differences(spark):
    keys, pairs, env = frames(spark)
    found = en.local_environment(keys, pairs, env, "lst", "x", hours=1, k=2)
    r = en.differences(found.selectExpr("*", "28.0 AS lst"), "lst", "x").where("station_id = 1 AND x_n > 0").first()
    assert (r["x_n"], r["x_idw"], r["x_nearest_rank"], r["lst_minus_x_idw"], r["lst_minus_x_nearest_abs"]) == (1, 26.0, 2, 2.0, 2.0)


def test_equal_ids_of_two_networks_do_not_mix(spark):
    left = spark.createDataFrame([(at(0), 1, "a"), (at(0), 1, "b")], "date timestamp, station_id long, network string")
    right = spark.createDataFrame([(at(-1), 1, "b", 7.0)], "date timestamp, station_id long, network string, v double")
    assert {r["network"]: r["v"] for r in ft.asof(left, right, "v").collect()} == {"a": None, "b": 7.0}
