"""Files of stations as they come, and hand-made cases of the quality chain and the checked joins."""

import datetime as dt

import pytest

from skyledger.operators import chain
from skyledger.operators import tables as tb
from skyledger.sources import panels

T0 = dt.datetime(2024, 1, 1)
OBS = "date timestamp, station_id long, network string, temp double"


def hours(spark, series):
    """series: station to values, an hour each."""
    return spark.createDataFrame([(T0 + dt.timedelta(hours=i), s, "cws", v) for s, values in series.items() for i, v in enumerate(values)], OBS)


def test_panel_with_mark_semicolons_and_bad_cells(spark, tmp_path):
    path = tmp_path / "ta.csv"
    path.write_text("﻿ Date ;7.0; abc\n2024-01-01 00:00:00;1.5;x\n2024-01-01 01:00:00;;NaN\n2024-01-01 01:00:00;2.5;3\nbad;9;9\n", encoding="utf-8")
    got = panels.panel(spark, f"file://{path}").orderBy("station_id", "date").collect()
    assert [(r["station_id"], r["date"].hour, r["temp"]) for r in got] == [("7", 0, 1.5), ("7", 1, 2.5), ("abc", 0, None), ("abc", 1, 3.0)]


def test_panel_reads_the_columns_that_are_wanted(spark, tmp_path):
    path = tmp_path / "ta.csv"
    path.write_text("date,a,b\n2024-01-01 00:00:00,1,2\n")
    df = panels.panel(spark, f"file://{path}", stations=["b", "gone"])
    assert [(r["station_id"], r["temp"]) for r in df.collect()] == [("b", 2.0)]


@pytest.mark.parametrize("line, sep", [("date,a;b,c", ","), ("date;a", ";"), ("date\ta", "\t"), ("date|a", "|"), ("date", ",")])
def test_delimiter(line, sep):
    assert panels.delimiter(line) == sep


def test_metadata_by_other_names(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text("_id,Latitude,lon,altitude,lcz\n3.0,52.5,13.4,34,6\n3,0,0,0,1\n,1,1,1,1\nx,n/a,1,,2\n")
    got = {r["station_id"]: r for r in panels.metadata(spark, f"file://{path}").collect()}
    assert set(got) == {"3", "x"} and got["x"]["lat"] is None and got["x"]["elev"] is None and got["x"]["long"] == 1.0


def test_optional_and_reuse(spark, tmp_path):
    assert panels.optional(panels.read_csv, spark, f"file://{tmp_path}/none.csv") is None
    assert panels.optional(panels.read_csv, spark, None) is None
    at, built = f"file://{tmp_path}/held", []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert [panels.reuse(spark, at, build).count() for _ in range(2)] == [1, 1] and len(built) == 1
    assert panels.reuse(spark, at, build, rebuild=True).count() == 2


def test_discovery_takes_the_best_file_of_each_level(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("deep/ta_cws_qc_flagged_strict.csv", "ta_cws_qc_flagged_strict.csv", "cws_flagged_strict.csv", "flagged_loose.csv", "ta_cws_qc_flagged_ultra_strict.csv", "ta_strict.csv", "flagged_lenient.txt"):
        (tmp_path / name).write_text("date\n")
    found = panels.discover(spark, f"file://{tmp_path}")
    assert {k: v.rsplit(f"{tmp_path.name}/")[-1] for k, v in found.items()} == {"lenient": "flagged_loose.csv", "strict": "ta_cws_qc_flagged_strict.csv", "ultra_strict": "ta_cws_qc_flagged_ultra_strict.csv"}
    assert panels.discover(spark, f"file://{tmp_path}/none") == {}


def test_run_folders_and_manifests(spark, tmp_path):
    names = [panels.run_folder(spark, f"file://{tmp_path}", "run").rsplit("/", 1)[1] for _ in range(3)]
    assert names == ["run", "run__repeat002", "run__repeat003"]
    content = {"n": 1, "names": ["ä", None]}
    panels.write_json(spark, f"file://{tmp_path}/run/m.json", content)
    assert panels.read_json(spark, f"file://{tmp_path}/run/m.json") == content
    panels.write_csv(spark.range(2), f"file://{tmp_path}/run/t")
    assert panels.read_csv(spark, f"file://{tmp_path}/run/t").count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        panels.write_csv(spark.range(2), f"file://{tmp_path}/run/t")


def test_trust_counts_all_hours_of_the_panel(spark):
    # Station 2 has five rows, two of them flagged: of the panel's ten hours that is a fifth, not more.
    obs = hours(spark, {1: [1.0] * 10, 2: [1.0] * 5, 3: [1.0] * 5}).selectExpr("*", "(station_id = 2 AND hour(date) < 2) OR (station_id = 3 AND hour(date) < 3) AS bad")
    got = chain.trust_test(obs, "bad").where("temp IS NOT NULL").groupBy("station_id").count().collect()
    assert {r["station_id"]: r["count"] for r in got} == {1: 10, 2: 5}


def test_group_test_needs_five_values_and_a_spread(spark):
    four, flat = hours(spark, {s: [float(s)] for s in range(4)}), hours(spark, {s: [2.0] for s in range(6)})
    for obs in (four, flat):
        assert chain.distribution_test(obs, "qn").where("temp IS NOT NULL").count() == 0
    kept = chain.distribution_test(hours(spark, {**{s: [10.0 + s / 10] for s in range(9)}, 9: [40.0]}), "qn")
    assert 9 not in {r["station_id"] for r in kept.where("temp IS NOT NULL").collect()}


def test_buddies_take_out_what_is_far_from_all_of_them(spark):
    meta = spark.createDataFrame([(s, 52.5 + s / 1e4, 13.4, 30.0) for s in range(7)] + [(7, 52.5, 13.4, 300.0), (8, 53.5, 13.4, 30.0)], "station_id long, lat double, long double, elev double")
    pairs = chain.buddy_pairs(meta)
    assert {r["station_id"] for r in pairs.collect()} == set(range(7))
    series = {s: [10.0 + s / 10] for s in range(6)} | {6: [30.0], 7: [99.0], 8: [99.0]}
    gone = chain.buddy_test(hours(spark, series), pairs).where("temp IS NULL").collect()
    assert 6 in {r["station_id"] for r in gone} and not {7, 8} & {r["station_id"] for r in gone}


def test_checked_joins(spark):
    one = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "k int, flag int")
    two = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "k int, flag int")
    assert {r["k"]: r["label"] for r in tb.weak_labels(one, two, ["k"]).collect()} == {1: 1, 2: 0, 3: None}
    assert tb.levels(one, two, ["k"]).where("strict IS NULL").count() == 1
    with pytest.raises(ValueError, match="share the key"):
        tb.weak_labels(one.union(one), two, ["k"])
    with pytest.raises(Exception, match="not a flag"):
        tb.weak_labels(one.withColumn("flag", one["flag"] + 1), two, ["k"]).collect()


def test_interval_lookup_closes_the_last_bin(spark):
    bins = spark.createDataFrame([(0.0, 0.5, "a"), (0.5, 1.0, "b")], "lo double, hi double, name string")
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.5, 1.0, 1.1, None)], "x double")
    assert [r["name"] for r in tb.interval_lookup(df, bins, "x", ["name"]).orderBy("x").collect()] == [None, None, "a", "b", "b", None]
