"""Station ids and flag panels on hand-made cases."""

import pytest

from skyledger.operators import identity
from skyledger.sources import panels


def ids(spark, *rows):
    return spark.createDataFrame(list(rows), "station_id string, network string")


def test_unique_ambiguous_unknown_and_missing_ids(spark):
    observed = spark.createDataFrame([("m1",), ("p2",), ("m2",), (" x ",), ("nan",), (None,)], "station_id string")
    rows = [("p1_m1", "Netatmo"), ("p2_m2", "Netatmo"), ("p9_m9", "Netatmo"), ("p9_m9", "ows"), (" x", None), ("NaN", None), (None, None), ("_", "netatmo"), ("a_b_m1", "ows"), ("m1_m1", "ows")]
    got = {(r["station_id"], r["network"]): (r["canonical"], r["n_matches"], r["status"], r["n_sharing"]) for r in identity.resolve(ids(spark, *rows, *rows), observed, network="network").collect()}
    assert got == {
        ("p1_m1", "netatmo"): ("m1", 1, "unique", 3), ("p2_m2", "netatmo"): ("m2", 2, "ambiguous", 1), ("p9_m9", "netatmo"): ("m9", 0, "unknown", 1), ("p9_m9", "ows"): ("p9_m9", 0, "unknown", 1),
        (" x", None): ("x", 1, "unique", 1), ("NaN", None): (None, 0, "missing", None), (None, None): (None, 0, "missing", None), ("_", "netatmo"): ("_", 0, "unknown", 1),
        ("a_b_m1", "ows"): ("m1", 1, "unique", 3), ("m1_m1", "ows"): ("m1", 1, "unique", 3),
    }
    back = identity.canonicalize(ids(spark, *rows).withColumnRenamed("network", "canonical"), observed, network="canonical")
    assert back.columns == ["station_id", "canonical"] and back.count() == len(rows)


def test_without_observed_ids_nothing_matches(spark):
    none = spark.createDataFrame([], "station_id string")
    r = identity.resolve(ids(spark, ("a_b", "Netatmo")), none, network="network").first()
    assert (r["canonical"], r["status"]) == ("b", "unknown")
    assert [(x["name"], x["chosen"]) for x in identity.alias_report(ids(spark, ("a", None)), none).collect()] == [("raw", True)]
    assert identity.resolve(ids(spark).limit(0), none).count() == 0


def test_aliases_of_all_separators(spark):
    observed = spark.createDataFrame([("a",), ("b",), ("c",)], "station_id string")
    got = {r["name"]: r for r in identity.alias_report(ids(spark, ("x||a", None), ("y/b", None), ("c", None), ("q_r", None)), observed).collect()}
    assert set(got) == set(identity.ALIASES)
    assert (got["after_last_doublepipe"]["n_overlap"], got["after_last_doublepipe"]["examples"], got["after_last_slash"]["examples"]) == (2, "a, c", "b, c")
    assert [n for n, r in got.items() if r["chosen"]] == ["after_last_doublepipe"]


def test_the_column_to_join_by(spark):
    df = spark.createDataFrame([("1", "9", "7")], "station_id string, module_final string, src_id string")
    known = spark.createDataFrame([("7",)], "station_id string")
    assert identity.station_column(df, known) == "src_id"
    assert identity.station_column(df, spark.createDataFrame([("5",)], "station_id string"), "Netatmo") == "module_final"
    assert identity.station_column(df) == "station_id" and identity.station_column(df, explicit="src_id") == "src_id"
    with pytest.raises(KeyError):
        identity.station_column(df, explicit="gone")
    with pytest.raises(KeyError):
        identity.station_column(df.select(df.src_id.alias("other")))


def written(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def test_flag_panel_pairs_values_and_flags(spark, tmp_path):
    path = written(tmp_path, "f.csv", "﻿Date,a:1,a:1_is_outlier,b,b_is_outlier,c,d_is_outlier\n2024-01-01 00:00:00,1.5,0,,1,3,1\n2024-01-01 00:00:00,1.5,1,2,,3,1\n2024-01-01 01:00:00,2.5,0.0,4,1,5,0\nnever,1,1,1,1,1,1\n")
    got = {(r["date"].hour, r["station_id"]): r["qc_strict_is_outlier"] for r in panels.flag_panel(spark, path, "strict").collect()}
    assert got == {(0, "a:1"): 1, (0, "b"): None, (1, "a:1"): 0, (1, "b"): 1}
    layout = panels.flag_layout(panels.read_csv(spark, path).columns)
    assert layout == {"paired": ["a:1", "b"], "flags_only": ["d"], "values_only": ["c"]}
    assert {r["station_id"] for r in panels.panel(spark, path).select("station_id").distinct().collect()} == {"a:1", "b", "c"}


def test_flag_panel_without_values_without_flags_and_with_values_for_flags(spark, tmp_path):
    only = written(tmp_path, "o.csv", "date,a_is_outlier\n2024-01-01 00:00:00,1\n2024-01-01 01:00:00,\n")
    assert [r["qc_x_is_outlier"] for r in panels.flag_panel(spark, only, "x").orderBy("date").collect()] == [1, None]
    with pytest.raises(ValueError, match="no flags"):
        panels.flag_panel(spark, written(tmp_path, "n.csv", "date,a\n2024-01-01 00:00:00,1\n"), "x")
    with pytest.raises(Exception, match="not a flag: 17.5"):
        panels.flag_panel(spark, written(tmp_path, "w.csv", "date,a,a_is_outlier\n2024-01-01 00:00:00,1,17.5\n"), "x").collect()


def test_levels_merge_and_ambiguous_ids_show(spark):
    row = lambda c, *rows: spark.createDataFrame(list(rows), f"date string, station_id string, {c} int")
    merged = panels.merge_flags({"lenient": row("qc_lenient_is_outlier", ("d1", "a", 1), ("d1", "b", 0)), "strict": row("qc_strict_is_outlier", ("d1", "a", 0), ("d2", "a", 1), ("d1", "c", None))})
    assert {(r[0], r[1]): (r[2], r[3]) for r in merged.collect()} == {("d1", "a"): (1, 0), ("d1", "b"): (0, None), ("d2", "a"): (None, 1), ("d1", "c"): (None, None)}
    rows = spark.createDataFrame([("d1", "a", "cws"), ("d1", "a", "ows"), ("d1", "b", "cws"), ("d9", "b", "cws")], "date string, station_id string, network string")
    report = {r["level"]: tuple(r)[1:] for r in panels.flag_coverage(panels.attach_flags(rows, merged)).collect()}
    assert report == {"lenient": (3, 0.75, 2, 0.666667, 2), "strict": (2, 0.5, 0, 0.0, 2)}


def test_flag_files_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("2024-01-01 00:00:00", "1", 5.0), ("2024-01-01 00:00:00", "2", 50.0), ("2024-01-01 01:00:00", "1", None), ("2024-01-01 01:00:00", "2", 6.0)], "date string, station_id string, temp double").selectExpr("CAST(date AS timestamp) AS date", "station_id", "temp")
    path = f"file://{tmp_path}/out"
    panels.write_flag_panel(raw, raw.where("temp < 40"), path)
    assert panels.header(spark, path) == "date,1,1_is_outlier,2,2_is_outlier"
    got = {(r["date"].hour, r["station_id"]): r["qc_l_is_outlier"] for r in panels.flag_panel(spark, path, "l").collect()}
    assert got == {(0, "1"): 0, (0, "2"): 1, (1, "2"): 0}
