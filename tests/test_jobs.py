"""The jobs: SQL over the given tables, two runs over growing input, failed and repeated runs."""

import datetime as dt
import logging

import duckdb
import pytest

from jobs import common, intake_audit, queries, station_hours
from skyledger.operators import reports

from .test_catalog import text

SF = "/root/testdata/sf0.01"
TABLES = "documents conversations pages benchmark labels embeddings events supplier lineitem".split()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert got == want and got


T0 = dt.datetime(2024, 3, 1)


def add(spark, folder, rows):
    """rows: hour from T0, user, value."""
    df = spark.createDataFrame([(T0 + dt.timedelta(hours=h, minutes=7), u, v) for h, u, v in rows], "ts timestamp, user_id long, value double")
    df.coalesce(1).write.mode("append").parquet(folder)


def settings(spark):
    return common.config(spark, None, station_hours.CONFIG) | {"least_stations": 1, "z_bound": 100, "flat_hours": 3}


def state(df):
    return sorted((r["date"], r["station_id"], r["network"], r["temp"], r["n_readings"], r["flag"]) for r in df.collect())


def test_growing_input_equals_one_run(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    c, src, out = settings(spark), f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    waves = [
        [(h, u, 10.0 + (h * u) % 5) for h in range(30) for u in (1, 2)],
        # Late readings change an hour in the middle; the next day begins with a jump from the old one's end.
        [(23, 1, 40.0), (23, 1, 55.0), (5, 2, 70.0)] + [(h, 1, 12.0) for h in range(60, 66)],
        [(48, 1, 11.0), (47, 1, 45.0)],
    ]
    for k, rows in enumerate(waves):
        add(spark, src, rows)
        got = station_hours.run(spark, src, out, c)
        once = station_hours.run(spark, src, f"file://{tmp_path}/once{k}", c)
        assert state(got) == state(once)
    flags = {(r["date"], r["station_id"]): r["flag"] for r in got.collect()}
    assert flags[T0 + dt.timedelta(hours=60), "1"] == "flat"
    assert flags[T0 + dt.timedelta(hours=23), "1"] == "slope" and flags[T0 + dt.timedelta(hours=5), "2"] in ("limit", "slope")
    before = state(got)
    n = sum("station_hours: batch" in m for m in caplog.messages)
    assert state(station_hours.run(spark, src, out, c)) == before
    assert sum("station_hours: batch" in m for m in caplog.messages) == n, "a run without new files takes no batch"
    log = spark.read.schema(station_hours.LOGGED).parquet(f"{out}/log").orderBy("batch").collect()
    assert [r["read"] for r in log] == [len(w) for w in waves]


def test_a_batch_that_failed_runs_again(spark, tmp_path, monkeypatch):
    c, src, out = settings(spark), f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    add(spark, src, [(h, 1, 10.0 + h % 4) for h in range(10)])
    real = station_hours.flagged
    monkeypatch.setattr(station_hours, "flagged", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        station_hours.run(spark, src, out, c)
    monkeypatch.setattr(station_hours, "flagged", real)
    assert state(station_hours.run(spark, src, out, c)) == state(station_hours.run(spark, src, f"file://{tmp_path}/once", c))


def test_readings_without_value_time_or_station(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    rows = [(T0, 1, None), (None, 1, 3.0), (T0, None, 3.0), (T0, 1, float("nan")), (T0, 1, 4.0)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, value double").write.parquet(src)
    got = station_hours.run(spark, src, f"file://{tmp_path}/out", settings(spark)).collect()
    assert [(r["temp"], r["n_readings"]) for r in got] == [(4.0, 1)]
    with pytest.raises(ValueError, match="flat_hours"):
        station_hours.run(spark, src, f"file://{tmp_path}/x", settings(spark) | {"flat_hours": 12})


def test_missingness_counts(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, [1.0], "p"), (" ", nan, [], "p"), (None, inf, [None], "q"), ("bcd", None, [nan], None)]
    df = spark.createDataFrame(rows, "s string, `x.y` double, l array<double>, g string")
    got = {(r["part"], r["column"]): r for r in reports.missingness(df, "g").collect()}
    assert (got["p", "s"]["n_blank"], got["p", "s"]["mean_length"], got["q", "s"]["n_null"]) == (1, 1.0, 1)
    assert (got["p", "x.y"]["n_unusable"], got["q", "x.y"]["missing_share"], got["", "x.y"]["n_null"]) == (1, 1.0, 1)
    assert (got["p", "l"]["n_blank"], got["q", "l"]["n_unusable"], got["", "l"]["n_unusable"]) == (1, 1, 1)


def test_coverage_counts(spark):
    base = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k long")
    other = spark.createDataFrame([(1, 5.0), (1, None), (2, None), (9, 1.0), (None, 1.0)], "k long, v double")
    r = reports.coverage(base, other, ["k"], ["v"]).first()
    assert (r["n_keys"], r["other_rows"], r["other_filled"], r["other_keys"], r["n_shared"], r["n_repeated"], r["coverage"]) == (3, 4, 2, 2, 1, 1, 0.333333)
    assert reports.coverage(base.limit(0), other, ["k"], ["v"]).first()["coverage"] is None


def test_audit_replaces_its_partitions_and_skips_what_is_not_there(spark, tmp_path, caplog):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    c = {"tables": {"docs": None, "gone": None}, "coverage": [{"base": "docs", "other": "gone", "keys": ["k"], "values": ["v"]}], "warn_share": 0.2}
    spark.createDataFrame([(1, "a"), (2, None)], "k long, text string").write.parquet(f"{src}/docs.parquet")
    first = intake_audit.run(spark, src, out, c).collect()
    assert intake_audit.run(spark, src, out, c).collect() == first
    assert {(r["column"], r["status"]) for r in first} == {("k", "ok"), ("text", "warn")}
    assert "gone.parquet is not there" in caplog.text
    spark.createDataFrame([(3, None)], "k long, text string").write.mode("append").parquet(f"{src}/docs.parquet")
    assert {r["n_rows"] for r in intake_audit.run(spark, src, out, c).collect()} == {3}
