"""Every query of the catalog against its SQL, and hand-made edge cases."""

import datetime as dt
import math

import duckdb
import pytest

from skyledger.operators import evaluation as ev
from skyledger.operators import features as ft
from skyledger.operators import qc
from skyledger.plans import catalog, chain, context, environment, intake, learning, products, robustness, uncertainty

SF = "/root/testdata/sf0.01"
TABLES = "supplier events lineitem orders".split()
PLANS = (catalog, products, context, chain, robustness, learning, intake, uncertainty, environment)


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


QUERIES = {n: q for p in PLANS for n, q in p.QUERIES.items()}
ORACLES = {n: q for p in PLANS for n, q in p.ORACLES.items()}


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert got == want
    assert got, "an empty result tests nothing"


def obs(spark, values):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(hours=i), 1, "cws", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date timestamp, station_id long, network string, temp double")


def temps(df):
    return [r["temp"] for r in df.orderBy("date").collect()]


def test_limits_are_open(spark):
    assert temps(qc.limit_test(obs(spark, [-40.0, -39.9, 59.9, 60.0]))) == [None, -39.9, 59.9, None]


def test_slope_takes_jump_and_return(spark):
    assert temps(qc.slope_test(obs(spark, [10.0, 35.0, 12.0]))) == [10.0, None, None]


def test_consistency_takes_seven_equal_values(spark):
    assert temps(qc.consistency_test(obs(spark, [3.0] * 7))) == [None] * 7


def test_consistency_takes_edges_of_a_gap(spark):
    values = [1.0, 5.0, 9.0, 3.0] + [None] * 7 + [4.0, 8.0, 2.0, 7.0, 1.0, 6.0, 9.0, 2.0]
    got = temps(qc.consistency_test(obs(spark, values)))
    assert [i for i, v in enumerate(values) if v is not None and got[i] is None] == [3, 11]


def test_asof_tie_goes_back(spark):
    t = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(t + dt.timedelta(hours=5), 1)], "date timestamp, station_id long")
    right = spark.createDataFrame([(t + dt.timedelta(hours=h), 1, float(h)) for h in (3, 7)], "date timestamp, station_id long, v double")
    assert ft.asof(left, right, "v", "nearest", 3).first()["v"] == 3.0
    row = ft.asof(left, right, "v", "backward", 1).first()
    assert row["v"] is None and row["missing"] == 1


def test_sigma_has_a_floor(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5, "g string, x double")
    assert ft.robust_sigma(df, ["g"], "x").first()["sigma"] == 0.2


def test_reliability_puts_one_in_the_last_bin(spark):
    df = spark.createDataFrame([("test", 1.0, 1)], "split string, p double, y int")
    assert ev.reliability(df).first()["bin"] == 14


def test_bootstrap_takes_500_draws(spark):
    import hashlib

    import numpy as np

    own = {1: (2, 3.0), 2: (1, 5.0), 3: (3, 1.5), 4: (1, 0.25)}
    df = spark.createDataFrame([(k, s / n) for k, (n, s) in own.items() for _ in range(n)], "station_id long, resid double")
    maes = []
    for b in range(1, 501):
        drawn = [list(own.values())[int(hashlib.md5(f"2026-{b}-{i}".encode()).hexdigest()[:8], 16) % 4] for i in range(4)]
        maes.append(sum(s for _, s in drawn) / sum(n for n, _ in drawn))
    got = ev.bootstrap(df).first()
    assert [got[k] for k in ("low", "mid", "high")] == pytest.approx(np.quantile(maes, [0.025, 0.5, 0.975]).tolist(), abs=2e-6)
