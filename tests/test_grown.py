"""Steps whose memory or exchanges grew with the rows: what they exchange, and their results by hand."""

import hashlib

from pyspark.sql import functions as F

from skyledger.operators import calibration as cal
from skyledger.operators import tables as tb


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_of_large_groups_take_each_row_once(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, concat('g', id % 3)) AS g", "id % 1000 AS k").unionByName(spark.createDataFrame([("few", 7), ("few", 7)], "g string, k long"))
    got = {}
    for r in tb.samples(df, "g", ["k"], 5).collect():
        got.setdefault(r["g"], []).append(r["k"])
    code = lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest()
    want = {}
    for r in df.distinct().collect():
        want.setdefault(r["g"], []).append(r["k"])
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(sorted(v, key=code)[:5]) for g, v in want.items()}


def test_labels_meet_without_a_join_and_null_keys_have_none(spark):
    one = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1)], "k int, flag int")
    two = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (None, 1)], "k int, flag int")
    out = tb.weak_labels(one, two, ["k"])
    assert "Join" not in plan(out)
    assert {r["k"]: r["label"] for r in out.collect()} == {1: 1, 2: 0}


def test_sigma_goes_to_the_rows_without_an_exchange_of_them(spark):
    df = spark.range(900).selectExpr("'train' AS split", "IF(id % 4 = 0, NULL, id % 2) AS a", "CAST(id * id % 97 AS DOUBLE) AS resid")
    out = cal.with_sigma(df, [["a"]], 200)
    # One kept table of all groups goes to the rows by broadcast.
    outer = plan(out).split("InMemoryRelation")[0]
    assert "SortMergeJoin" not in outer and "BroadcastHashJoin" in outer
    assert out.count() == 900 and {r["n"] for r in out.groupBy("a").agg(F.count_distinct("sigma").alias("n")).collect()} == {1}
