"""Draws of blocks are added up as they are made: the same sums as by counting how often each is drawn."""

from pyspark.sql import functions as F

from skyledger.operators import robust


def test_sums_of_draws(spark):
    sums = spark.createDataFrame([(str(i) if i else None, g, i + 1, 2 * i) for i in range(50) for g in ("a", "b") if i % 3 or g == "a"], "block string, g string, n long, m long")
    blocks = sums.select("block").distinct()
    got = robust.drawn_sums(blocks, sums, ["g"], ["n", "m"], 30)
    counted = robust.drawn(blocks, 30).join(sums.withColumnRenamed("block", "_own"), F.col("block").eqNullSafe(F.col("_own")))
    want = counted.groupBy("b", "g").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("m")).alias("m"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect()) and got.count() > 30
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan
