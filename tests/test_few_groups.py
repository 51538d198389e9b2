"""Order statistics of few large groups: exact, and exchanged by bucket instead of by value."""

import math

from pyspark.sql import functions as F

from skyledger.operators import features, ranks


def values(spark):
    r = F.col("id")
    v = F.when(r % 7 > 0, F.round((r * 7919 % 20011 - 10000) * F.pow(F.lit(10.0), r % 5 - 2), 5))
    return spark.range(20000).select(F.when(r % 3 > 0, r % 3).alias("g"), v.alias("v"))


def test_the_same_as_by_one_reading(spark):
    df = values(spark)
    at = {"low": 0.0, "q": 0.333, "mid": 0.5, "high": 1.0}
    for by in (["g"], []):
        want, got = (sorted((tuple(r) for r in f(df, by, "v", at).collect()), key=str) for f in (ranks.quantiles, ranks.quantiles_of_few))
        assert got == want and got
    a, b = ({r["g"]: r for r in f(df, ["g"], "v").collect()} for f in (features.robust_sigma, features.robust_sigma_of_few))
    assert set(a) == set(b) == {None, 1, 2}
    assert all(a[g]["n"] == b[g]["n"] and math.isclose(a[g]["sigma"], b[g]["sigma"]) for g in a)
    none = spark.createDataFrame([(1, None)], "g int, v double")
    assert features.robust_sigma_of_few(none, ["g"], "v").count() == 0 and ranks.quantiles_of_few(none, [], "v", at).count() == 0
    flat = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0)], "g int, v double")
    assert {r["sigma"] for r in features.robust_sigma_of_few(flat, ["g"], "v").collect()} == {0.2}


def test_no_exchange_holds_the_values(spark, tmp_path):
    spark.range(200000).select(F.lit(1).alias("g"), (1 + F.col("id") / 200000).alias("v")).write.parquet(str(tmp_path / "rows"))
    got = features.robust_sigma_of_few(spark.read.parquet(str(tmp_path / "rows")), ["g"], "v")
    assert got.count() == 1
    written = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            written.append(plan.metrics().apply("shuffleRecordsWritten").value())
        inner = plan.children()
        kids = [inner.apply(i) for i in range(inner.size())]
        if name == "AdaptiveSparkPlanExec":
            kids.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            kids.append(plan.plan())
        for k in kids:
            walk(k)

    got = features.robust_sigma_of_few(spark.read.parquet(str(tmp_path / "rows")), ["g"], "v")
    got.collect()
    walk(got._jdf.queryExecution().executedPlan())
    assert written and max(written) < 20000
