"""Selection of features and learned models on data whose answer is known."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyledger.operators import columns as cl
from skyledger.operators import learning as le

QUICK = {"rounds": 15, "rate": 0.3, "depth": 3}


def rows(spark, n=1200):
    """risk: solar over 10 and a cold label; the split goes by thirds; station 0..7."""
    data = []
    for i in range(n):
        solar, kind = i * 37 % 20, ("a", "b", None)[i * 7 % 3]
        data.append((i % 8, ("train", "valid", "test")[i // 5 % 3], float(solar) if i % 11 else None, kind, i * 13 % 5 / 1.0, 5.0 + solar, int(solar > 10 or kind == "b")))
    return spark.createDataFrame(data, "station_id long, split string, solar double, cover_lg string, noise double, temp_raw double, target_ref_risk int")


def test_names_decide_what_a_mode_sees(spark):
    schema = "date timestamp, station_id long, source_station_id string, station_lat double, LC_point int, LC_point_lg string, ref_mu_idw double, abs_ref_resid double, station_ref_bias double, strict_qc int, wind double, target_x int, network string"
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1, "x", 1.0, 50, "urban", 1.0, 1.0, 1.0, 0, 1.0, 1, "cws")], schema)
    assert cl.risk_features(df, "context_static_met") == (["LC_point_lg", "wind", "network"], ["LC_point_lg", "network"])
    assert cl.risk_features(df, "context_only")[0] == ["LC_point_lg", "station_ref_bias", "wind", "network"]
    assert cl.risk_features(df, cl.DIAGNOSTIC_MODE, flags=True, coordinates=True, codes=True)[0] == ["station_lat", "LC_point", "LC_point_lg", "ref_mu_idw", "station_ref_bias", "strict_qc", "wind", "network"]
    assert cl.regression_features(df, exclude=["wind"]) == (["station_lat", "LC_point_lg", "station_ref_bias", "strict_qc", "target_x"], ["LC_point_lg"])
    with pytest.raises(ValueError):
        cl.risk_features(df, "all")
    with pytest.raises(ValueError, match="wind_risk"):
        cl.checked_features(df.withColumnRenamed("wind", "wind_risk"), "context_history")


def test_long_texts_are_no_categories(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("wide"), (F.col("id") % 100).cast("string").alias("narrow"), F.lit(None).cast("string").alias("none"))
    assert cl.regression_features(df) == (["narrow", "none"], ["narrow", "none"])


def test_risk_learns_and_names_what_it_used(spark):
    df = rows(spark)
    model = le.fit_risk(df, "target_ref_risk", ["solar", "cover_lg", "noise"], ["cover_lg"], **QUICK)
    wrong = model.risk(df).where("split = 'test' AND solar IS NOT NULL").where("(pred_ref_risk_prob >= 0.5) <> (target_ref_risk = 1)").count()
    assert wrong == 0 and 1 <= model.rounds <= 15
    weight = {r["feature"]: r["importance"] for r in model.importance(spark).collect()}
    assert abs(sum(weight.values()) - 1) < 1e-6 and weight["noise"] < 0.05 < min(weight["solar"], weight["cover_lg"])
    # Unknown and missing categories have a score, and no row goes.
    assert model.risk(df.withColumn("cover_lg", F.lit("new"))).where("pred_ref_risk_prob IS NOT NULL").count() == 1200


def test_risk_needs_both_classes_and_held_rows(spark):
    df = rows(spark, 120)
    with pytest.raises(ValueError, match="one class"):
        le.fit_risk(df.where("target_ref_risk = 1"), "target_ref_risk", ["solar"], [], **QUICK)
    with pytest.raises(ValueError, match="valid"):
        le.fit_risk(df.where("split = 'train'"), "target_ref_risk", ["solar"], [], **QUICK)


def test_reference_holds_stations_out(spark):
    df = rows(spark, 800).withColumn("temp_raw", F.when(F.rand(3) > 0.02, F.col("temp_raw")))
    df = df.withColumn("solar", F.col("temp_raw") - 5)
    out, models = le.held_out_reference(df, "temp_raw", ["solar", "noise"], [], n=3, **(QUICK | {"rounds": 25}))
    got = out.agg(F.count("*"), F.count("ref_mu_learned"), F.count("temp_raw"), F.max("abs_ref_resid_learned")).first()
    assert got[0] == 800 and got[1] == got[2] and got[3] < 1.5 and len(models) == 3
    assert out.where("fold IS NOT NULL").groupBy("station_id").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    final = le.fit_reference(df, "temp_raw", ["solar"], [], **QUICK)
    assert final.predict(df.where("temp_raw IS NOT NULL")).where(F.abs(F.col("ref_mu_learned") - F.col("temp_raw")) > 2).count() == 0
    with pytest.raises(ValueError):
        le.held_out_reference(df.where("station_id = 1"), "temp_raw", ["solar"], [], **QUICK)


def test_targets(spark):
    df = spark.createDataFrame([("high_confidence_high_risk", "1"), ("high_confidence_low_risk", "x"), ("ambiguous", None), (None, "0")], "target_ref_risk_band_z string, target_ref_risk string")
    auto, name = le.training_target(df)
    assert [(r[name], r["is_model_labeled"]) for r in auto.collect()] == [(1, 1), (0, 1), (None, 0), (None, 0)]
    hard, name = le.training_target(df, "hard")
    assert [(r[name], r["is_model_labeled"]) for r in hard.collect()] == [(1.0, 1), (None, 0), (None, 0), (0.0, 1)]
    with pytest.raises(KeyError):
        le.training_target(df.drop("target_ref_risk"), "hard")


def test_ordered_target_does_not_leak(spark):
    import random

    from skyledger.operators import encoding

    rng = random.Random(3)
    # A category of its own for every row, and one that holds half of the rows: neither tells the target.
    rows = [(i, f"own{i}" if i % 2 else "big", rng.randint(0, 1) if i % 7 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, c string, y int")
    got = {r["id"]: r["code"] for r in encoding.ordered_target(df, "c", "y", ["id"], "code").collect()}
    assert len(got) == 2000 and {got[i] for i in range(1, 2000, 2)} == {0.5}
    places = {r["id"]: r["p"] for r in df.select("id", encoding.place(df.id).alias("p")).collect()}
    order = sorted((i for i in range(0, 2000, 2)), key=places.get)
    n = s = 0
    for i in order:
        assert got[i] == pytest.approx((s + 0.5) / (n + 1))
        y = rows[i][2]
        n, s = n + (y is not None), s + (y or 0)
    leaky = {r["c"]: r["code"] for r in encoding.category_means(df, "c", "y", "code").collect()}
    assert leaky["big"] == pytest.approx((s + 0.5) / (n + 1))
    odd = [(got[i], rows[i][2]) for i in range(1, 2000, 2) if rows[i][2] is not None]
    assert len({c for c, _ in odd}) == 1, "with a plain mean each of these would be its own target"


def test_ordered_target_of_missing_categories_and_shared_keys(spark):
    from skyledger.operators import encoding

    df = spark.createDataFrame([(1, None, 1), (1, None, 0), (2, None, 1)], "id long, c string, y int")
    got = encoding.ordered_target(df, "c", "y", ["id"], "code").collect()
    assert len(got) == 3 and len({r["code"] for r in got if r["id"] == 1}) == 1
    assert encoding.ordered_target(df.limit(0), "c", "y", ["id"], "code").count() == 0


def test_held_rows_have_no_part_in_their_model(spark):
    # Another answer in one station changes what is predicted for the others, never for itself.
    rows = [(s, float(i % 10), (i % 10) + s % 3 + (i * 7 % 5) / 10) for s in range(1, 7) for i in range(60)]
    df = spark.createDataFrame(rows, "station_id long, x double, temp_raw double")
    other = df.withColumn("temp_raw", F.when(F.col("station_id") == 2, 100 - F.col("temp_raw")).otherwise(F.col("temp_raw")))
    mu = []
    for d in (df, other):
        out, _ = le.held_out_reference(d, "temp_raw", ["x"], [], n=3, stop="others", **(QUICK | {"rounds": 5}))
        mu.append({(r["station_id"], r["x"]): r["ref_mu_learned"] for r in out.select("station_id", "x", "ref_mu_learned").distinct().collect()})
    assert all(mu[0][k] == pytest.approx(mu[1][k]) for k in mu[0] if k[0] == 2)
    assert any(abs(mu[0][k] - mu[1][k]) > 1 for k in mu[0] if k[0] != 2)
