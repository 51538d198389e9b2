"""The linear baseline on data with a known answer."""

import math
import random

import pytest

from skyledger.operators import sgd


def data(spark, n=6000, seed=1):
    """Two numbers and a category decide; a third number is noise; one class is rare."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b, c, noise = rng.gauss(50, 10), rng.gauss(0, 0.01), rng.choice("pqr"), rng.gauss(0, 1)
        z = 0.2 * (a - 50) - 150 * b + {"p": 3, "q": 0, "r": -3}[c] - 3
        y = int(rng.random() < 1 / (1 + math.exp(-z)))
        rows.append((i, None if i % 50 == 0 else a, b, None if i % 41 == 0 else c, noise, y))
    return spark.createDataFrame(rows, "id long, a double, b double, c string, noise double, y int").repartition(4, "id")


def auroc(rows):
    rows = sorted(rows, key=lambda r: r["risk"])
    pos = sum(r["y"] for r in rows)
    ranks = sum(i + 1 for i, r in enumerate(rows) if r["y"])
    return (ranks - pos * (pos + 1) / 2) / (pos * (len(rows) - pos))


def test_it_finds_what_decides(spark):
    df = data(spark)
    model = sgd.fit_logistic(df, "y", ["a", "b", "noise"], ["c"])
    held = model.risk(data(spark, 3000, 2)).collect()
    assert auroc(held) > 0.9
    assert model.losses[-1] < 0.75 * model.losses[0]
    a, b, noise = model.weights[:3]
    assert a > 1 and b < -1 and abs(noise) < 0.2
    by = {c: model.risk(spark.createDataFrame([(50.0, 0.0, c, 0.0)], "a double, b double, c string, noise double")).first()["risk"] for c in ("p", "q", "r", "never seen")}
    assert by["p"] > by["q"] > by["r"] and 0 < by["never seen"] < 1
    # Classes weigh the same, so the mean risk is not the rare class's share.
    assert 0.35 < sum(r["risk"] for r in held) / len(held) < 0.65
    again = sgd.fit_logistic(df, "y", ["a", "b", "noise"], ["c"])
    assert again.weights == pytest.approx(model.weights, rel=1e-6, abs=1e-9)


def test_missing_numbers_one_class_and_no_features(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), (None, None)], "a double, y int")
    model = sgd.fit_logistic(df, "y", ["a"], [])
    assert [r["risk"] for r in model.risk(df).collect()] == pytest.approx([0.5] * 3, abs=0.05)
    with pytest.raises(ValueError, match="both classes"):
        sgd.fit_logistic(df.where("y = 1"), "y", ["a"], [])
    assert model.risk(df.limit(0)).count() == 0
    assert sgd.fit_logistic(df, "y", [], []).risk(df).count() == 3


def test_the_penalty_shrinks(spark):
    df = data(spark, 2000)
    free, bound = (sgd.fit_logistic(df, "y", ["a"], ["c"], epochs=5, alpha=x) for x in (1e-5, 0.5))
    assert abs(bound.weights[0]) < abs(free.weights[0]) / 2
