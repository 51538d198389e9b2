"""Matched thresholds and their bounds on hand-made rows."""

import numpy as np
import pytest

from skyledger.operators import frontier as fr

# block, flag, score, residual, corrected
VALID = [("a", 0, 1.0, 0.0, None), ("a", None, 2.0, 0.0, None), ("a", 1, 4.0, 0.0, None), ("b", 0, None, 0.0, None)]
TEST = [("a", 0, 1.0, 2.0, 0.5), ("a", 1, 2.5, -4.0, None), ("b", None, 9.0, 1.0, 1.0), ("c", 1, None, 6.0, 0.0), ("c", 0, 2.5, None, 3.5)]
SCHEMA = "block string, flag int, score double, resid double, better double"


def specs(spark, scores=None):
    return fr.matched_specs(spark.createDataFrame(VALID, SCHEMA), {"strict": "flag"}, scores or {"risk": "score"}, {"raw": "resid", "corrected": "better"})


def test_thresholds_keep_what_the_flag_keeps_of_the_valid_rows(spark):
    got = {r["method"]: r for r in specs(spark).collect()}
    assert set(got) == {"flag_strict__raw", "flag_strict__corrected", "risk_matched_to_strict__raw", "risk_matched_to_strict__corrected"}
    # The flag keeps 3 of 4, the missing one among them; three quarters of 1, 2, 4 lie halfway from 2 to 4.
    assert {r["target"] for r in got.values()} == {0.75}
    assert got["risk_matched_to_strict__raw"]["threshold"] == 3.0 and got["flag_strict__raw"]["threshold"] is None


def test_figures_on_the_test_rows(spark):
    rows = spark.createDataFrame(TEST, SCHEMA)
    got = {r["method"]: r for r in fr.frontier(rows, specs(spark), ["flag", "score"], ["resid", "better"]).collect()}
    flag, risk = got["flag_strict__raw"], got["risk_matched_to_strict__raw"]
    # A row without residual counts in the total and is not used; a missing score keeps nothing.
    assert (flag["n_total"], flag["n_used"], flag["bias"], flag["mae"]) == (5, 2, 1.5, 1.5)
    assert (risk["n_used"], risk["bias"], risk["mae"], risk["over_3"]) == (2, -1.0, 3.0, 0.5)
    assert risk["rmse"] == pytest.approx(10**0.5) and risk["score_there"] == 0.8 and flag["score_there"] == 0.8
    assert got["flag_strict__corrected"]["n_used"] == 3 and got["risk_matched_to_strict__corrected"]["n_used"] == 2
    none = fr.frontier(rows.limit(0), specs(spark), ["flag", "score"], ["resid", "better"]).collect()
    assert [(r["n_total"], r["n_used"], r["mae"]) for r in none] == [(0, 0, None)] * 4


def test_a_score_without_values_has_no_spec(spark):
    rows = spark.createDataFrame(VALID, SCHEMA).selectExpr("*", "CAST(NULL AS DOUBLE) AS nothing")
    got = fr.matched_specs(rows, {"strict": "flag"}, {"risk": "nothing"}, {"raw": "resid"}).collect()
    assert [r["method"] for r in got] == ["flag_strict__raw"]


def test_bounds_are_those_of_the_draws(spark):
    from skyledger.operators.robust import drawn

    rows = spark.createDataFrame(TEST, SCHEMA)
    got = {r["method"]: r for r in fr.bootstrap_frontier(rows, specs(spark), ["flag", "score"], ["resid", "better"], draws=40).collect()}
    picks = {}
    for r in drawn(rows.select("block").distinct(), 40).collect():
        picks.setdefault(r["b"], []).extend([r["block"]] * r["w"])
    retention, mae = [], []
    for blocks in picks.values():
        of = [t for b in blocks for t in TEST if t[0] == b]
        kept = [t[3] for t in of if not t[1] and t[3] is not None]
        if kept:
            retention.append(len(kept) / len(of))
            mae.append(np.mean(np.abs(kept)))
    row = got["flag_strict__raw"]
    assert (row["n_blocks"], row["n_total"], row["n_used"], row["draws"], row["retention"]) == (3, 5, 2, len(mae), 0.4)
    assert [row[f"retention_{k}"] for k in ("low", "mid", "high")] == pytest.approx(np.quantile(retention, [0.025, 0.5, 0.975]).tolist())
    assert [row[f"mae_{k}"] for k in ("low", "mid", "high")] == pytest.approx(np.quantile(mae, [0.025, 0.5, 0.975]).tolist())
