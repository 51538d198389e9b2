"""Named queries of the learned models: selection and audit of features, folds, targets, reference
temperature and residual risk. The models have no SQL; tests/test_learning.py holds them to data whose
answer is known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting
from ..operators import columns as cl
from ..operators import encoding as enc
from ..operators import features as ft
from ..operators import holdouts as ho
from ..operators import learning as le
from ..operators import reports, sgd
from ..sources import context, observations, scored, stations
from .stand_ins import CONTEXT, SCORED

#: Rounds and depth of the queries' models; the operators' own are 1,200 and 8, which is hours.
QUICK = {"rounds": 20, "rate": 0.2, "depth": 5}
#: The refits' seeds. Boosted models and refits take the operator's own rounds, rate, patience and depth.
SEEDS = ["11", "22", "33", "44", "55"]
BAND = f"CASE WHEN abs(resid) >= 3 THEN '{le.HIGH_BAND}' WHEN abs(resid) <= 1 THEN '{le.LOW_BAND}' WHEN resid IS NOT NULL THEN 'ambiguous' END"
HISTORY = """h AS (SELECT station_id, round(avg(resid), 6) AS station_ref_bias_train, count(resid) AS station_ref_n_train FROM context WHERE split = 'train' GROUP BY 1)"""


def risk_rows(spark, d, history=True):
    """The stand-ins under the names that the rules on columns know; without ``history``, no figures of the
    stations' past, which some models may not see."""
    c = context(spark, d)
    past = c.where("split = 'train'").groupBy("station_id").agg(F.round(F.avg("resid"), 6).alias("station_ref_bias_train"), F.count("resid").alias("station_ref_n_train"))
    names = {"resid": "cws_ref_resid", "lenient": "qc_flag_lenient", "strict": "qc_flag_strict", "y": "target_ref_risk", "p": "pred_ref_risk_prob", "day": "date", "row_key": "row_id", "line": "line_id"}
    out = (c.join(past, "station_id", "left") if history else c).withColumnsRenamed(names)
    r = F.col("cws_ref_resid")
    band = F.when(F.abs(r) >= 3, le.HIGH_BAND).when(F.abs(r) <= 1, le.LOW_BAND).when(r.isNotNull(), "ambiguous")
    return out.withColumns({"temp_raw": 20 + r, "ref_mu": F.lit(20.0), "season_lg": F.when(F.col("month") % 5 != 0, F.concat(F.lit("s"), (F.col("month") % 4).cast("string"))), "target_ref_risk_band_z": band})


def _with_fill(names, rows):
    """Names of features with the rows that have a value of them, counted in one pass over all."""
    filled = reports.missingness(rows).select(F.col("column").alias("feature"), (F.col("n_rows") - F.col("n_null") - F.col("n_blank") - F.col("n_unusable")).alias("n_filled"))
    return names.join(F.broadcast(filled), "feature")  # a row a column


def _chosen(spark, d):
    rows, out = risk_rows(spark, d), []
    for mode in cl.MODES:
        features, categories = cl.risk_features(rows, mode)
        out += [(mode, f, f in categories) for f in features]
    return _with_fill(spark.createDataFrame(out, "feature_mode string, feature string, is_category boolean"), rows)


def _audits(spark, d):
    rows = risk_rows(spark, d)
    out = [cl.leakage_audit(spark, rows.columns, m) for m in (*cl.MODES, *cl.ALIASES)]
    return _with_fill(reduce(DataFrame.unionByName, out), rows)


def _risk(spark, d, mode):
    rows, target = le.training_target(risk_rows(spark, d, history=mode != cl.STATIC_MODE), "hard")
    return rows, le.fit_risk(rows, target, *cl.checked_features(rows, mode), **QUICK)


def _risk_scores(mode):
    def query(spark, d):
        rows, model = _risk(spark, d, mode)
        return model.risk(rows).select("row_id", "line_id", "station_id", "split", F.col("target_ref_risk").cast("int").alias("y"), F.round("pred_ref_risk_prob", 6).alias("risk"))

    return query


def _reference(spark, d):
    rows = ft.calendar(observations(spark, d).where("network = 'ows'")).join(F.broadcast(stations(spark, d)), "station_id", "left").withColumnRenamed("temp", "temp_raw")
    out, _ = le.held_out_reference(rows, "temp_raw", *cl.regression_features(rows), **QUICK)
    return out.select("date", "station_id", "fold", "temp_raw", F.round("ref_mu_learned", 6).alias("ref_mu_learned"), F.round("ref_resid_learned", 6).alias("ref_resid_learned"))


def _sgd(spark, d):
    rows = context(spark, d)
    model = sgd.fit_logistic(rows.where("split = 'train'"), "y", ["solar", "wind", "km", "n_refs", "spread", "elev_gap"], ["lcz_differs", "month", "station_id"])
    return model.risk(rows).select("station_id", "row_key", "line", "split", "y", F.round("risk", 6).alias("risk"))


def _boosted(spark, d, **growth):
    """Learned on the bands that are sure, from what a risk model without history sees."""
    rows, target = le.training_target(risk_rows(spark, d, history=False), "high_confidence_bands")
    features, categories = cl.checked_features(rows, cl.STATIC_MODE)
    model = boosting.fit_boosted(rows, target, [f for f in features if f not in categories], categories, ["row_id", "line_id"], **growth)
    return model.risk(rows).select("row_id", "line_id", "station_id", "split", F.col(target).alias("y"), F.round("risk", 6).alias("risk"))


def _holdouts(spark, d):
    rows, target = le.training_target(risk_rows(spark, d, history=False), "high_confidence_bands")
    features, categories = cl.checked_features(rows, cl.STATIC_MODE)
    return target, ho.station_holdouts(rows.drop("split"), target, [f for f in features if f not in categories], categories, ["row_id", "line_id"], SEEDS)


def _holdout_metrics(spark, d):
    target, runs = _holdouts(spark, d)
    out = ho.run_metrics(runs.scores, target)
    return out.join(F.broadcast(runs.runs.select("seed", "status", "trees", "rounds")), "seed")  # a row a seed


_NUMBERS = "elev_diff elev_gap building_gap cover_differs is_day km lcz_differs lst_diff month n_refs ndvi_diff solar spread wind".split()
_TABLE = ", ".join(f"('{m}', '{f}', {str(f == 'season_lg').upper()})" for m in cl.MODES for f in (*_NUMBERS, "season_lg", *(() if m == cl.STATIC_MODE else ("station_ref_bias_train", "station_ref_n_train")), *(("temp_raw", "ref_mu") if m in (cl.OPERATIONAL_MODE, cl.DIAGNOSTIC_MODE) else ())))
_COLUMNS = "station_id row_key line p resid y lenient strict split day".split()
_NAMED = "station_id row_id line_id pred_ref_risk_prob cws_ref_resid target_ref_risk qc_flag_lenient qc_flag_strict split date".split()
_DERIVED = {"temp_raw": "20 + resid", "ref_mu": "20", "season_lg": "CASE WHEN month % 5 <> 0 THEN month END", "target_ref_risk_band_z": BAND}
_FILLED = f"""WITH {CONTEXT}, {HISTORY}, rows AS (SELECT c.*, h.station_ref_bias_train, h.station_ref_n_train FROM context c LEFT JOIN h ON h.station_id = c.station_id),
filled AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, count({c}) AS n_filled FROM rows" for n, c in [*zip(_NAMED, _COLUMNS, strict=True), *((x, x) for x in (*_NUMBERS, "station_ref_bias_train", "station_ref_n_train")), *_DERIVED.items()])})"""
_DIRECT = f"feature_mode IN ('{cl.OPERATIONAL_MODE}', '{cl.DIAGNOSTIC_MODE}')"
_CURRENT = "feature IN ('temp_raw', 'ref_mu')"
_TOLD = "feature IN ('target_ref_risk', 'pred_ref_risk_prob', 'target_ref_risk_band_z')"
_PAST = "feature IN ('station_ref_bias_train', 'station_ref_n_train')"

_SUITE: dict = {
    "feature_modes": (_chosen, f"{_FILLED} SELECT t.*, n_filled FROM (VALUES {_TABLE}) t(feature_mode, feature, is_category) JOIN filled USING (feature)"),
    "leakage_audit": (
        _audits,
        f"""{_FILLED}, m AS (SELECT unnest(['{"', '".join((*cl.MODES, *cl.ALIASES))}']) AS feature_mode)
SELECT feature_mode, feature, n_filled, CASE WHEN {_TOLD} THEN 'target_or_risk_column' WHEN feature = 'cws_ref_resid' THEN 'direct_residual_column' WHEN {_CURRENT} THEN 'current_temp_or_reference_temperature'
  WHEN {_PAST} THEN 'train_only_station_residual_history' ELSE 'ok' END AS audit_category,
CASE WHEN {_TOLD} OR feature = 'cws_ref_resid' THEN 'fatal' WHEN {_CURRENT} AND {_DIRECT} THEN 'diagnostic' WHEN {_CURRENT} THEN 'fatal' WHEN {_PAST} AND feature_mode = '{cl.STATIC_MODE}' THEN 'fatal' WHEN {_PAST} THEN 'warning' ELSE 'ok' END AS severity FROM m, filled""",
    ),
    "group_folds": (
        lambda spark, d: le.group_folds(scored(spark, d), "station_id"),
        f"""WITH RECURSIVE {SCORED}, s AS (SELECT station_id, count(*) AS n_rows, row_number() OVER (ORDER BY count(*) DESC, station_id) AS i FROM scored WHERE station_id IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS station_id, CAST(0 AS BIGINT) AS n_rows, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS held, CAST(0 AS INTEGER) AS fold UNION ALL
  SELECT s.i, s.station_id, s.n_rows, list_transform([1, 2, 3, 4, 5], lambda j: held[j] + CASE WHEN j = list_position(held, list_min(held)) THEN s.n_rows ELSE 0 END), CAST(list_position(held, list_min(held)) AS INTEGER) FROM g JOIN s ON s.i = g.i + 1)
SELECT station_id, n_rows, fold FROM g WHERE i > 0""",
    ),
    "station_folds": (
        lambda spark, d: le.group_folds(scored(spark, d), "station_id", None),
        f"WITH {SCORED} SELECT station_id, count(*) AS n_rows, row_number() OVER (ORDER BY station_id) AS fold FROM scored WHERE station_id IS NOT NULL GROUP BY 1",
    ),
    "confident_target": (
        lambda spark, d: le.training_target(risk_rows(spark, d))[0].groupBy("split", F.col("target_ref_risk_hiconf").alias("target")).agg(F.count("*").alias("n"), F.sum("is_model_labeled").alias("n_labeled")),
        f"WITH {CONTEXT}, t AS (SELECT split, {BAND} AS band FROM context) SELECT split, CASE band WHEN '{le.HIGH_BAND}' THEN 1 WHEN '{le.LOW_BAND}' THEN 0 END AS target, count(*) AS n, count(*) FILTER (band <> 'ambiguous') AS n_labeled FROM t GROUP BY 1, 2",
    ),
    "rare_categories": (
        lambda spark, d: le.with_rare(scored(spark, d), "station_id", 600).groupBy(F.col("station_id").alias("category")).agg(F.count("*").alias("n")),
        f"WITH {SCORED}, k AS (SELECT coalesce(CAST(station_id AS VARCHAR), 'Missing') AS s, count(*) AS n FROM scored GROUP BY 1) SELECT CASE WHEN n >= 600 THEN s ELSE 'infrequent' END AS category, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1",
    ),
    "station_history": (
        lambda spark, d: risk_rows(spark, d).groupBy("station_id").agg(F.max("station_ref_bias_train").alias("bias"), F.max("station_ref_n_train").alias("n_train"), F.count("*").alias("n")),
        f"WITH {CONTEXT}, {HISTORY} SELECT c.station_id, max(station_ref_bias_train) AS bias, max(station_ref_n_train) AS n_train, count(*) AS n FROM context c LEFT JOIN h ON h.station_id = c.station_id GROUP BY 1",
    ),
    "ordered_target": (
        lambda spark, d: enc.ordered_target(scored(spark, d), "station_id", "y", ["row_key", "line"], "code").groupBy("station_id", "split").agg(F.count("*").alias("n"), F.round(F.avg("code"), 8).alias("code"), F.round(F.avg(F.col("code") * F.col("y")), 8).alias("code_y")),
        f"""WITH {SCORED}, o AS (SELECT *, CAST('0x' || substr(md5('0|' || row_key || '|' || line), 1, 13) AS BIGINT) AS place FROM scored), w AS (SELECT *, (coalesce(sum(y) OVER b, 0) + 0.5) / (count(y) OVER b + 1) AS code FROM o WINDOW b AS (PARTITION BY station_id ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT station_id, split, count(*) AS n, round(avg(code), 8) AS code, round(avg(code * y), 8) AS code_y FROM w GROUP BY 1, 2""",
    ),
    "category_means": (
        lambda spark, d: enc.category_means(scored(spark, d).where("split = 'train'"), "station_id", "y", "code").withColumn("code", F.round("code", 8)),
        f"WITH {SCORED} SELECT CAST(station_id AS VARCHAR) AS station_id, round((sum(y) + 0.5) / (count(y) + 1), 8) AS code FROM scored WHERE split = 'train' GROUP BY 1",
    ),
    "importance_stability": (
        lambda spark, d: _rounded(le.importance_stability(_runs(spark, d), ["split"], top=3)),
        f"""WITH {SCORED}, r AS (SELECT split, 'line_' || line AS feature, row_key % 5 AS seed, avg(p) AS importance FROM scored GROUP BY ALL), g AS (SELECT split, feature, count(DISTINCT seed) AS n_runs, avg(importance) AS mean, stddev_samp(importance) AS std, min(importance) AS least, max(importance) AS most FROM r GROUP BY 1, 2),
k AS (SELECT *, dense_rank() OVER (PARTITION BY split ORDER BY round(mean, 12) DESC) AS place FROM g) SELECT split, feature, n_runs, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS least, round(most, 6) AS most, place FROM k WHERE place <= 3""",
    ),
    "reference_regression": (_reference, None),
    "risk_context_history": (_risk_scores(cl.HISTORY_MODE), None),
    "risk_sgd": (_sgd, None),
    "holdout_refits": (_holdout_metrics, None),
    "holdout_importance": (lambda spark, d: _rounded(le.importance_stability(_holdouts(spark, d)[1].importance, [])), None),
    "risk_boosted": (lambda spark, d: _boosted(spark, d), None),
    "risk_leafwise": (lambda spark, d: _boosted(spark, d, depth=None, leaves=boosting.LEAVES, penalty=0.0, share=boosting.SHARE, least=boosting.LEAST), None),
    "risk_importance": (lambda spark, d: _risk(spark, d, cl.STATIC_MODE)[1].importance(spark), None),
}


def _runs(spark, d):
    return scored(spark, d).groupBy("split", F.concat(F.lit("line_"), F.col("line").cast("string")).alias("feature"), (F.col("row_key") % 5).alias("seed")).agg(F.avg("p").alias("importance"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", "least", "most")})


QUERIES = {k: q for k, (q, _) in _SUITE.items()}
ORACLES = {k: s for k, (_, s) in _SUITE.items() if s}
