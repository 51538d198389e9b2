"""Queries of support, calibration and fusion inputs, each with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import support as su
from ..sources import context
from .stand_ins import CONTEXT

ID = ["station_id", "row_key", "line"]


def _rows(fn, *cols):
    """Of a row operator: per station and split, counts and means of its columns, and of the square."""

    def run(spark, d):
        df = fn(context(spark, d))
        return df.groupBy("station_id", "split").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 8).alias(c) for c in cols), *(F.round(F.avg(F.col(c) * F.col(c)), 8).alias(f"{c}_sq") for c in cols))

    return run


def _rows_sql(table: str, *cols: str) -> str:
    means = ", ".join(f"round(avg({c}), 8) AS {c}, round(avg({c} * {c}), 8) AS {c}_sq" for c in cols)
    return f"SELECT station_id, split, count(*) AS n, {means} FROM {table} GROUP BY 1, 2"


_UNIT = "least(greatest({}, 0), 1)"
_SUPPORT = f"""{CONTEXT}, parts AS (SELECT *, (6 - least(greatest(n_refs, 0), 6)) / 6.0::DOUBLE AS s_density, least(greatest(km / 5, 0), 1) AS s_km, CASE WHEN spread IS NOT NULL THEN least(greatest(spread / 4, 0), 1) END AS s_spread,
  least(greatest(lcz_differs, 0), 1) AS s_lcz, least(greatest(cover_differs, 0), 1) AS s_cover, least(abs(elev_gap) / 150, 1) AS s_elev, least(abs(building_gap) / 20, 1) AS s_building FROM context),
supported AS (SELECT *, (s_density + s_km + coalesce(s_spread, 0) + s_lcz + s_cover + s_elev + s_building) / (CASE WHEN s_spread IS NULL THEN 6 ELSE 7 END) AS support FROM parts)"""
_CUTS = "cuts AS (SELECT quantile_cont(solar, 0.75) AS sun_cut, quantile_cont(wind, 0.25) AS calm_cut FROM context WHERE split = 'train'{})"
_BIAS = f"""{CONTEXT}, {_CUTS.format(" AND resid IS NOT NULL")}, st AS (SELECT station_id, count(*) AS n_train, max(sun_cut) AS high_sun, quantile_cont(resid, 0.5) AS bias_all, quantile_cont(resid, 0.5) FILTER (is_day = 1) AS bias_day,
  quantile_cont(resid, 0.5) FILTER (is_day = 0) AS bias_night, quantile_cont(resid, 0.5) FILTER (coalesce(solar >= sun_cut, false)) AS bias_sun, quantile_cont(resid, 0.5) FILTER (NOT coalesce(solar >= sun_cut, false)) AS bias_shade
  FROM context, cuts WHERE split = 'train' AND resid IS NOT NULL GROUP BY 1),
b AS (SELECT c.*, CASE WHEN n_train >= 24 THEN coalesce(CASE WHEN coalesce(solar >= high_sun, false) THEN bias_sun ELSE bias_shade END, CASE WHEN is_day = 1 THEN bias_day ELSE bias_night END, bias_all) END AS bias FROM context c LEFT JOIN st USING (station_id)),
biased AS (SELECT *, CASE WHEN sign(resid) = sign(bias) AND abs(bias) >= 0.5 THEN least(greatest(1 - abs(resid - bias) / nullif(abs(resid), 0), 0), 1) ELSE 0 END AS explained FROM b)"""
_MICRO = f"""{CONTEXT}, w AS (SELECT *, CASE WHEN resid * lst_diff > 0 THEN least(abs(lst_diff) / 8, 1) ELSE 0 END AS a, CASE WHEN resid * elev_diff < 0 THEN least(abs(elev_diff) / 150, 1) ELSE 0 END AS b,
  (CASE WHEN resid * ndvi_diff < 0 THEN least(abs(ndvi_diff) / 0.35, 1) ELSE 0 END) * (0.5 + 0.5 * is_day) AS c FROM context),
m AS (SELECT *, least(0.55 * greatest(lcz_differs, cover_differs) + 0.45 * (lcz_differs + cover_differs) / 2, 1) AS mismatch, least(0.65 * greatest(a, b, c) + 0.35 * (a + b + c) / 3, 1) AS env_dir FROM w),
micro AS (SELECT *, CASE WHEN env_dir > 0 THEN least(1 - (1 - env_dir) * (1 - 0.45 * mismatch), 1) ELSE 0.75 * mismatch END AS env FROM m)"""
_MED = "quantile_cont({}, 0.5)"


def _profile_sql() -> str:
    r = "resid"
    mid = lambda ok: f"quantile_cont(resid, 0.5) FILTER ({ok})"
    share = lambda ok: f"avg(CAST({ok} AS INTEGER))"
    slope = lambda x: f"CASE WHEN regr_count({r}, {x}) >= 20 AND regr_sxx({r}, {x}) > 0 THEN regr_slope({r}, {x}) END"
    sun, calm = "coalesce(solar >= sun_cut, false)", "coalesce(wind <= calm_cut, false)"
    out = {
        "mean": f"avg({r})", "median": f"quantile_cont({r}, 0.5)", "std": f"stddev_samp({r})", "mae": f"avg(abs({r}))", "median_abs": f"quantile_cont(abs({r}), 0.5)", "rmse": f"sqrt(avg({r} * {r}))",
        "q25": f"quantile_cont({r}, 0.25)", "q75": f"quantile_cont({r}, 0.75)", "p95_abs": f"quantile_cont(abs({r}), 0.95)", "p99_abs": f"quantile_cont(abs({r}), 0.99)",
        "over_1": share(f"abs({r}) > 1"), "over_2": share(f"abs({r}) > 2"), "over_3": share(f"abs({r}) > 3"), "positive": share(f"{r} > 0"),
        "day": mid("is_day = 1"), "night": mid("is_day = 0"), "sun": mid(sun), "shade": mid(f"NOT {sun}"), "calm": mid(calm), "windy": mid(f"NOT {calm}"), "sun_calm": mid(f"{sun} AND {calm}"),
        "summer": mid("month IN (6, 7, 8)"), "winter": mid("month IN (12, 1, 2)"), "share_day": share("is_day = 1"), "share_sun": share(sun),
        "slope_solar": slope("solar"), "slope_wind": slope("wind"), "slope_elev": slope("elev_diff"), "corr_solar": f"corr({r}, solar)",
    }
    names = [*out, "iqr", "day_night", "sun_shade", "consistency"]
    rounded = ", ".join(f"CASE WHEN n >= 24 THEN round({c}, 7) END AS {c}" for c in names)
    return f"""WITH {CONTEXT}, {_CUTS.format(" AND resid IS NOT NULL")}, t AS (SELECT * FROM context, cuts WHERE split = 'train' AND resid IS NOT NULL),
g AS (SELECT station_id, count(*) AS n, {", ".join(f"{c} AS {k}" for k, c in out.items())} FROM t GROUP BY 1),
h AS (SELECT *, q75 - q25 AS iqr, day - night AS day_night, sun - shade AS sun_shade, abs(median) / nullif(median_abs, 0) AS consistency FROM g), {_MONTHS.format("t")}
SELECT h.station_id, n, {rounded}, months, month_median, month_iqr, month_agree FROM h LEFT JOIN s ON s.station_id = h.station_id"""


_MONTHS = """m AS (SELECT station_id, month, quantile_cont(resid, 0.5) AS v FROM {} WHERE resid IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
s0 AS (SELECT station_id, count(*) AS months, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS w, count(*) FILTER (v > 0) AS up, count(*) FILTER (v < 0) AS down FROM m GROUP BY 1),
s AS (SELECT station_id, months, round(mid, 5) AS month_median, round(w, 5) AS month_iqr, round(CASE WHEN mid > 0 THEN up WHEN mid < 0 THEN down ELSE 0 END / months::DOUBLE, 5) AS month_agree FROM s0)"""


def _bins(spark, d):
    df = context(spark, d)
    each = [df.select(F.lit(c).alias("what"), su.cut_bins(F.col(c).cast("double"), e).alias("bin")) for c, e in su.BIN_EDGES.items()]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.groupBy("what", "bin").agg(F.count("*").alias("n"))


def _bins_sql() -> str:
    case = lambda c, edges: f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {c} <= {e} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"
    return f"WITH {CONTEXT} " + " UNION ALL ".join(f"SELECT '{c}' AS what, CAST({case(c, e)} AS INTEGER) AS bin, count(*) AS n FROM context GROUP BY 2" for c, e in su.BIN_EDGES.items())


def _evidence(df):
    return su.qc_evidence(df.withColumn("ultra_strict", F.when(F.col("n_refs") > 0, (F.col("n_refs") > 6).cast("int"))))


_EVIDENCE = f"""{CONTEXT}, e AS (SELECT *, CASE WHEN n_refs > 0 THEN CAST(n_refs > 6 AS INTEGER) END AS ultra FROM context),
evident AS (SELECT *, (coalesce(lenient, 0) * 0.95 + strict * 0.70 + coalesce(ultra, 0) * 0.25) / 1.9 AS p_qc, coalesce(ultra, 0) + coalesce(lenient, 0) + strict AS n_flags, coalesce(lenient, 0) + strict > 0 AS qc_strong FROM e)"""

_SUITE: dict = {
    "support_components": (
        _rows(su.support, "s_density", "s_km", "s_spread", "s_lcz", "s_cover", "s_elev", "s_building", "support"),
        f"WITH {_SUPPORT} " + _rows_sql("supported", "s_density", "s_km", "s_spread", "s_lcz", "s_cover", "s_elev", "s_building", "support"),
    ),
    "support_classes": (
        lambda spark, d: su.reference_class(su.support(context(spark, d).withColumn("km", F.when(F.col("row_key") % 13 != 0, F.col("km"))))).groupBy("support_class", "reference_class").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("resid")), 6).alias("mae")),
        f"""WITH {_SUPPORT}, k AS (SELECT *, CASE WHEN row_key % 13 != 0 THEN s_km END AS k1, CASE WHEN row_key % 13 != 0 THEN km END AS k2 FROM supported),
v AS (SELECT *, (s_density + coalesce(k1, 0) + coalesce(s_spread, 0) + s_lcz + s_cover + s_elev + s_building) / (5 + CAST(k1 IS NOT NULL AS INTEGER) + CAST(s_spread IS NOT NULL AS INTEGER)) AS score FROM k)
SELECT CASE WHEN score <= 0.25 THEN 'easy' WHEN score <= 0.5 THEN 'moderate' WHEN score <= 0.75 THEN 'hard' ELSE 'very_hard' END AS support_class,
  CASE WHEN coalesce(k2 > 10, false) OR n_refs <= 0 THEN 'outside' WHEN coalesce(k2 > 5, false) OR n_refs <= 1 OR coalesce(spread > 4, false) THEN 'low' WHEN coalesce(k2 <= 2, false) AND n_refs >= 4 AND coalesce(spread <= 2, true) THEN 'high' ELSE 'moderate' END AS reference_class, count(*) AS n, round(avg(abs(resid)), 6) AS mae FROM v GROUP BY 1, 2""",
    ),
    "context_bins": (_bins, _bins_sql()),
    "qc_evidence": (
        lambda spark, d: _evidence(context(spark, d)).groupBy("n_flags", "qc_any", "qc_strong").agg(F.count("*").alias("n"), F.round(F.avg("p_qc"), 6).alias("p_qc")),
        f"WITH {_EVIDENCE} SELECT n_flags, n_flags > 0 AS qc_any, qc_strong, count(*) AS n, round(avg(p_qc), 6) AS p_qc FROM evident GROUP BY 1, 2, 3",
    ),
    "bin_calibration": (
        lambda spark, d: su.bin_calibration(context(spark, d).withColumn("y", F.when(F.col("p") < 0.9, F.col("y")))).groupBy("split", "bin").agg(F.count("*").alias("n"), F.round(F.avg("p_calibrated"), 6).alias("p_calibrated")),
        f"""WITH {CONTEXT}, b AS (SELECT *, CAST(least(floor(p * 15), 14) AS INTEGER) AS bin FROM context), r AS (SELECT bin, avg(y) AS rate FROM b WHERE split = 'valid' AND p < 0.9 GROUP BY 1)
SELECT split, b.bin, count(*) AS n, round(avg(coalesce(rate, p)), 6) AS p_calibrated FROM b LEFT JOIN r ON r.bin = b.bin GROUP BY 1, 2""",
    ),
    "expected_bias": (lambda spark, d: _rows(lambda c: su.expected_bias(c, su.conditional_bias(c)), "bias", "explained")(spark, d), f"WITH {_BIAS} " + _rows_sql("biased", "bias", "explained")),
    "radiation_score": (
        _rows(lambda c: su.radiation_score(c, su.conditional_bias(c)), "trained", "rad"),
        f"""WITH {_BIAS}, c2 AS (SELECT quantile_cont(solar, 0.75) AS sun_cut, quantile_cont(wind, 0.25) AS calm_cut FROM context WHERE split = 'train'),
f AS (SELECT c.*, coalesce(CAST(solar >= sun_cut AS INTEGER), 0) AS sun, coalesce(1 / (1 + exp(-(calm_cut - wind) / greatest(0.35, abs(calm_cut) * 0.35))), 0.5) AS calm,
  CASE WHEN n_train >= 24 THEN bias_sun END AS hi, CASE WHEN n_train >= 24 THEN coalesce(bias_sun - bias_shade, bias_sun - bias_all) END AS ex FROM context c LEFT JOIN st USING (station_id), c2),
tr AS (SELECT *, coalesce(greatest(1 / (1 + exp(-(ex - 0.5) * 2)), 1 / (1 + exp(-(hi - 0.5) * 2))), 0.25) AS trained FROM f),
rated AS (SELECT *, coalesce(least(greatest((0.45 * sun + 0.25 * is_day + 0.30 * calm) * (CASE WHEN resid > 0 THEN 1 / (1 + exp(-1.25 * (resid - 0.75))) ELSE 0 END) * (0.45 + 0.55 * trained), 0), 1), 0) AS rad FROM tr) """
        + _rows_sql("rated", "trained", "rad"),
    ),
    "reference_uncertainty": (
        _rows(lambda c: su.reference_uncertainty(su.support(c)), "unc"),
        f"WITH {_SUPPORT}, q AS (SELECT quantile_cont(support, 0.95) AS top FROM supported WHERE split = 'train'), u AS (SELECT s.*, least(greatest(support / top, 0), 1) AS unc FROM supported s, q) " + _rows_sql("u", "unc"),
    ),
    "reference_uncertainty_rough": (
        _rows(su.reference_uncertainty, "unc"),
        f"""WITH {CONTEXT}, u AS (SELECT *, (least(km / 8, 1) + (CASE WHEN spread IS NULL THEN 0 ELSE least(spread / 3, 1) END) + 1 - least(n_refs / 8.0::DOUBLE, 1)) / (CASE WHEN spread IS NULL THEN 2 ELSE 3 END) AS unc FROM context) """
        + _rows_sql("u", "unc"),
    ),
    "microclimate": (_rows(su.microclimate, "mismatch", "env_dir", "env"), f"WITH {_MICRO} " + _rows_sql("micro", "mismatch", "env_dir", "env")),
    "station_profile": (lambda spark, d: su.station_profile(context(spark, d)), _profile_sql()),
    "month_stability": (lambda spark, d: su.month_stability(context(spark, d)), f"WITH {CONTEXT}, {_MONTHS.format('context')} SELECT * FROM s"),
}
QUERIES = {k: q for k, (q, _) in _SUITE.items()}
ORACLES = {k: s for k, (_, s) in _SUITE.items() if s}
