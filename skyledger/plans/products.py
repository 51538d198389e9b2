"""More named queries: time axis, robust scales, calibration, fusion, guardrail and risk models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import qn_scale
from ..operators import calibration as cal
from ..operators import evaluation as ev
from ..operators import fusion as fu
from ..operators import models
from ..operators import qc
from ..operators import timeline as tl
from ..sources import observations, scored, stations, table
from .stand_ins import DAY, OBS, RAW, SCORED, S

EVIDENCE = """evidence AS (SELECT l_suppkey AS station_id, l_orderkey AS row_key, l_linenumber AS line, l_suppkey % 12 AS km, CAST(l_suppkey % 5 - 2 AS DOUBLE) AS bias,
  (l_extendedprice / l_quantity - 1500) / 100 AS resid, CASE WHEN l_linenumber = 7 THEN NULL ELSE 20 + (l_extendedprice / l_quantity - 1500) / 100 END AS temp,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE least(round(l_discount * 8 + l_tax * 2, 4), 1) END AS p_model, 1 - exp(-abs((l_extendedprice / l_quantity - 1500) / 100) / 10) AS p_resid,
  CAST((CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE CAST(l_returnflag = 'A' AS INTEGER) END) + CAST(l_linenumber > 4 AS INTEGER) AS DOUBLE) / 2 AS p_qc,
  CAST(l_orderkey % 7 AS DOUBLE) / 10 AS explained, CAST(l_orderkey % 5 AS DOUBLE) / 8 AS micro, CAST(l_orderkey % 4 AS DOUBLE) / 5 AS env, CAST(l_orderkey % 6 AS DOUBLE) / 10 AS env_dir,
  CAST(l_orderkey % 9 AS DOUBLE) / 10 AS rad, CAST(l_orderkey % 11 AS DOUBLE) / 12 AS unc, abs((l_extendedprice / l_quantity - 1500) / 100) / 2 AS abs_z,
  (CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE CAST(l_returnflag = 'A' AS INTEGER) END) + CAST(l_linenumber > 4 AS INTEGER) > 0 AS qc_any, l_linenumber > 4 AS qc_strong FROM lineitem)"""
FUSED = f"""{EVIDENCE}, s1 AS (SELECT *, coalesce(p_model, 0) AS m FROM evidence), s2 AS (SELECT *, 1 - (1 - m) * (1 - p_resid) AS issue, 1 - (1 - m) * (1 - p_qc) * (1 - p_resid) AS p_any,
  1 - (1 - m * (1 - 0.65 * explained)) * (1 - p_qc) * (1 - p_resid * (1 - explained)) AS p_unexplained, 1 - (1 - explained) * (1 - micro) * (1 - unc) * (1 - rad) AS p_preserve FROM s1),
s3 AS (SELECT *, least(greatest(p_qc * 0.25 + 0.75 * p_unexplained * (1 - 0.45 * unc) * (1 - 0.35 * micro) * (1 - 0.25 * rad), 0), 1) AS p_reject FROM s2),
s4 AS (SELECT *, p_reject >= 0.7 AND explained < 0.35 AND rad < 0.4 AND env < 0.55 AND unc < 0.8 AS err, issue <= 0.15 AND abs_z <= 2.05 AS small FROM s3),
fused AS (SELECT *, CASE WHEN p_model IS NULL OR temp IS NULL THEN '{fu.MISSING}' WHEN small AND qc_any THEN '{fu.RESCUE}' WHEN small THEN '{fu.CONSISTENT}'
  WHEN p_any >= 0.5 AND unc >= 0.8 AND NOT qc_strong THEN '{fu.LIMITED}' WHEN p_any >= 0.3 AND rad >= 0.6 AND p_qc < 0.6 AND unc < 0.8 THEN '{fu.RADIATION}'
  WHEN p_any >= 0.3 AND (env_dir >= 0.5 OR env >= 0.55) AND p_qc < 0.6 AND p_reject < 0.7 AND unc < 0.8 THEN '{fu.ENVIRONMENT}'
  WHEN p_any >= 0.3 AND explained >= 0.55 AND rad < 0.6 AND env < 0.55 THEN '{fu.SYSTEMIC}' WHEN err AND qc_any THEN '{fu.CONFIRMED}' WHEN err THEN '{fu.MISSED}'
  WHEN p_any >= 0.15 AND (explained >= 0.35 OR micro >= 0.35 OR rad >= 0.4) AND p_reject < 0.7 THEN '{fu.CAUTION}' WHEN p_reject <= 0.3 AND issue <= 0.3 AND p_qc < 0.2 THEN '{fu.VALID}'
  WHEN unc >= 0.8 AND p_any >= 0.3 THEN '{fu.LIMITED}' ELSE '{fu.REVIEW}' END AS category FROM s4)"""
HALF = f"""{RAW}, g AS (SELECT station_id, network, to_timestamp(floor((epoch(date) - 1800) / 1800) * 1800) AT TIME ZONE 'UTC' AS date, avg(temp) AS temp FROM raw GROUP BY ALL),
a AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 30 MINUTE)) AS date FROM g), f AS (SELECT a.date, k.station_id, k.network, g.temp FROM a CROSS JOIN (SELECT DISTINCT station_id, network FROM g) k
  LEFT JOIN g ON g.date = a.date AND g.station_id = k.station_id AND g.network = k.network),
n AS (SELECT *, lag(temp) OVER ({S}) AS b, lead(temp) OVER ({S}) AS e, row_number() OVER ({S}) AS i, lead(1) OVER ({S}) IS NULL AS final FROM f),
half AS (SELECT date, station_id, network, CASE WHEN temp IS NULL AND (b IS NOT NULL OR i = 1) AND (e IS NOT NULL OR final) THEN coalesce((b + e) / 2, b) ELSE temp END AS temp FROM n)"""


def evidence(spark, d):
    """Fusion inputs that stand in from line items."""
    k, n = F.col("row_key"), F.col("line")
    part = lambda m, by: (k % m).cast("double") / by
    flags = F.when(n % 4 == 0, 0).otherwise(F.coalesce("lenient", F.lit(0))) + F.col("strict")
    return scored(spark, d).select(
        "station_id", "row_key", "line", "resid", (F.col("station_id") % 12).alias("km"), (F.col("station_id") % 5 - 2).cast("double").alias("bias"),
        F.when(n != 7, 20 + F.col("resid")).alias("temp"), F.when(k % 17 != 0, F.least("p", F.lit(1.0))).alias("p_model"), (1 - F.exp(-F.abs("resid") / 10)).alias("p_resid"),
        (flags.cast("double") / 2).alias("p_qc"), part(7, 10).alias("explained"), part(5, 8).alias("micro"), part(4, 5).alias("env"), part(6, 10).alias("env_dir"), part(9, 10).alias("rad"), part(11, 12).alias("unc"),
        (F.abs("resid") / 2).alias("abs_z"), (flags > 0).alias("qc_any"), (n > 4).alias("qc_strong"),
    )


def fused(spark, d):
    return fu.scores(evidence(spark, d)).withColumn("category", fu.category())


def raw(spark, d):
    u = F.col("user_id")
    return table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("date"), (u % 10).alias("station_id"), F.when(u % 3 == 0, "ows").otherwise("cws").alias("network"), F.col("value").alias("temp"))


def _text(df, digits: int = 6):
    return df.withColumns({"date": F.date_format("date", "yyyy-MM-dd HH:mm:ss"), "temp": F.round("temp", digits)})


def _half(spark, d):
    return tl.half_hours(tl.shift(raw(spark, d), "forward", 30))


def _correction(df):
    return fu.corrected(df).groupBy("category").agg(F.count("*").alias("n"), *(F.round(F.avg(F.abs(c)), 6).alias(f"mae_{c}") for c in ("resid", "resid_policy", "resid_all")))


_RESID = "round(avg(resid), 6) AS bias, round(avg(abs(resid)), 6) AS mae, round(sqrt(avg(resid * resid)), 6) AS rmse, round(quantile_cont(abs(resid), 0.5), 6) AS median_abs, round(quantile_cont(abs(resid), 0.9), 6) AS p90_abs, round(quantile_cont(abs(resid), 0.95), 6) AS p95_abs, round(quantile_cont(abs(resid), 0.99), 6) AS p99_abs, round(avg(CAST(abs(resid) > 1 AS INTEGER)), 6) AS over_1, round(avg(CAST(abs(resid) > 2 AS INTEGER)), 6) AS over_2, round(avg(CAST(abs(resid) > 3 AS INTEGER)), 6) AS over_3"

_SUITE: dict = {
    "categories": (
        lambda spark, d: fused(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("p_qc"), 6).alias("p_qc")),
        f"WITH {FUSED} SELECT category, count(*) AS n, round(avg(p_qc), 6) AS p_qc FROM fused GROUP BY 1",
    ),
    "qc_crosstab": (
        lambda spark, d: ev.crosstab(fused(spark, d), "category", "qc_strong"),
        f"WITH {FUSED}, g AS (SELECT category, qc_strong, count(*) AS n FROM fused GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY category), 6) AS share FROM g",
    ),
    "fusion_categories": (
        lambda spark, d: fused(spark, d).select("row_key", "line", "station_id", *(F.round(c, 9).alias(c) for c in ("p_any", "p_unexplained", "p_reject", "p_preserve")), "category"),
        f"WITH {FUSED} SELECT row_key, line, station_id, round(p_any, 9) AS p_any, round(p_unexplained, 9) AS p_unexplained, round(p_reject, 9) AS p_reject, round(p_preserve, 9) AS p_preserve, category FROM fused",
    ),
    "bias_correction": (
        lambda spark, d: _correction(fused(spark, d)),
        f"""WITH {FUSED}, c AS (SELECT *, resid - CASE WHEN category IN ('{fu.SYSTEMIC}', '{fu.RADIATION}') THEN bias ELSE 0 END AS rp, resid - bias AS ra FROM fused)
SELECT category, count(*) AS n, round(avg(abs(resid)), 6) AS mae_resid, round(avg(abs(rp)), 6) AS mae_resid_policy, round(avg(abs(ra)), 6) AS mae_resid_all FROM c GROUP BY 1""",
    ),
    "support_guardrail": (
        lambda spark, d: fu.guardrail(fused(spark, d), 8).groupBy("original", "category").agg(F.count("*").alias("n"), F.count_if("rerouted").alias("n_rerouted")),
        f"""WITH {FUSED}, g AS (SELECT category AS original, km > 8 AND (p_any >= 0.3 OR abs(resid) >= 2 OR abs_z >= 3) AND category NOT IN ('{fu.CONSISTENT}', '{fu.VALID}', '{fu.RESCUE}')
  AND NOT (qc_any AND p_reject >= 0.8 AND explained < 0.35 AND env < 0.35 AND rad < 0.4) AS moved FROM fused)
SELECT original, CASE WHEN moved THEN '{fu.LIMITED}' ELSE original END AS category, count(*) AS n, count(*) FILTER (moved) AS n_rerouted FROM g GROUP BY 1, 2""",
    ),
    "utc_shift_resample": (lambda spark, d: _text(_half(spark, d)), f"WITH {HALF} SELECT {DAY}, station_id, network, round(temp, 6) AS temp FROM half"),
    "hourly_first": (
        lambda spark, d: _text(tl.hourly_first(_half(spark, d))),
        f"WITH {HALF} SELECT strftime(date_trunc('hour', date), '%Y-%m-%d %H:%M:%S') AS date, station_id, network, round(arg_min(temp, date) FILTER (temp IS NOT NULL), 6) AS temp FROM half GROUP BY ALL",
    ),
    "lst_climatology": (
        lambda spark, d: _text(tl.climatology(qc.densify(observations(spark, d)))).withColumn("filled", F.round("filled", 6)),
        f"""WITH {OBS}, o AS (SELECT d.date, k.station_id, k.network, o.temp FROM (SELECT DISTINCT date FROM obs) d CROSS JOIN (SELECT DISTINCT station_id, network FROM obs) k LEFT JOIN obs o ON o.date = d.date AND o.station_id = k.station_id AND o.network = k.network),
s AS (SELECT station_id, network, month(date) AS m, hour(date) AS h, quantile_cont(temp, 0.5) AS sm FROM o GROUP BY ALL), n AS (SELECT network, month(date) AS m, hour(date) AS h, quantile_cont(temp, 0.5) AS nm FROM o GROUP BY ALL)
SELECT {DAY}, o.station_id, o.network, round(temp, 6) AS temp, round(coalesce(temp, sm, nm), 6) AS filled, CAST(coalesce(temp, sm, nm) IS NULL AS INTEGER) AS missing
FROM o JOIN s ON s.station_id = o.station_id AND s.network = o.network AND s.m = month(date) AND s.h = hour(date) JOIN n ON n.network = o.network AND n.m = month(date) AND n.h = hour(date)""",
    ),
    "spatial_blocks": (
        lambda spark, d: tl.spatial_blocks(stations(spark, d)),
        """WITH meta AS (SELECT s_suppkey AS station_id, 47 + (s_suppkey * 7919 % 1000) / 4000.0::DOUBLE AS lat, 8 + (s_suppkey * 104729 % 1000) / 4000.0::DOUBLE AS long FROM supplier),
e AS (SELECT list_distinct(quantile_cont(lat, [0.2, 0.4, 0.6, 0.8])) AS el, list_distinct(quantile_cont(long, [0.2, 0.4, 0.6, 0.8])) AS eo FROM meta)
SELECT station_id, CAST(len(list_filter(el, lambda x: x < lat)) AS INTEGER) AS lat_block, CAST(len(list_filter(eo, lambda x: x < long)) AS INTEGER) AS long_block FROM meta, e""",
    ),
    "qn_scale_hourly": (
        lambda spark, d: _text(observations(spark, d).groupBy("date").agg(qn_scale("temp").alias("temp"))),
        f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY temp) AS i, count(*) OVER (PARTITION BY date) AS n FROM obs), p AS (
  SELECT a.date, b.temp - a.temp AS diff, row_number() OVER (PARTITION BY a.date ORDER BY b.temp - a.temp) AS k, (a.n // 2 + 1) * (a.n // 2) // 2 AS want FROM r a JOIN r b ON a.date = b.date AND a.i < b.i)
SELECT strftime(d.date, '%Y-%m-%d %H:%M:%S') AS date, round(diff * 2.219144465985076::DOUBLE, 6) AS temp FROM (SELECT DISTINCT date FROM obs) d LEFT JOIN p ON p.date = d.date AND k = want""",
    ),
    "residual_metrics": (
        lambda spark, d: cal.residual_metrics(scored(spark, d), ["split", "strict"]),
        f"WITH {SCORED} SELECT split, strict, count(*) AS n, {_RESID} FROM scored GROUP BY 1, 2",
    ),
    "sigma_lookup": (
        lambda spark, d: cal.with_sigma(scored(spark, d), [["strict"], ["lenient"], ["lenient", "strict"]], 200).groupBy("lenient", "strict").agg(F.count("*").alias("n"), F.round(F.avg("sigma"), 6).alias("sigma"), F.round(F.avg(F.abs("z")), 6).alias("mean_abs_z")),
        f"""WITH {SCORED}, t AS (SELECT * FROM scored WHERE split = 'train'), {cal.sigma_sql("s1", ["strict"])}, {cal.sigma_sql("s2", ["lenient"])}, {cal.sigma_sql("s3", ["lenient", "strict"])}, {cal.sigma_sql("s0", [])},
j AS (SELECT s.*, coalesce(CASE WHEN s3.n >= 200 THEN s3.sigma END, CASE WHEN s2.n >= 200 THEN s2.sigma END, CASE WHEN s1.n >= 200 THEN s1.sigma END, s0.sigma) AS sigma FROM scored s
  LEFT JOIN s1 ON s1.strict = s.strict LEFT JOIN s2 ON s2.lenient IS NOT DISTINCT FROM s.lenient LEFT JOIN s3 ON s3.lenient IS NOT DISTINCT FROM s.lenient AND s3.strict = s.strict CROSS JOIN s0)
SELECT lenient, strict, count(*) AS n, round(avg(sigma), 6) AS sigma, round(avg(abs(resid / sigma)), 6) AS mean_abs_z FROM j GROUP BY 1, 2""",
    ),
    "matched_frontier": (
        lambda spark, d: cal.matched_frontier(scored(spark, d), ["lenient", "strict"]),
        f"""WITH {SCORED}, v AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM scored WHERE split = 'valid'),
t AS (SELECT 'lenient' AS level, avg(CAST(coalesce(lenient, 0) = 0 AS INTEGER)) AS target FROM scored WHERE split = 'valid' UNION ALL SELECT 'strict', avg(CAST(coalesce(strict, 0) = 0 AS INTEGER)) FROM scored WHERE split = 'valid'),
q AS (SELECT level, target, target * ((SELECT max(n) FROM v) - 1) AS pos FROM t), c AS (SELECT level, target, round(a.p + (b.p - a.p) * (pos - floor(pos)), 6) AS threshold FROM q JOIN v a ON a.i = floor(pos) JOIN v b ON b.i = ceil(pos))
SELECT level, round(target, 6) AS target, threshold, count(*) FILTER (p <= threshold) AS n_kept, round(avg(abs(resid)) FILTER (p <= threshold), 6) AS mae_kept FROM c, scored WHERE split = 'test' GROUP BY level, target, threshold""",
    ),
    "spline_gap_fill": (lambda spark, d: _text(tl.spline_fill(qc.densify(observations(spark, d)))), None),
    "risk_gbt": (lambda spark, d: models.risk_scores(scored(spark, d), "gbt"), None),
    "risk_logistic": (lambda spark, d: models.risk_scores(scored(spark, d), "logistic"), None),
}
QUERIES = {k: q for k, (q, _) in _SUITE.items()}
ORACLES = {k: s for k, (_, s) in _SUITE.items() if s}
