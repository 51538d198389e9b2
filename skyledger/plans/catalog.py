"""Named queries over the given tables, each with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain as ch
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import qc
from ..sources import observations, scored, stations
from .stand_ins import DAY, META, OBS, SCORED, S

#: Twenty fractions from one half to 0.99.
SHARES = [round(0.5 + 0.49 * i / 19, 3) for i in range(20)]
TOPS = [5, 10, 25, 50, 100]


def _stamp(df, *cols):
    """Timestamps as text, the same in both engines."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols or ("date",)})


def _obs(fn):
    return lambda spark, d: _stamp(fn(observations(spark, d)))


def _scored(fn):
    return lambda spark, d: fn(scored(spark, d))


def _targets(spark, d):
    m = stations(spark, d)
    return ft.neighbours(m.where("station_id % 2 = 0"), m.where("station_id % 2 = 1"))


def _sparse(o):
    """The as-of join's right side: one network's coldest hours."""
    return o.where("network = 'ows' AND temp < 60").select("station_id", "date", F.col("temp").alias("lst"))


def _asof(direction):
    return _obs(lambda o: ft.asof(o.where("network = 'cws'").select("date", "station_id", "temp"), _sparse(o), "lst", direction, 3).withColumn("age_h", F.round("age_h", 6)))


_R = "r AS (SELECT station_id, date AS rd, max(temp) AS lst FROM obs WHERE network = 'ows' AND temp < 60 GROUP BY 1, 2), l AS (SELECT date, station_id, temp FROM obs WHERE network = 'cws')"


def _asof_sql(order: str, cond: str) -> str:
    return f"""WITH {OBS}, {_R}, j AS (SELECT l.*, r.lst, abs(epoch(date) - epoch(rd)) / 3600.0::DOUBLE AS age_h, row_number() OVER (PARTITION BY l.station_id, l.date, l.temp ORDER BY r.lst IS NULL, {order}) AS k
  FROM l LEFT JOIN r ON l.station_id = r.station_id AND {cond} AND abs(epoch(date) - epoch(rd)) <= 10800)
SELECT {DAY}, station_id, temp, lst, round(age_h, 6) AS age_h, CAST(lst IS NULL AS INTEGER) AS missing FROM j WHERE k = 1"""


_NEAR = f"""{META}, p0 AS (SELECT t.station_id, s.station_id AS source_id, t.elev - s.elev AS de, CAST(t.lcz = s.lcz AS INTEGER) AS same_lcz,
  round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.long - t.long) / 2), 2)))), 6) AS km
  FROM meta t JOIN meta s ON t.station_id % 2 = 0 AND s.station_id % 2 = 1), p1 AS (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY km, source_id) AS rank, count(*) FILTER (km <= 5) OVER (PARTITION BY station_id) AS n_in FROM p0),
pairs AS (SELECT station_id, source_id, CAST(rank AS INTEGER) AS rank, km, round(1 / pow(greatest(km, 0.05), 2) / sum(1 / pow(greatest(km, 0.05), 2)) OVER (PARTITION BY station_id), 6) AS weight, round(de, 6) AS elev_diff, same_lcz
  FROM p1 WHERE rank <= 5 AND (km <= 5 OR n_in = 0))"""
_CURVE = f"""{SCORED}, g AS (SELECT split, p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1, 2), c AS (
  SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY split ORDER BY p DESC) AS seen, sum(pos) OVER (PARTITION BY split) AS all_pos, sum(n) OVER (PARTITION BY split) AS total FROM g)"""


_SUITE: dict = {
    "obs_hourly_summary": (
        _obs(ft.hourly_summary),
        f"WITH {OBS} SELECT {DAY}, count(temp) AS n, round(avg(temp), 9) AS mean, round(quantile_cont(temp, 0.5), 6) AS median, round(stddev_samp(temp), 6) AS std, min(temp) AS low, max(temp) AS high, round(max(temp) - min(temp), 6) AS span FROM obs GROUP BY obs.date",
    ),
    "long_to_wide": (
        _obs(lambda o: o.groupBy("date").pivot("network", ["cws", "ows"]).agg(F.round(F.avg("temp"), 9))),
        f"WITH {OBS} SELECT {DAY}, round(avg(temp) FILTER (network = 'cws'), 9) AS cws, round(avg(temp) FILTER (network = 'ows'), 9) AS ows FROM obs GROUP BY obs.date",
    ),
    "wide_to_long": (
        lambda spark, d: stations(spark, d).unpivot("station_id", ["lat", "long", "elev"], "name", "value").withColumn("value", F.round("value", 6)),
        f"WITH {META} SELECT station_id, 'lat' AS name, round(lat, 6) AS value FROM meta UNION ALL SELECT station_id, 'long', round(long, 6) FROM meta UNION ALL SELECT station_id, 'elev', elev FROM meta",
    ),
    "limit_test": (_obs(lambda o: qc.limit_test(o, 20, 100)), f"WITH {OBS} SELECT {DAY}, station_id, network, CASE WHEN temp > 20 AND temp < 100 THEN temp END AS temp FROM obs"),
    "slope_test": (_obs(lambda o: qc.slope_test(o, 40)), f"WITH {OBS}, s AS (SELECT *, abs(temp - lag(temp) OVER ({S})) AS d FROM obs) SELECT {DAY}, station_id, network, CASE WHEN d IS NULL OR d < 40 THEN temp END AS temp FROM s"),
    "consistency_test": (
        _obs(lambda o: qc.consistency_test(qc.densify(o), 5, 3)),
        f"""WITH {OBS}, g AS (SELECT d.date, k.station_id, k.network, o.temp FROM (SELECT DISTINCT date FROM obs) d CROSS JOIN (SELECT DISTINCT station_id, network FROM obs) k LEFT JOIN obs o ON o.date = d.date AND o.station_id = k.station_id AND o.network = k.network),
f AS (SELECT *, CAST(coalesce(abs(temp - lag(temp) OVER ({S})) < 5, true) AS INTEGER) AS flat, row_number() OVER ({S}) AS rn FROM g),
h AS (SELECT *, CAST(sum(flat) OVER ({S} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AND rn > 3 AS INTEGER) AS hit FROM f),
m AS (SELECT *, max(hit) OVER ({S} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS mh FROM h)
SELECT {DAY}, station_id, network, CASE WHEN mh = 0 THEN temp END AS temp FROM m""",
    ),
    "zscore_by_hour": (
        _obs(qc.z_score_test),
        f"WITH {OBS}, z AS (SELECT *, (temp - avg(temp) OVER w) / nullif(stddev_pop(temp) OVER w, 0) AS z, count(temp) OVER w AS n FROM obs WINDOW w AS (PARTITION BY date)) SELECT {DAY}, station_id, network, CASE WHEN n >= 5 AND abs(z) < 1.2815515655446004 THEN temp END AS temp FROM z",
    ),
    "trust_month": (
        lambda spark, d: _stamp(ch.trust_table(observations(spark, d).withColumn("flag", (F.col("temp") > 60).cast("int")), "flag"), "month"),
        f"""WITH {OBS}, h AS (SELECT date_trunc('month', date) AS month, count(DISTINCT date) AS hours FROM obs GROUP BY 1)
SELECT station_id, network, strftime(h.month, '%Y-%m-%d %H:%M:%S') AS month, CAST(sum(CAST(temp > 60 AS INTEGER)) AS BIGINT) AS flagged, max(hours) AS hours, sum(CAST(temp > 60 AS INTEGER)) / max(hours) > 0.2 AS dropped FROM obs JOIN h ON h.month = date_trunc('month', date) GROUP BY ALL""",
    ),
    "correlation_month": (
        lambda spark, d: qc.month_correlation(observations(spark, d)).withColumn("r", F.round("r", 6)),
        f"WITH {OBS}, m AS (SELECT date, quantile_cont(temp, 0.5) AS median FROM obs GROUP BY 1) SELECT station_id, network, CAST(month(date) AS INTEGER) AS month, round(corr(temp, median), 6) AS r, coalesce(abs(corr(temp, median)) < 0.9, false) AS dropped FROM obs JOIN m USING (date) GROUP BY ALL",
    ),
    "gap_islands": (
        lambda spark, d: _stamp(qc.gap_islands(qc.densify(observations(spark, d))), "first", "last"),
        f"""WITH {OBS}, g AS (SELECT d.date, k.station_id, k.network, o.temp FROM (SELECT DISTINCT date FROM obs) d CROSS JOIN (SELECT DISTINCT station_id, network FROM obs) k LEFT JOIN obs o ON o.date = d.date AND o.station_id = k.station_id AND o.network = k.network),
r AS (SELECT *, temp IS NULL AS gap, row_number() OVER ({S}) - row_number() OVER (PARTITION BY station_id, network, temp IS NULL ORDER BY date) AS run FROM g)
SELECT station_id, network, gap, strftime(min(date), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(date), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n_rows FROM r GROUP BY station_id, network, gap, run""",
    ),
    "elevation_correction": (
        lambda spark, d: _stamp(qc.elevation_correction(observations(spark, d), stations(spark, d)).withColumn("temp", F.round("temp", 6))),
        f"WITH {OBS}, {META} SELECT {DAY}, o.station_id, network, round(temp + coalesce((elev - (SELECT avg(elev) FROM meta)) * 0.0065::DOUBLE, 0), 6) AS temp FROM obs o LEFT JOIN meta m ON o.station_id = m.station_id",
    ),
    "duplicate_meta": (
        lambda spark, d: qc.duplicate_stations(stations(spark, d).select("lat", "long", "lcz"), ["lat", "long", "lcz"]).groupBy("missing", "same", "again").agg(F.count("*").alias("n")),
        f"WITH {META}, r AS (SELECT lat IS NULL OR long IS NULL OR lcz IS NULL AS missing, coalesce(lat = long, false) AS same, row_number() OVER (PARTITION BY lat, long, lcz) > 1 AS again FROM meta) SELECT missing, same, again, count(*) AS n FROM r GROUP BY ALL",
    ),
    "bbox_filter": (
        lambda spark, d: stations(spark, d).where(F.col("lat").between(47.05, 47.2) & F.col("long").between(8.0, 8.2)).select("station_id", "lcz"),
        f"WITH {META} SELECT station_id, lcz FROM meta WHERE lat BETWEEN 47.05 AND 47.2 AND long BETWEEN 8.0 AND 8.2",
    ),
    "knn_radius_fallback": (_targets, f"WITH {_NEAR} SELECT * FROM pairs"),
    "idw_local": (
        lambda spark, d: _stamp(ft.local_reference(_targets(spark, d), observations(spark, d).groupBy("date", "station_id").agg(F.round(F.avg("temp"), 6).alias("temp")))),
        f"WITH {OBS}, {_NEAR}, o AS (SELECT date, station_id AS source_id, round(avg(temp), 6) AS temp FROM obs GROUP BY 1, 2) SELECT p.station_id, {DAY}, count(*) AS n, round(sum(weight * temp) / sum(weight), 5) AS idw, round(quantile_cont(temp, 0.5), 6) AS median, arg_min(temp, rank) AS nearest, round(stddev_samp(temp), 6) AS std, min(temp) AS low, max(temp) AS high, round(max(temp) - min(temp), 6) AS spread FROM pairs p JOIN o USING (source_id) GROUP BY p.station_id, o.date",
    ),
    "asof_backward": (_asof("backward"), _asof_sql("rd DESC", "rd <= date")),
    "asof_forward": (_asof("forward"), _asof_sql("rd", "rd >= date")),
    "asof_nearest": (_asof("nearest"), _asof_sql("abs(epoch(date) - epoch(rd)), rd", "true")),
    "forward_fill": (
        _obs(lambda o: ft.forward_fill(qc.limit_test(o, 20, 100))),
        f"WITH {OBS}, t AS (SELECT date, station_id, network, CASE WHEN temp > 20 AND temp < 100 THEN temp END AS temp FROM obs) SELECT {DAY}, station_id, network, temp, last_value(temp IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled, CAST(temp IS NULL AS INTEGER) AS was_missing FROM (SELECT * FROM t) obs",
    ),
    "lags": (_obs(ft.lags), f"WITH {OBS} SELECT {DAY}, station_id, network, temp, " + ", ".join(f"lag(temp, {k}) OVER ({S.replace('date', 'obs.date')}) AS lag{k}" for k in (1, 2, 3, 6, 12, 24)) + " FROM obs"),
    "rolling_lagged": (
        _obs(ft.rolling),
        f"WITH {OBS} SELECT {DAY}, station_id, network, temp, "
        + ", ".join(f"CASE WHEN count(temp) OVER w{k} >= {m} THEN round(avg(temp) OVER w{k}, 9) END AS mean{k}, CASE WHEN count(temp) OVER w{k} >= {m} THEN round(stddev_samp(temp) OVER w{k}, 6) END AS std{k}" for k, m in ((3, 2), (6, 3), (24, 12)))
        + " FROM obs WINDOW "
        + ", ".join(f"w{k} AS ({S.replace('date', 'obs.date')} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (3, 6, 24)),
    ),
    "temporal_features": (
        _obs(ft.calendar),
        f"WITH {OBS} SELECT {DAY}, station_id, network, temp, CAST(hour(obs.date) AS INTEGER) AS hour, CAST(month(obs.date) AS INTEGER) AS month, CAST(dayofyear(obs.date) AS INTEGER) AS day_of_year, CAST(isodow(obs.date) - 1 AS INTEGER) AS weekday, round(sin(2 * pi() * hour(obs.date) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(obs.date) / 24), 6) + 0.0 AS hour_cos FROM obs",
    ),
    "robust_sigma_groups": (
        lambda spark, d: ft.robust_sigma_of_few(scored(spark, d), ["split", "lenient"], "resid"),
        f"WITH {SCORED}, m AS (SELECT split, lenient, quantile_cont(resid, 0.5) AS med FROM scored GROUP BY 1, 2), g AS (SELECT s.split, s.lenient, quantile_cont(abs(resid - med), 0.5) AS mad, stddev_pop(resid) AS sd, count(resid) AS n FROM scored s JOIN m ON s.split = m.split AND s.lenient IS NOT DISTINCT FROM m.lenient GROUP BY 1, 2) SELECT split, lenient, n, round(greatest(CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END, 0.2), 6) AS sigma FROM g",
    ),
    "weak_labels": (
        _scored(lambda s: s.select(ev.weak_label("strict", "lenient").alias("label")).groupBy("label").agg(F.count("*").alias("n"))),
        f"WITH {SCORED} SELECT CASE WHEN strict = 1 AND lenient = 1 THEN 1 WHEN strict = 0 AND lenient = 0 THEN 0 END AS label, count(*) AS n FROM scored GROUP BY 1",
    ),
    "reliability_bins": (_scored(ev.reliability), f"WITH {SCORED} SELECT split, CAST(least(floor(p * 15), 14) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS event_rate FROM scored GROUP BY 1, 2"),
    "ece15": (_scored(ev.ece), f"WITH {SCORED}, g AS (SELECT split, least(floor(p * 15), 14) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY 1, 2) SELECT split, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM g GROUP BY 1"),
    "auroc": (_scored(ev.auroc), f"WITH {_CURVE} SELECT split, round(sum((n - pos) * (tp - pos + pos / 2)) / (max(all_pos) * (max(total) - max(all_pos))), 6) AS auroc FROM c GROUP BY 1"),
    "auprc": (_scored(ev.auprc), f"WITH {_CURVE} SELECT split, round(sum(pos / all_pos * tp / seen), 6) AS auprc FROM c GROUP BY 1"),
    "f1_threshold": (_scored(ev.best_f1), f"WITH {_CURVE}, f AS (SELECT split, p, round(2 * tp / (seen + all_pos), 9) AS f1 FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY f1 DESC, p) AS r FROM f) SELECT split, p AS threshold, round(f1, 6) AS f1 FROM k WHERE r = 1"),
    "confusion": (
        _scored(lambda s: ev.confusion(s, 0.5)),
        f"WITH {SCORED} SELECT split, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y <> 1) AS tn FROM scored GROUP BY 1",
    ),
    "retention_curve": (
        _scored(lambda s: ev.retention(s, SHARES)),
        f"WITH {SCORED}, q AS (SELECT split, quantile_cont(p, {SHARES}) AS q FROM scored GROUP BY 1), k AS (SELECT split, CAST(i - 1 AS INTEGER) AS step, round(q[i], 6) AS cutoff FROM q, unnest({list(range(1, 21))}) AS t(i)) SELECT s.split, step, count(*) AS n, round(avg(abs(resid)), 6) AS mae, round(sqrt(avg(resid * resid)), 6) AS rmse, round(avg(resid), 6) AS bias FROM scored s JOIN k ON s.split = k.split AND p <= cutoff GROUP BY 1, 2",
    ),
    "station_bias": (
        _scored(ev.station_bias),
        f"WITH {SCORED} SELECT station_id, count(*) AS n, CASE WHEN count(*) >= 24 THEN round(quantile_cont(resid, 0.5), 6) END AS median, CASE WHEN count(*) >= 24 THEN round(quantile_cont(resid, 0.75) - quantile_cont(resid, 0.25), 6) END AS iqr, CASE WHEN count(*) >= 24 THEN round(avg(CAST(abs(resid) > 2 AS INTEGER)), 6) END AS large_share, CASE WHEN count(*) >= 24 THEN round(regr_slope(resid, p), 5) END AS slope FROM scored WHERE split = 'train' GROUP BY 1",
    ),
    "policy_table": (
        _scored(lambda s: ev.policies(s, {"all": F.lit(True), "low_risk": F.col("p") <= 0.3, "unflagged": F.col("strict") == 0, "lenient_ok": F.col("lenient") == 0})),
        f"WITH {SCORED}, r AS (SELECT 'all' AS policy, resid FROM scored UNION ALL SELECT 'low_risk', resid FROM scored WHERE p <= 0.3 UNION ALL SELECT 'unflagged', resid FROM scored WHERE strict = 0 UNION ALL SELECT 'lenient_ok', resid FROM scored WHERE lenient = 0) SELECT policy, count(*) AS n, round(avg(abs(resid)), 6) AS mae, round(count(*) / (SELECT count(*) FROM scored), 6) AS retention FROM r GROUP BY 1",
    ),
    "dominance_topk": (
        _scored(lambda s: ev.dominance(s, TOPS)),
        f"""WITH {SCORED}, g AS (SELECT station_id, avg(abs(resid)) * count(*) AS c FROM scored GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY round(c, 6) DESC NULLS LAST, station_id) AS r, sum(c) OVER () AS total FROM g)
SELECT CAST(k AS INTEGER) AS k, round(sum(c), 4) AS top, round(sum(c) / max(total), 6) AS share FROM r JOIN unnest({TOPS}) AS t(k) ON r <= k GROUP BY 1""",
    ),
    "station_bootstrap": (
        _scored(lambda s: ev.bootstrap(s, draws=50)),
        f"WITH {SCORED}, g AS (SELECT station_id, count(*) AS n, sum(abs(resid)) AS s FROM scored GROUP BY 1), b AS (SELECT *, row_number() OVER (ORDER BY station_id) - 1 AS i FROM g), d AS (SELECT d.b, CAST('0x' || substr(md5('2026-' || d.b || '-' || b.i), 1, 8) AS BIGINT) % (SELECT count(*) FROM b) AS i FROM b, unnest(range(1, 51)) AS d(b)), e AS (SELECT d.b, sum(s) / sum(n) AS mae FROM d JOIN b USING (i) GROUP BY 1) SELECT round(quantile_cont(mae, 0.025), 6) AS low, round(quantile_cont(mae, 0.5), 6) AS mid, round(quantile_cont(mae, 0.975), 6) AS high FROM e",
    ),
    "station_bootstrap_500": (
        _scored(ev.bootstrap),
        f"WITH {SCORED}, g AS (SELECT station_id, count(*) AS n, sum(abs(resid)) AS s FROM scored GROUP BY 1), b AS (SELECT *, row_number() OVER (ORDER BY station_id) - 1 AS i FROM g), d AS (SELECT d.b, CAST('0x' || substr(md5('2026-' || d.b || '-' || b.i), 1, 8) AS BIGINT) % (SELECT count(*) FROM b) AS i FROM b, unnest(range(1, 501)) AS d(b)), e AS (SELECT d.b, sum(s) / sum(n) AS mae FROM d JOIN b USING (i) GROUP BY 1) SELECT round(quantile_cont(mae, 0.025), 6) AS low, round(quantile_cont(mae, 0.5), 6) AS mid, round(quantile_cont(mae, 0.975), 6) AS high FROM e",
    ),
    "split_stations": (
        _scored(ev.split_stations),
        f"WITH {SCORED}, s AS (SELECT DISTINCT station_id FROM scored), r AS (SELECT station_id, row_number() OVER (ORDER BY md5('42|' || station_id), station_id) AS r, count(*) OVER () AS n FROM s) SELECT station_id, CASE WHEN r <= round_even(n * 0.15, 0) THEN 'test' WHEN r <= 2 * round_even(n * 0.15, 0) THEN 'valid' ELSE 'train' END AS part FROM r",
    ),
    "reference_summaries": (
        _scored(lambda s: s.groupingSets([[F.col("split")], [F.col("split"), F.col("strict")], []], "split", "strict").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("resid")), 6).alias("mae"))),
        f"WITH {SCORED} SELECT split, strict, count(*) AS n, round(avg(abs(resid)), 6) AS mae FROM scored GROUP BY GROUPING SETS ((split), (split, strict), ())",
    ),
}
QUERIES = {k: q for k, (q, _) in _SUITE.items()}
ORACLES = {k: s for k, (_, s) in _SUITE.items()}


def entry(spark, sf_dir):
    return QUERIES["obs_hourly_summary"](spark, sf_dir)
