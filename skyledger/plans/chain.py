"""Queries of the quality chain, each with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import QN_FACTOR, t_quantile
from ..operators import chain as ch
from ..operators import features as ft
from ..operators import qc
from ..sources import observations, stations
from .stand_ins import DAY, META, OBS, S

LOW, HIGH = ch.normal(0.1), ch.normal(0.9)
B_LOW, B_HIGH = ch.normal(ch.BUDDY_LOW), ch.normal(ch.BUDDY_HIGH)
#: The stand-in stations are spread over more land than a city's: their buddies are within 6 km.
REACH = 6000.0
STAGES = {
    "i3_limit": lambda o: qc.limit_test(o, 0, 200),
    "i4_slope": lambda o: qc.slope_test(o, 120),
    "i5_consistency": lambda o: qc.consistency_test(o),
    "g5_distribution": lambda o: ch.distribution_test(o, "z", low=0.02, high=0.98),
    "g6_trust": lambda o: ch.without_empty(ch.trust_test(ch.outliers(o, "i5_consistency", "g5_distribution"), "_out", 0.15)),
    "g7_correlation": lambda o: ch.correlation_test(o, 0.2),
}


def _stamp(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols or ("date",)})


def _obs(fn):
    return lambda spark, d: _stamp(fn(observations(spark, d)))


_KEPT = f"SELECT {DAY}, station_id, network, CASE WHEN {{}} THEN temp END AS temp FROM {{}}"
_MED = "med AS (SELECT date, quantile_cont(temp, 0.5) AS mid, count(temp) AS n FROM obs GROUP BY 1)"
_QN = f"""r AS (SELECT date, temp, row_number() OVER (PARTITION BY date ORDER BY temp) AS i, count(*) OVER (PARTITION BY date) AS n FROM obs), pr AS (
  SELECT a.date, b.temp - a.temp AS diff, row_number() OVER (PARTITION BY a.date ORDER BY b.temp - a.temp) AS k, (a.n // 2 + 1) * (a.n // 2) // 2 AS want FROM r a JOIN r b ON a.date = b.date AND a.i < b.i),
q AS (SELECT date, diff * {QN_FACTOR}::DOUBLE AS scale FROM pr WHERE k = want)"""
_T = ", ".join(f"({n}, {t_quantile(0.9, n - 1)}::DOUBLE)" for n in range(2, 41))
_GEO = f"""{META}, k AS (SELECT t.station_id, s.station_id AS buddy_id, t.elev AS e1, s.elev AS e2, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(t.lat))) AS b1, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(s.lat))) AS b2, radians(s.long - t.long) AS dl
  FROM meta t JOIN meta s ON t.station_id <> s.station_id), k2 AS (SELECT *, 2 * asin(sqrt(least(1.0, pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin(dl / 2), 2)))) AS s, (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q FROM k),
geo AS (SELECT station_id, buddy_id, e1, e2, 6378137.0::DOUBLE * (s - 1 / 298.257223563::DOUBLE / 2 * ((s - sin(s)) * pow(sin(p) * cos(q), 2) / pow(cos(s / 2), 2) + coalesce((s + sin(s)) * pow(cos(p) * sin(q), 2) / nullif(pow(sin(s / 2), 2), 0), 0))) AS metres FROM k2)"""
_BUDDIES = f"{_GEO}, bp AS (SELECT station_id, buddy_id, count(*) OVER (PARTITION BY station_id) AS nb FROM geo WHERE metres <= {REACH} AND abs(e1 - e2) <= 100), buddies AS (SELECT station_id, buddy_id FROM bp WHERE nb >= 5)"
#: Observations of ten stations, put at the places of the stations of the same number and its tens.
_SPREAD = "spread AS (SELECT date, m.station_id, round(avg(temp) + m.station_id / 100.0::DOUBLE, 6) AS temp FROM obs JOIN meta m ON m.station_id % 10 = obs.station_id GROUP BY 1, 2)"


def _spread(spark, d):
    m = stations(spark, d).select("station_id", (F.col("station_id") % 10).alias("_of")).distinct()
    # The hours of ten stations, whatever the number of places.
    o = observations(spark, d).withColumnRenamed("station_id", "_of").groupBy("date", "_of").agg(F.avg("temp").alias("temp"))
    return m.join(F.broadcast(o), "_of").select("date", "station_id", F.round(F.col("temp") + F.col("station_id") / 100.0, 6).alias("temp"))


def _chain(spark, d):
    return ch.run_chain(observations(spark, d), STAGES)


_CHAIN = f"""{OBS}, g AS (SELECT d.date, k.station_id, k.network, o.temp FROM (SELECT DISTINCT date FROM obs) d CROSS JOIN (SELECT DISTINCT station_id, network FROM obs) k LEFT JOIN obs o ON o.date = d.date AND o.station_id = k.station_id AND o.network = k.network),
c1 AS (SELECT *, CASE WHEN temp > 0 AND temp < 200 THEN temp END AS v1 FROM g),
c2 AS (SELECT *, CASE WHEN coalesce(abs(v1 - lag(v1) OVER ({S})), 0) < 120 THEN v1 END AS v2 FROM c1),
c3 AS (SELECT *, CAST(coalesce(abs(v2 - lag(v2) OVER ({S})) < 0.005, true) AS INTEGER) AS flat, row_number() OVER ({S}) AS rn FROM c2),
c4 AS (SELECT *, CAST(sum(flat) OVER ({S} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 AND rn > 6 AS INTEGER) AS hit FROM c3),
c5 AS (SELECT *, CASE WHEN max(hit) OVER ({S} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) = 0 THEN v2 END AS v3 FROM c4),
c6 AS (SELECT *, (v3 - avg(v3) OVER w) / nullif(stddev_pop(v3) OVER w, 0) AS z, count(v3) OVER w AS nz FROM c5 WINDOW w AS (PARTITION BY date)),
c7 AS (SELECT *, CASE WHEN nz >= 5 AND z >= {ch.normal(0.02)} AND z <= {ch.normal(0.98)} THEN v3 END AS v4 FROM c6),
hr AS (SELECT date_trunc('month', date) AS month, count(DISTINCT date) AS hours FROM g GROUP BY 1),
tr AS (SELECT station_id, network, date_trunc('month', date) AS month, count(*) FILTER (v3 IS NOT NULL AND v4 IS NULL) AS lost FROM c7 GROUP BY 1, 2, 3),
c8 AS (SELECT c7.*, CASE WHEN lost / hours <= 0.15 THEN v4 END AS v5 FROM c7 JOIN tr ON tr.station_id = c7.station_id AND tr.network = c7.network AND tr.month = date_trunc('month', date) JOIN hr ON hr.month = tr.month),
c9 AS (SELECT *, count(v5) OVER (PARTITION BY station_id, network) AS held FROM c8),
md AS (SELECT date, quantile_cont(v5, 0.5) AS med FROM c9 WHERE held > 0 GROUP BY 1),
cr AS (SELECT station_id, network, month(c9.date) AS m, corr(v5, med) AS r FROM c9 JOIN md ON md.date = c9.date WHERE held > 0 GROUP BY 1, 2, 3),
chain AS (SELECT c9.*, CASE WHEN coalesce(abs(r) >= 0.2, true) THEN v5 END AS v6 FROM c9 JOIN cr ON cr.station_id = c9.station_id AND cr.network = c9.network AND cr.m = month(c9.date))"""
_NAMES = ["raw", *STAGES]
_COLS = ["temp", "v1", "v2", "v3", "v4", "v5", "v6"]

_SUITE: dict = {
    "g5_qn_normal": (
        _obs(lambda o: ch.distribution_test(o, "qn")),
        f"WITH {OBS}, {_MED}, {_QN}, z AS (SELECT obs.*, n, (temp - mid) / nullif(scale, 0) AS z FROM obs LEFT JOIN med USING (date) LEFT JOIN q USING (date)) " + _KEPT.format(f"n >= 5 AND z >= {LOW} AND z <= {HIGH}", "z"),
    ),
    "g5_mad_normal": (
        _obs(lambda o: ch.distribution_test(o, "mad")),
        f"""WITH {OBS}, {_MED}, a AS (SELECT date, avg(abs(temp - m)) AS away FROM (SELECT *, avg(temp) OVER (PARTITION BY date) AS m FROM obs) GROUP BY 1),
z AS (SELECT obs.*, n, (temp - mid) / nullif(away / 0.6745::DOUBLE, 0) AS z FROM obs JOIN med USING (date) JOIN a USING (date)) """
        + _KEPT.format(f"n >= 5 AND z >= {LOW} AND z <= {HIGH}", "z"),
    ),
    "g5_z_student": (
        _obs(lambda o: ch.distribution_test(o, "z", student=True)),
        f"""WITH {OBS}, t(m, high) AS (VALUES {_T}), z AS (SELECT *, (temp - avg(temp) OVER w) / nullif(stddev_pop(temp) OVER w, 0) AS z, count(temp) OVER w AS n FROM obs WINDOW w AS (PARTITION BY date)),
y AS (SELECT z.*, high FROM z LEFT JOIN t ON t.m = n) """
        + _KEPT.format("n >= 5 AND z >= -high AND z <= high", "y"),
    ),
    "buddy_pairs": (
        lambda spark, d: ch.buddy_pairs(stations(spark, d), REACH),
        f"WITH {_BUDDIES} SELECT station_id, buddy_id FROM buddies",
    ),
    "g5b_buddies": (
        lambda spark, d: _stamp(ch.buddy_test_near(_spread(spark, d), stations(spark, d), REACH)),
        f"""WITH {OBS}, {_BUDDIES}, {_SPREAD}, bv AS (SELECT b.station_id, s.date, s.temp FROM buddies b JOIN spread s ON s.station_id = b.buddy_id),
mid AS (SELECT station_id, date, quantile_cont(temp, 0.5) AS mid FROM bv GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY station_id, date ORDER BY temp) AS i, count(*) OVER (PARTITION BY station_id, date) AS n FROM bv),
pr AS (SELECT a.station_id, a.date, b.temp - a.temp AS diff, row_number() OVER (PARTITION BY a.station_id, a.date ORDER BY b.temp - a.temp) AS k, (a.n // 2 + 1) * (a.n // 2) // 2 AS want FROM r a JOIN r b ON a.station_id = b.station_id AND a.date = b.date AND a.i < b.i),
q AS (SELECT station_id, date, diff * {QN_FACTOR}::DOUBLE AS scale FROM pr WHERE k = want),
z AS (SELECT s.*, (s.temp - mid) / nullif(scale, 0) AS z FROM spread s LEFT JOIN mid USING (station_id, date) LEFT JOIN q USING (station_id, date))
SELECT {DAY}, station_id, CASE WHEN coalesce(z < {B_LOW} OR z > {B_HIGH}, false) THEN NULL ELSE temp END AS temp FROM z""",
    ),
    "g6_trust_cleaned": (
        _obs(lambda o: ch.without_empty(ch.trust_test(o.withColumn("flag", (F.col("temp") > 60).cast("int")), "flag", 0.2)).select("date", "station_id", "network", "temp")),
        f"""WITH {OBS}, h AS (SELECT date_trunc('month', date) AS month, count(DISTINCT date) AS hours FROM obs GROUP BY 1), t AS (SELECT station_id, network, h.month, sum(CAST(temp > 60 AS INTEGER)) / max(hours) AS share FROM obs JOIN h ON h.month = date_trunc('month', date) GROUP BY 1, 2, 3),
c AS (SELECT o.date, o.station_id, o.network, CASE WHEN share <= 0.2 THEN temp END AS temp FROM obs o JOIN t ON t.station_id = o.station_id AND t.network = o.network AND t.month = date_trunc('month', o.date)), s AS (SELECT *, count(temp) OVER (PARTITION BY station_id, network) AS held FROM c)
SELECT {DAY}, station_id, network, temp FROM s WHERE held > 0""",
    ),
    "g7_correlation_cleaned": (
        _obs(lambda o: ch.correlation_test(o, 0.3)),
        f"""WITH {OBS}, m AS (SELECT date, quantile_cont(temp, 0.5) AS median FROM obs GROUP BY 1), r AS (SELECT station_id, network, month(date) AS m, abs(corr(temp, median)) AS r FROM obs JOIN m USING (date) GROUP BY 1, 2, 3)
SELECT strftime(o.date, '%Y-%m-%d %H:%M:%S') AS date, o.station_id, o.network, CASE WHEN coalesce(r >= 0.3, true) THEN temp END AS temp FROM obs o JOIN r ON r.station_id = o.station_id AND r.network = o.network AND r.m = month(o.date)""",
    ),
    "qc_chain": (
        lambda spark, d: _stamp(_chain(spark, d).select("date", "station_id", "network", *_NAMES)),
        f"WITH {_CHAIN} SELECT {DAY}, station_id, network, {', '.join(f'{c} AS {n}' for c, n in zip(_COLS, _NAMES, strict=True))} FROM chain WHERE held > 0",
    ),
    "qc_outliers": (
        _obs(lambda o: ch.outliers(qc.slope_test(o.withColumn("before", F.col("temp")), 40), "before").where("_out").select("date", "station_id", "network", "before")),
        f"WITH {OBS}, s AS (SELECT *, abs(temp - lag(temp) OVER ({S})) AS d FROM obs) SELECT {DAY}, station_id, network, temp AS before FROM s WHERE d >= 40",
    ),
    "qc_statistics": (
        lambda spark, d: ch.statistics(_chain(spark, d), _NAMES),
        f"""WITH {_CHAIN}, kept AS (SELECT * FROM chain WHERE held > 0), l AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{n}' AS stage, station_id, network, {c} AS v FROM kept" for i, (c, n) in enumerate(zip(_COLS, _NAMES, strict=True)))}),
p AS (SELECT i, stage, station_id, network, count(v) AS n, count(*) AS dates FROM l GROUP BY ALL), a AS (SELECT i, stage, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS stations, max(dates) AS dates FROM p GROUP BY 1, 2)
SELECT stage, dates * stations AS size, n, stations, round(n * 100.0 / nullif(dates * stations, 0), 6) AS available, round(n::DOUBLE / nullif(lag(n) OVER (ORDER BY i), 0) * 100 - 100, 6) AS step, round(n::DOUBLE / nullif(first(n) OVER (ORDER BY i), 0) * 100 - 100, 6) AS total FROM a""",
    ),
    "panel_profile": (
        lambda spark, d: _stamp(ch.profile(qc.densify(observations(spark, d))), "first", "last"),
        f"""WITH {OBS}, g AS (SELECT d.date, k.station_id, k.network, o.temp FROM (SELECT DISTINCT date FROM obs) d CROSS JOIN (SELECT DISTINCT station_id, network FROM obs) k LEFT JOIN obs o ON o.date = d.date AND o.station_id = k.station_id AND o.network = k.network)
SELECT network, count(DISTINCT station_id) AS stations, strftime(min(date), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(date), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n_rows, count(temp) AS n, round(1 - count(temp) / count(*), 6) AS missing, min(temp) AS low, max(temp) AS high FROM g GROUP BY 1""",
    ),
    "missing_stations": (
        _obs(lambda o: ch.missing_test(qc.densify(o), 0.46)),
        f"""WITH {OBS}, g AS (SELECT d.date, k.station_id, k.network, o.temp FROM (SELECT DISTINCT date FROM obs) d CROSS JOIN (SELECT DISTINCT station_id, network FROM obs) k LEFT JOIN obs o ON o.date = d.date AND o.station_id = k.station_id AND o.network = k.network),
s AS (SELECT *, avg(CAST(temp IS NULL AS INTEGER)) OVER (PARTITION BY station_id, network) AS share FROM g) """
        + _KEPT.format("share <= 0.46", "s"),
    ),
    "heights_there_and_back": (
        lambda spark, d: _stamp(ch.with_heights(lambda o: ch.distribution_test(o, "z"), stations(spark, d))(observations(spark, d))),
        f"""WITH {OBS}, {META}, h AS (SELECT o.*, o.temp + coalesce((elev - (SELECT avg(elev) FROM meta)) * 0.0065, 0) AS t FROM obs o LEFT JOIN meta m ON m.station_id = o.station_id),
z AS (SELECT *, (t - avg(t) OVER w) / nullif(stddev_pop(t) OVER w, 0) AS z, count(t) OVER w AS n FROM h WINDOW w AS (PARTITION BY date)) """
        + _KEPT.format(f"n >= 5 AND z >= {LOW} AND z <= {HIGH}", "z"),
    ),
    "radius_counts": (
        lambda spark, d: ft.radius_counts(stations(spark, d), stations(spark, d).where("station_id % 2 = 1"), 4).withColumn("near_ids", F.concat_ws("|", "near_ids")),
        f"WITH {_GEO} SELECT m.station_id, count(buddy_id) AS n_near, coalesce(string_agg(CAST(buddy_id AS VARCHAR), '|' ORDER BY buddy_id), '') AS near_ids FROM meta m LEFT JOIN geo g ON g.station_id = m.station_id AND metres <= 4000 AND buddy_id % 2 = 1 GROUP BY 1",
    ),
}
QUERIES = {k: q for k, (q, _) in _SUITE.items()}
ORACLES = {k: s for k, (_, s) in _SUITE.items() if s}
