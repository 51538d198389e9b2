"""Queries of the sources' surroundings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import environment as en
from ..operators import features as ft
from ..sources import observations
from .catalog import _NEAR, _sparse, _stamp, _targets
from .stand_ins import DAY, OBS

_FIGURES = "mean median std min max range weight idw mean_km min_km nearest nearest_km age_mean age_median age_idw age_nearest".split()


def _local(spark, d):
    o = observations(spark, d)
    keys = o.where("network = 'cws' AND station_id % 2 = 0").select("date", "station_id", "temp")
    found = en.local_environment(keys, _targets(spark, d), _sparse(o), "lst", "lst", k=4)
    out = en.differences(keys.join(found, en.KEYS), "temp", "lst")
    cols = [*(f"lst_{c}" for c in _FIGURES), *(c for c in out.columns if c.startswith("temp_minus"))]
    return _stamp(out.select("date", "station_id", "lst_n", "lst_nearest_rank", *(F.round(c, 9).alias(c) for c in cols)))


def _sql() -> str:
    w = "weight) FILTER (v IS NOT NULL)"
    near = lambda c: f"arg_min({c}, rank) FILTER (v IS NOT NULL)"
    out = {
        "mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "std": "stddev_samp(v)", "min": "min(v)", "max": "max(v)", "range": "max(v) - min(v)", "weight": f"coalesce(sum({w}, 0)", "idw": f"sum(weight * v) / nullif(sum({w}, 0)",
        "mean_km": "avg(km)", "min_km": "min(km)", "nearest": near("v"), "nearest_km": near("km"), "age_mean": "avg(age)", "age_median": "quantile_cont(age, 0.5)", "age_idw": f"sum(weight * age) / nullif(sum({w}, 0)", "age_nearest": near("age"),
    }
    figures = ", ".join(f"{c} AS lst_{n}" for n, c in out.items())
    diff = ", ".join(f"round(temp - lst_{c}, 9) AS temp_minus_lst_{c}, round(abs(temp - lst_{c}), 9) AS temp_minus_lst_{c}_abs" for c in ("idw", "nearest"))
    return f"""WITH {_NEAR}, {OBS}, keys AS (SELECT date, station_id, temp FROM obs WHERE network = 'cws' AND station_id % 2 = 0),
r AS (SELECT station_id, date AS rd, max(temp) AS lst FROM obs WHERE network = 'ows' AND temp < 60 GROUP BY 1, 2),
x AS (SELECT k.date, k.station_id, p.source_id, p.rank, p.km, p.weight, r.lst AS v, abs(epoch(k.date) - epoch(rd)) / 3600.0::DOUBLE AS age, row_number() OVER (PARTITION BY k.date, k.station_id, p.source_id ORDER BY r.lst IS NULL, abs(epoch(k.date) - epoch(rd)), rd) AS i
  FROM keys k JOIN pairs p ON p.station_id = k.station_id AND p.rank <= 4 LEFT JOIN r ON r.station_id = p.source_id AND abs(epoch(k.date) - epoch(rd)) <= 10800),
g AS (SELECT date, station_id, count(v) AS lst_n, {near("rank")} AS lst_nearest_rank, {figures} FROM x WHERE i = 1 GROUP BY 1, 2)
SELECT {DAY.replace("date,", "k.date,")}, k.station_id, coalesce(lst_n, 0) AS lst_n, lst_nearest_rank, {", ".join(f"round(lst_{c}, 9) AS lst_{c}" for c in _FIGURES)}, {diff} FROM keys k LEFT JOIN g ON g.date = k.date AND g.station_id = k.station_id"""


def _by_network(spark, d):
    o = observations(spark, d)
    left = o.where("hour(date) % 2 = 0").select("date", "station_id", "network", "temp")
    right = o.where("hour(date) % 2 = 1").select("date", "station_id", "network", F.col("temp").alias("lst"))
    return _stamp(ft.asof(left, right, "lst", "nearest", 2).withColumn("age_h", F.round("age_h", 6)))


_NETWORK_SQL = f"""WITH {OBS}, l AS (SELECT * FROM obs WHERE hour(date) % 2 = 0), r AS (SELECT station_id, network, date AS rd, temp AS lst FROM obs WHERE hour(date) % 2 = 1),
j AS (SELECT l.*, r.lst, abs(epoch(date) - epoch(rd)) / 3600.0::DOUBLE AS age_h, row_number() OVER (PARTITION BY l.station_id, l.network, l.date ORDER BY r.lst IS NULL, abs(epoch(date) - epoch(rd)), rd) AS k
  FROM l LEFT JOIN r ON l.station_id = r.station_id AND l.network = r.network AND abs(epoch(date) - epoch(rd)) <= 7200)
SELECT {DAY}, station_id, network, temp, lst, round(age_h, 6) AS age_h, CAST(lst IS NULL AS INTEGER) AS missing FROM j WHERE k = 1"""

QUERIES = {"local_environment": _local, "asof_by_network": _by_network}
ORACLES = {"local_environment": _sql(), "asof_by_network": _NETWORK_SQL}
