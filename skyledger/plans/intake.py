"""Queries of station ids and flag panels, each with its SQL.

Ids of files are stand-ins from the line items (bare, with a prefix that nobody observes, with one that
may itself be observed), the observed ones from the suppliers. Flag panels are written from the hourly
observations, as CSV into a folder of their own, and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity, qc
from ..sources import observations, panels, table
from .stand_ins import OBS

_ID = "CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_suppkey AS STRING) WHEN l_suppkey % 3 = 1 THEN concat('b', l_suppkey % 7, '_', l_suppkey) ELSE concat(l_suppkey % 11, '_', l_suppkey) END"
_NET = "CASE WHEN l_suppkey % 2 = 0 THEN 'Netatmo' ELSE 'OWS' END"
IDS = f"""ids AS (SELECT DISTINCT {_ID.replace("STRING", "VARCHAR")} AS station_id, lower({_NET}) AS network FROM lineitem),
known AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS k FROM supplier WHERE s_suppkey % 4 <> 0),
vs AS (SELECT *, CASE WHEN contains(station_id, '_') THEN list_distinct([station_id, split_part(station_id, '_', 2), split_part(station_id, '_', 1)]) ELSE [station_id] END AS v FROM ids),
ranked AS (SELECT station_id, network, station_id AS name, 1 AS rank FROM vs UNION SELECT station_id, network, split_part(station_id, '_', 2), 2 FROM vs WHERE contains(station_id, '_') UNION
  SELECT station_id, network, split_part(station_id, '_', 1), 3 FROM vs WHERE contains(station_id, '_') AND split_part(station_id, '_', 1) <> split_part(station_id, '_', 2)),
res0 AS (SELECT station_id, network, count(k) AS n_matches, arg_min(k, rank) FILTER (k IS NOT NULL) AS first, count(*) AS many FROM ranked LEFT JOIN known ON name = k GROUP BY 1, 2),
res AS (SELECT station_id, network, coalesce(first, CASE WHEN network = 'netatmo' AND many > 1 THEN split_part(station_id, '_', 2) ELSE station_id END) AS canonical, n_matches, CASE n_matches WHEN 0 THEN 'unknown' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM res0)"""
_SHARES = "round(n_overlap / n_observed, 6) AS overlap_observed, round(n_overlap / n_ids, 6) AS overlap_ids"
_OVER = "count(*) AS n_ids, (SELECT count(*) FROM known) AS n_observed, count(k) AS n_overlap"


def _ids(spark, d):
    return table(spark, d, "lineitem").select(F.expr(_ID).alias("station_id"), F.expr(_NET).alias("network"), F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("station"))


def _observed(spark, d):
    return table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("station_id"))


def _alias_sql() -> str:
    names = {"raw": "station_id", "after_last_underscore": "split_part(station_id, '_', -1)", "before_first_underscore": "split_part(station_id, '_', 1)"}
    rows = " UNION ".join(f"SELECT '{n}' AS name, {i} AS ord, {c} AS value FROM ids" for i, (n, c) in enumerate(names.items()))
    return f"""WITH {IDS}, a AS ({rows}), o AS (SELECT name, ord, {_OVER}, coalesce(array_to_string(list_sort(list(k) FILTER (k IS NOT NULL))[1:5], ', '), '') AS examples FROM a LEFT JOIN known ON value = k GROUP BY 1, 2)
SELECT name, n_ids, n_observed, n_overlap, {_SHARES}, examples, row_number() OVER (ORDER BY n_overlap DESC, ord) = 1 AS chosen FROM o"""


def _variant_sql() -> str:
    second = "CASE WHEN contains(station_id, '_') THEN split_part(station_id, '_', 2) ELSE station_id END"
    third = "CASE WHEN contains(station_id, '_') AND split_part(station_id, '_', 1) <> split_part(station_id, '_', 2) THEN split_part(station_id, '_', 1) ELSE station_id END"
    rows = " UNION ".join(f"SELECT '{n}' AS name, {c} AS value FROM res" for n, c in {"exact": "station_id", "underscore_suffix": second, "underscore_prefix": third, "canonical": "canonical"}.items())
    return f"WITH {IDS}, a AS ({rows}), o AS (SELECT name, {_OVER} FROM a LEFT JOIN known ON value = k GROUP BY 1) SELECT name, n_ids, n_observed, n_overlap, {_SHARES} FROM o"


#: Levels of flags: open ranges that the hourly values must lie in.
RANGES = {"lenient": (2, 180), "strict": (10, 120)}


def _panels(spark, d):
    """Flags of both levels, written and read: one network, stations as columns."""
    folder, raw, flags = panels.work_folder(spark, "flag-panels"), observations(spark, d).where("network = 'cws'"), {}
    for level, (low, high) in RANGES.items():
        panels.write_flag_panel(raw, qc.limit_test(raw, low, high), f"{folder}/{level}")
        flags[level] = panels.flag_panel(spark, f"{folder}/{level}", level)
    return panels.merge_flags(flags)


def _keys(spark, d):
    return observations(spark, d).select("date", F.col("station_id").cast("string").alias("station_id"), "network")


_FLAGS = f"""{OBS}, flags AS (SELECT date, station_id, {", ".join(f"CAST(NOT (temp > {low} AND temp < {high}) AS INTEGER) AS {level}" for level, (low, high) in RANGES.items())} FROM obs WHERE network = 'cws'),
f AS (SELECT o.*, {", ".join(RANGES)}, count(DISTINCT o.network) OVER (PARTITION BY o.date, o.station_id) > 1 AND flags.date IS NOT NULL AS odd FROM obs o LEFT JOIN flags USING (date, station_id))"""

_SUITE = {
    "station_id_resolution": (
        lambda spark, d: identity.resolve(_ids(spark, d), _observed(spark, d), network="network"),
        f"WITH {IDS}, s AS (SELECT canonical, count(DISTINCT station_id) AS n_sharing FROM res GROUP BY 1) SELECT res.*, n_sharing FROM res JOIN s USING (canonical)",
    ),
    "station_ids_canonical": (
        lambda spark, d: identity.canonicalize(_ids(spark, d), _observed(spark, d), network="network").groupBy("station_id").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_stations")),
        f"WITH {IDS} SELECT canonical AS station_id, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_stations FROM lineitem JOIN res ON res.station_id = {_ID.replace('STRING', 'VARCHAR')} AND res.network = lower({_NET}) GROUP BY 1",
    ),
    "station_alias_report": (lambda spark, d: identity.alias_report(_ids(spark, d), _observed(spark, d)), _alias_sql()),
    "station_variant_report": (lambda spark, d: identity.variant_report(_ids(spark, d), _observed(spark, d), network="network"), _variant_sql()),
    "station_column_scores": (
        lambda spark, d: identity.column_scores(_ids(spark, d), _observed(spark, d)),
        f"WITH {IDS}, p AS (SELECT DISTINCT 'station_id' AS name, station_id AS value FROM ids UNION SELECT DISTINCT 'id', CAST(l_suppkey AS VARCHAR) FROM lineitem UNION SELECT DISTINCT 'station', CAST(l_partkey AS VARCHAR) FROM lineitem) SELECT name, count(k) AS n_overlap FROM p LEFT JOIN known ON value = k GROUP BY 1",
    ),
    "qc_flag_panels": (
        lambda spark, d: _panels(spark, d).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss")),
        f"WITH {_FLAGS} SELECT strftime(date, '%Y-%m-%d %H:%M:%S') AS date, CAST(station_id AS VARCHAR) AS station_id, {', '.join(f'{k} AS qc_{k}_is_outlier' for k in RANGES)} FROM flags",
    ),
    "qc_flag_coverage": (
        lambda spark, d: panels.flag_coverage(panels.attach_flags(_keys(spark, d), _panels(spark, d))),
        f"WITH {_FLAGS} " + " UNION ALL ".join(f"SELECT '{k}' AS level, count({k}) AS available_rows, round(count({k}) / count(*), 6) AS available_share, count(*) FILTER ({k} = 1) AS flagged_rows, round(avg({k}), 6) AS flagged_share, count(*) FILTER ({k} IS NOT NULL AND odd) AS ambiguous_rows FROM f" for k in RANGES),
    ),
}
QUERIES = {n: q for n, (q, _) in _SUITE.items()}
ORACLES = {n: s for n, (_, s) in _SUITE.items()}
