"""Queries of sigma by time and difficulty, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import uncertainty as un
from ..sources import context
from .context import _SUPPORT

_TRAIN = "split = 'train'"


def _rows(spark, d):
    return context(spark, d).withColumn("hour", (F.col("row_key") % 24).cast("int"))


def _applied(spark, d):
    # The tables have some 400 rows and are read more than once: they are kept when they are first made.
    rows = _rows(spark, d)
    return un.apply_sigma(rows, un.sigma_tables(rows.where(_TRAIN)).persist())


def _bands(spark, d):
    rows = _applied(spark, d)
    return un.with_bands(rows, un.thresholds(rows.where(_TRAIN)))


def _bin(c: str, edges) -> str:
    return f"coalesce({' + '.join(f'CAST({c} > {e} AS INTEGER)' for e in edges)} + 1, 0)"


_CODES = {"all": "0", "month": "coalesce(month, 0)", "hour": "hour + 1", "month_hour": "coalesce(month, 0) * 25 + hour + 1"}
_CODES |= {c: _bin(f"abs({c})" if c.endswith("_gap") else c, e) for c, e in un.DIFFICULTY.items()} | {"support": _bin("support", un.CLASS_EDGES)}
_BASE = f"""{_SUPPORT}, t AS (SELECT *, CAST(row_key % 24 AS INTEGER) AS hour FROM supported), c AS (SELECT *, {", ".join(f"CAST({c} AS INTEGER) AS c_{n}" for n, c in _CODES.items())} FROM t),
e AS ({" UNION ALL ".join(f"SELECT '{n}' AS name, c_{n} AS code, resid FROM c WHERE {_TRAIN} AND resid IS NOT NULL" for n in _CODES)}),
m AS (SELECT name, code, quantile_cont(resid, 0.5) AS med FROM e GROUP BY 1, 2),
a AS (SELECT e.name, e.code, count(*) AS n, 1.4826 * quantile_cont(abs(resid - med), 0.5) AS mad, stddev_pop(resid) AS sd FROM e JOIN m ON e.name = m.name AND e.code = m.code GROUP BY 1, 2),
tables AS (SELECT name, code, n, CASE WHEN n >= 200 OR name = 'all' THEN round(greatest(CASE WHEN mad > 0 THEN mad ELSE sd END, 0.2), 6) END AS sigma FROM a)"""
_LOOK = {n: f"(SELECT sigma FROM tables WHERE name = '{n}' AND code = c_{n})" for n in _CODES}
_APPLIED = f"""{_BASE}, s AS (SELECT c.*, greatest(coalesce({", ".join(_LOOK[n] for n in reversed(un.TIMES))}), {", ".join(v for n, v in _LOOK.items() if n not in un.TIMES)}, 0.2) AS sigma FROM c), z AS (SELECT *, resid / sigma AS z FROM s)"""
_LIMITS = "q AS (SELECT quantile_cont(abs(resid), 0.995) AS rh, quantile_cont(abs(resid), 0.95) AS rl, quantile_cont(abs(z), 0.995) AS zh, quantile_cont(abs(z), 0.95) AS zl FROM z WHERE split = 'train')"
_BAND = "CASE WHEN abs({0}) <= {1} THEN 'high_confidence_low_risk' WHEN abs({0}) <= {2} THEN 'ambiguous' WHEN abs({0}) > {2} THEN 'high_confidence_high_risk' END"

_SUITE = {
    "sigma_tables": (lambda spark, d: un.sigma_tables(_rows(spark, d).where(_TRAIN)), f"WITH {_BASE} SELECT * FROM tables"),
    "sigma_applied": (
        lambda spark, d: _applied(spark, d).groupBy("station_id", "split").agg(F.count("*").alias("n"), F.round(F.avg("sigma"), 6).alias("sigma"), F.round(F.max("sigma"), 6).alias("most"), F.round(F.avg(F.abs("z")), 6).alias("z")),
        f"WITH {_APPLIED} SELECT station_id, split, count(*) AS n, round(avg(sigma), 6) AS sigma, round(max(sigma), 6) AS most, round(avg(abs(z)), 6) AS z FROM z GROUP BY 1, 2",
    ),
    "sigma_thresholds": (
        lambda spark, d: un.thresholds(_applied(spark, d).where(_TRAIN)).select(*(F.round(c, 6).alias(c) for c in ("resid_high", "resid_low", "z_high", "z_low"))),
        f"WITH {_APPLIED}, {_LIMITS} SELECT round(rh, 6) AS resid_high, round(rl, 6) AS resid_low, round(zh, 6) AS z_high, round(zl, 6) AS z_low FROM q",
    ),
    "reference_bands": (
        lambda spark, d: _bands(spark, d).groupBy("split", "band_abs", "band_z").agg(F.count("*").alias("n"), F.sum("risk_abs").alias("risk_abs"), F.sum("risk_z").alias("risk_z")),
        f"WITH {_APPLIED}, {_LIMITS} SELECT split, {_BAND.format('resid', 'rl', 'rh')} AS band_abs, {_BAND.format('z', 'zl', 'zh')} AS band_z, count(*) AS n, CAST(sum(CAST(coalesce(abs(resid) > rh, false) AS INTEGER)) AS BIGINT) AS risk_abs, CAST(sum(CAST(coalesce(abs(z) > zh, false) AS INTEGER)) AS BIGINT) AS risk_z FROM z, q GROUP BY 1, 2, 3",
    ),
}
QUERIES = {n: q for n, (q, _) in _SUITE.items()}
ORACLES = {n: s for n, (_, s) in _SUITE.items()}
