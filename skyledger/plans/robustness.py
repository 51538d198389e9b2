"""Queries of bootstraps, holdouts, shifts and relational basics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import frontier as fr
from ..operators import fusion as fu
from ..operators import robust as ro
from ..operators import support as su
from ..operators import tables as tb
from ..operators import timeline as tl
from ..sources import context, observations, scored, stations
from .products import FUSED, fused
from .stand_ins import CONTEXT, DAY, META, OBS, SCORED, S

RULES = {"all": "true", "low_risk": "p <= 0.3", "unflagged": "strict = 0", "lenient_ok": "lenient = 0"}
SEEDS = ["11", "22", "33", "44", "55"]


def _rules():
    return {name: F.expr(rule) for name, rule in RULES.items()}


def _scored(fn):
    return lambda spark, d: fn(scored(spark, d))


def _context(fn):
    return lambda spark, d: fn(context(spark, d))


def _obs(fn):
    return lambda spark, d: fn(observations(spark, d)).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


def _drawn(of: str) -> str:
    """The draws over the distinct blocks of a table, in SQL."""
    return f"""nb AS (SELECT block, row_number() OVER (ORDER BY md5(block), block) - 1 AS i FROM (SELECT DISTINCT block FROM {of})), dr AS (SELECT t.b, CAST('0x' || substr(md5('2026-' || t.b || '-' || nb.i), 1, 8) AS BIGINT) % (SELECT count(*) FROM nb) AS i FROM nb, unnest(range(1, 501)) AS t(b)),
dw AS (SELECT b, block, count(*) AS w FROM dr JOIN nb USING (i) GROUP BY 1, 2)"""


def _bounds(*names: str) -> str:
    return ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{k}" for c in names for k, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975)))


def _boot_sql(table: str, block: str, group: str) -> str:
    return f"""su AS (SELECT CAST({block} AS VARCHAR) AS block, {group}, count(*) AS n, sum(abs(resid)) AS a, sum(resid * resid) AS q, sum(resid) AS s FROM {table} WHERE resid IS NOT NULL GROUP BY 1, 2), {_drawn("su")},
pa AS (SELECT b, {group}, sum(w * n) AS n, sum(w * a) AS a, sum(w * q) AS q, sum(w * s) AS s FROM dw JOIN su USING (block) GROUP BY 1, 2), me AS (SELECT *, n / sum(n) OVER (PARTITION BY b) AS share, a / n AS mae, sqrt(q / n) AS rmse, s / n AS bias FROM pa)
SELECT {group}, count(*) AS draws, {_bounds("share", "mae", "rmse", "bias")} FROM me GROUP BY 1"""


_EACH = " UNION ALL ".join(f"SELECT '{n}' AS policy, * FROM scored WHERE coalesce({c}, false)" for n, c in RULES.items())
_ROUNDED = "CAST(CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2) ELSE round(x) END AS BIGINT)"


def _holdout(seeds) -> str:
    one = lambda s: f"SELECT '{s}' AS seed, station_id FROM (SELECT station_id, row_number() OVER (ORDER BY md5('{s}|' || station_id), station_id) AS r, count(*) OVER () * 0.15::DOUBLE AS x FROM (SELECT DISTINCT station_id FROM scored)) WHERE r <= {_ROUNDED}"
    return f"""te AS ({" UNION ALL ".join(map(one, seeds))}), ru AS (SELECT seed, count(DISTINCT station_id) AS stations, count(*) AS n, avg(abs(resid)) AS mae, sqrt(avg(resid * resid)) AS rmse, avg(resid) AS bias, avg(CAST(abs(resid) > 2 AS INTEGER)) AS over_2 FROM scored JOIN te USING (station_id) GROUP BY 1),
lo AS ({" UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS v FROM ru" for c in ("mae", "rmse", "bias", "over_2"))})"""


_SHIFT = ["solar", "wind", "spread", "elev_gap", "resid"]
_TAIL = ["station_id", "month", "n_refs", "is_day"]


def _flags(df, column):
    return df.select("station_id", "row_key", "line", F.col(column).alias("flag")).groupBy("station_id", "row_key", "line").agg(F.max("flag").alias("flag"))


def _near(spark, d):
    o = observations(spark, d)
    return tb.fill_chain(o.where("network = 'cws'").select("date", "station_id", "network"), o.where("network = 'ows' AND temp < 60").groupBy("date", "station_id").agg(F.max("temp").alias("near")), 2)


_LEVELS, _SCORES = {"lenient": "lenient", "strict": "strict"}, {"reject": "p", "spread": "spread"}
_RESIDUALS = {"raw": "resid", "station_bias": "resid_corrected"}


def _corrected(spark, d):
    """Scored rows with their residual less its mean over the station's train rows."""
    rows = context(spark, d)
    bias = rows.where("split = 'train'").groupBy("station_id").agg(F.round(F.avg("resid"), 6).alias("bias"))
    return rows.join(bias, "station_id", "left").withColumns({"resid_corrected": F.col("resid") - F.col("bias"), "block": F.col("station_id")})


def _frontier(spark, d, result):
    rows = _corrected(spark, d)
    specs = fr.matched_specs(rows.where("split = 'valid'"), _LEVELS, _SCORES, _RESIDUALS)
    out = result(rows.where("split = 'test'"), specs, [*_LEVELS.values(), *_SCORES.values()], list(_RESIDUALS.values()))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


_SPECS = f"""{CONTEXT}, bi AS (SELECT station_id, round(avg(resid), 6) AS bias FROM context WHERE split = 'train' GROUP BY 1), v AS (SELECT c.*, resid - bias AS resid_corrected FROM context c LEFT JOIN bi USING (station_id)),
tg AS ({" UNION ALL ".join(f"SELECT '{k}' AS level, avg(CAST(coalesce({c}, 0) = 0 AS INTEGER)) AS target FROM v WHERE split = 'valid'" for k, c in _LEVELS.items())}),
li AS ({" UNION ALL ".join(f"SELECT '{k}' AS name, '{c}' AS score, list({c} ORDER BY {c}) AS l FROM v WHERE split = 'valid' AND {c} IS NOT NULL" for k, c in _SCORES.items())}),
po AS (SELECT *, target * (len(l) - 1) AS pos FROM tg, li), cu AS (SELECT name, level, score, target, round(l[CAST(floor(pos) AS BIGINT) + 1] + (l[CAST(ceil(pos) AS BIGINT) + 1] - l[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos)), 9) AS threshold FROM po),
ba AS (SELECT 'flag_' || level AS base, level, level AS score, CAST(NULL AS DOUBLE) AS threshold, target FROM tg UNION ALL SELECT name || '_matched_to_' || level, level, score, threshold, target FROM cu),
sp AS (SELECT base || '__' || suffix AS method, level, score, threshold, target, residual FROM ba, (VALUES {", ".join(f"('{k}', '{c}')" for k, c in _RESIDUALS.items())}) r(suffix, residual)),
te AS (SELECT * FROM v WHERE split = 'test'), lg AS ({" UNION ALL ".join(f"SELECT station_id, row_key, line, '{c}' AS score, CAST({c} AS DOUBLE) AS x, resid, resid_corrected FROM te" for c in [*_LEVELS.values(), *_SCORES.values()])}),
us AS (SELECT CAST(station_id AS VARCHAR) AS block, method, CASE WHEN residual = 'resid' THEN resid ELSE resid_corrected END AS r FROM lg JOIN sp USING (score) WHERE CASE WHEN threshold IS NULL THEN coalesce(x, 0) = 0 ELSE x <= threshold END)"""
_KEPT = "count(*) AS n, sum(r) AS s, sum(abs(r)) AS a, sum(r * r) AS q, sum(CAST(abs(r) > 1 AS INTEGER)) AS o1, sum(CAST(abs(r) > 2 AS INTEGER)) AS o2, sum(CAST(abs(r) > 3 AS INTEGER)) AS o3 FROM us WHERE r IS NOT NULL"
_FIGURES = {"retention": "n / n_total", "bias": "s / n", "mae": "a / n", "rmse": "sqrt(q / n)", "over_1": "o1 / n", "over_2": "o2 / n", "over_3": "o3 / n"}

_SUITE: dict = {
    "frontier_matched": (
        lambda spark, d: _frontier(spark, d, fr.frontier),
        f"""WITH {_SPECS}, k AS (SELECT method, {_KEPT} GROUP BY 1), th AS ({" UNION ALL ".join(f"SELECT '{c}' AS score, avg(CAST({c} IS NOT NULL AS INTEGER)) AS score_there, count(*) AS n_total FROM te" for c in [*_LEVELS.values(), *_SCORES.values()])})
SELECT method, level, score, round(threshold, 6) AS threshold, round(target, 6) AS target, residual, round(score_there, 6) AS score_there, n_total, coalesce(n, 0) AS n_used, {", ".join(f"round({x}, 6) AS {m}" for m, x in _FIGURES.items())} FROM sp JOIN th USING (score) LEFT JOIN k USING (method)""",
    ),
    "frontier_bootstrap": (
        lambda spark, d: _frontier(spark, d, fr.bootstrap_frontier),
        f"""WITH {_SPECS}, wh AS (SELECT CAST(station_id AS VARCHAR) AS block, count(*) AS m FROM te GROUP BY 1), {_drawn("wh")}, pk AS (SELECT b, block, w FROM dw UNION ALL SELECT 0, block, 1 FROM wh), su AS (SELECT block, method, {_KEPT} GROUP BY 1, 2),
tt AS (SELECT b, sum(w * m) AS n_total, count(*) AS n_blocks FROM pk JOIN wh USING (block) GROUP BY 1), pa AS (SELECT b, method, {", ".join(f"sum(w * {c}) AS {c}" for c in fr.SUMS)} FROM pk JOIN su USING (block) GROUP BY 1, 2),
me AS (SELECT b, method, CAST(n AS BIGINT) AS n, CAST(n_total AS BIGINT) AS n_total, n_blocks, {", ".join(f"{x} AS {m}" for m, x in _FIGURES.items())} FROM pa JOIN tt USING (b))
SELECT method, count(*) FILTER (b > 0) AS draws, max(n_blocks) FILTER (b = 0) AS n_blocks, max(n_total) FILTER (b = 0) AS n_total, max(n) FILTER (b = 0) AS n_used, {", ".join(f"round(max({m}) FILTER (b = 0), 6) AS {m}, " + ", ".join(f"round(quantile_cont({m}, {q}) FILTER (b > 0), 6) AS {m}_{k}" for k, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))) for m in fr.METRICS)} FROM me GROUP BY 1""",
    ),
    "log_loss": (_scored(ro.log_loss), f"WITH {SCORED} SELECT split, CASE WHEN count(DISTINCT y) > 1 THEN round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) END), 6) END AS log_loss FROM scored GROUP BY 1"),
    "f1_on_validation": (
        _scored(ev.f1_on_validation),
        f"""WITH {SCORED}, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scored WHERE split = 'valid' GROUP BY 1), c AS (SELECT p, round(2 * sum(pos) OVER w / (sum(n) OVER w + sum(pos) OVER ()), 9) AS f1 FROM g WINDOW w AS (ORDER BY p DESC)),
t AS (SELECT p AS threshold FROM c ORDER BY f1 DESC, p LIMIT 1), k AS (SELECT split, threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn FROM scored, t GROUP BY 1, 2),
m AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re FROM k) SELECT split, threshold, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re + 1e-12), 6) AS f1 FROM m""",
    ),
    "policy_bootstrap": (
        _scored(lambda s: ro.bootstrap_policies(s, _rules())),
        f"""WITH {SCORED}, wh AS (SELECT CAST(station_id AS VARCHAR) AS block, count(*) AS m FROM scored WHERE resid IS NOT NULL GROUP BY 1), {_drawn("wh")}, ke AS (SELECT CAST(station_id AS VARCHAR) AS block, policy, count(*) AS n, sum(abs(resid)) AS a FROM ({_EACH}) WHERE resid IS NOT NULL GROUP BY 1, 2),
tt AS (SELECT b, sum(w * m) AS m FROM dw JOIN wh USING (block) GROUP BY 1), pa AS (SELECT b, policy, sum(w * n) / max(m) AS retention, sum(w * a) / sum(w * n) AS mae FROM dw JOIN ke USING (block) JOIN tt USING (b) GROUP BY 1, 2)
SELECT policy, count(*) AS draws, {_bounds("retention", "mae")} FROM pa GROUP BY 1""",
    ),
    "category_bootstrap": (lambda spark, d: ro.bootstrap_metrics(fused(spark, d), "station_id", "category"), f"WITH {FUSED}, " + _boot_sql("fused", "station_id", "category")),
    "support_bootstrap": (
        lambda spark, d: ro.bootstrap_metrics(su.reference_class(context(spark, d)), "station_id", "reference_class"),
        f"WITH {CONTEXT}, v AS (SELECT *, CASE WHEN km > 10 OR n_refs <= 0 THEN 'outside' WHEN km > 5 OR n_refs <= 1 OR coalesce(spread > 4, false) THEN 'low' WHEN km <= 2 AND n_refs >= 4 AND coalesce(spread <= 2, true) THEN 'high' ELSE 'moderate' END AS reference_class FROM context), " + _boot_sql("v", "station_id", "reference_class"),
    ),
    "station_month_bootstrap": (
        lambda spark, d: ro.bootstrap_metrics(context(spark, d).withColumn("unit", F.concat_ws("@", "station_id", "month")), "unit", "split"),
        f"WITH {CONTEXT}, v AS (SELECT *, station_id || '@' || month AS unit FROM context), " + _boot_sql("v", "unit", "split"),
    ),
    "station_day_bootstrap": (
        lambda spark, d: ro.bootstrap_metrics(ro.with_block(observations(spark, d).withColumn("resid", F.col("temp") - 50), "station_day", "unit"), "unit", "network"),
        f"WITH {OBS}, v AS (SELECT *, temp - 50 AS resid, network || '::' || station_id || '::' || strftime(date, '%Y-%m-%d') AS unit FROM obs), " + _boot_sql("v", "unit", "network"),
    ),
    "holdout_runs": (
        _scored(lambda s: ro.holdout_runs(s, SEEDS).select("seed", "stations", "n", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias", "over_2")))),
        f"WITH {SCORED}, {_holdout(SEEDS)} SELECT seed, stations, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(over_2, 6) AS over_2 FROM ru",
    ),
    "holdout_summary": (
        _scored(lambda s: ro.holdout_summary(ro.holdout_runs(s, SEEDS))),
        f"WITH {SCORED}, {_holdout(SEEDS)} SELECT metric, count(*) AS runs, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM lo GROUP BY 1",
    ),
    "holdout_comparison": (
        _scored(lambda s: ro.holdout_comparison(s, SEEDS)),
        f"""WITH {SCORED}, {_holdout(SEEDS)}, al AS (SELECT 'mae' AS metric, avg(abs(resid)) AS v FROM scored UNION ALL SELECT 'rmse', sqrt(avg(resid * resid)) FROM scored UNION ALL SELECT 'bias', avg(resid) FROM scored UNION ALL SELECT 'over_2', avg(CAST(abs(resid) > 2 AS INTEGER)) FROM scored)
SELECT metric, round(avg(lo.v), 6) AS mean, round(max(al.v), 6) AS whole, round(round(avg(lo.v), 6) - max(al.v), 5) AS change FROM lo JOIN al USING (metric) GROUP BY 1""",
    ),
    "shift_table": (
        _context(lambda c: ro.shift_table(c, _SHIFT)),
        f"""WITH {CONTEXT}, l AS ({" UNION ALL ".join(f"SELECT '{c}' AS column, split, {c} AS v FROM context" for c in _SHIFT)}), g AS (SELECT column, split, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM l GROUP BY 1, 2)
SELECT g.column, g.split, g.n, round(g.mean, 6) AS mean, round(g.std, 6) AS std, round((g.mean - t.mean) / nullif(t.std, 0), 6) AS shift FROM g JOIN g t ON t.column = g.column AND t.split = 'train'""".replace("column", "col").replace(" AS col,", " AS col,").replace("SELECT g.col,", 'SELECT g.col AS "column",'),
    ),
    "tail_audit": (
        _context(lambda c: ro.tail_audit(c, _TAIL, 500, 100)),
        f"""WITH {CONTEXT}, g AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(resid) AS n, round(avg(abs(resid)), 6) AS mae FROM context GROUP BY 2" for c in _TAIL)}) SELECT col AS "column", value, n, mae FROM g WHERE n >= 500 ORDER BY mae DESC, col, value LIMIT 100""",
    ),
    "proxy_metrics": (
        _scored(lambda s: ro.proxy_metrics(s, _rules())),
        f"""WITH {SCORED}, e AS ({" UNION ALL ".join(f"SELECT '{n}' AS policy, y, NOT coalesce({c}, false) AS gone FROM scored" for n, c in RULES.items())}), k AS (SELECT policy, count(*) FILTER (gone AND y = 1) AS tp, count(*) FILTER (gone AND y = 0) AS fp, count(*) FILTER (NOT gone AND y = 1) AS fn, count(*) FILTER (NOT gone AND y = 0) AS tn FROM e GROUP BY 1),
m AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re FROM k) SELECT policy, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / greatest(pr + re, 1e-12), 6) AS f1 FROM m""",
    ),
    "correction_coverage": (
        lambda spark, d: ro.coverage(fused(spark, d).withColumn("resid", F.when(F.col("line") != 2, F.col("resid"))), "category", [fu.SYSTEMIC, fu.RADIATION]),
        f"""WITH {FUSED}, v AS (SELECT category, CASE WHEN line != 2 THEN resid END AS r, category IN ('{fu.SYSTEMIC}', '{fu.RADIATION}') AS hit FROM fused) SELECT category, count(*) AS n, count(r) AS n_resid, count(*) FILTER (hit AND r IS NOT NULL) AS n_corrected, round(avg(CAST(hit AND r IS NOT NULL AS INTEGER)), 6) AS share FROM v GROUP BY 1""",
    ),
    "block_holdout": (
        lambda spark, d: ro.block_holdout(tl.spatial_blocks(stations(spark, d))),
        f"""WITH {META}, e AS (SELECT list_distinct(quantile_cont(lat, [0.2, 0.4, 0.6, 0.8])) AS el, list_distinct(quantile_cont(long, [0.2, 0.4, 0.6, 0.8])) AS eo FROM meta),
b AS (SELECT station_id, CAST(len(list_filter(el, lambda x: x < lat)) AS INTEGER) AS lat_block, CAST(len(list_filter(eo, lambda x: x < long)) AS INTEGER) AS long_block FROM meta, e),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || lat_block || '|' || long_block), lat_block, long_block) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT lat_block, long_block FROM b))
SELECT station_id, lat_block, long_block, CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM b JOIN r USING (lat_block, long_block)""",
    ),
    "category_actions": (
        lambda spark, d: fused(spark, d).groupBy("category", tb.action(F.col("category")).alias("action")).agg(F.count("*").alias("n")),
        f"WITH {FUSED} SELECT category, CASE category {' '.join(f"WHEN '{c}' THEN '{a}'" for c, a in tb.ACTIONS.items())} END AS action, count(*) AS n FROM fused GROUP BY 1, 2",
    ),
    "levels_full_outer": (
        _scored(lambda s: tb.levels(_flags(s.where("line <> 3"), "strict"), _flags(s.where("line <> 5"), "lenient"), ["station_id", "row_key", "line"]).groupBy("strict", "lenient").agg(F.count("*").alias("n"))),
        f"""WITH {SCORED}, a AS (SELECT station_id, row_key, line, max(strict) AS strict FROM scored WHERE line <> 3 GROUP BY 1, 2, 3), b AS (SELECT station_id, row_key, line, max(lenient) AS lenient FROM scored WHERE line <> 5 GROUP BY 1, 2, 3) SELECT strict, lenient, count(*) AS n FROM a FULL JOIN b USING (station_id, row_key, line) GROUP BY 1, 2""",
    ),
    "labels_inner": (
        _scored(lambda s: tb.weak_labels(_flags(s, "strict"), _flags(s.where("lenient IS NOT NULL"), "lenient"), ["station_id", "row_key", "line"]).groupBy("label").agg(F.count("*").alias("n"))),
        f"""WITH {SCORED}, a AS (SELECT station_id, row_key, line, max(strict) AS strict FROM scored GROUP BY 1, 2, 3), b AS (SELECT station_id, row_key, line, max(lenient) AS lenient FROM scored WHERE lenient IS NOT NULL GROUP BY 1, 2, 3)
SELECT CASE WHEN strict = 1 AND lenient = 1 THEN 1 WHEN strict = 0 AND lenient = 0 THEN 0 END AS label, count(*) AS n FROM a JOIN b USING (station_id, row_key, line) GROUP BY 1""",
    ),
    "checked_left_join": (
        lambda spark, d: tb.left_one(observations(spark, d), stations(spark, d).where("station_id <> 4"), ["station_id"]).groupBy("station_id", "network").agg(F.count("*").alias("n"), F.max("elev").alias("elev")),
        f"WITH {OBS}, {META} SELECT o.station_id, network, count(*) AS n, max(elev) AS elev FROM obs o LEFT JOIN meta m ON m.station_id = o.station_id AND m.station_id <> 4 GROUP BY 1, 2",
    ),
    "semi_anti": (
        lambda spark, d: stations(spark, d).join(observations(spark, d), "station_id", "left_semi").select("station_id", F.lit("present").alias("what")).unionByName(stations(spark, d).join(observations(spark, d), "station_id", "left_anti").select("station_id", F.lit("absent").alias("what"))),
        f"WITH {OBS}, {META} SELECT station_id, CASE WHEN station_id IN (SELECT station_id FROM obs) THEN 'present' ELSE 'absent' END AS what FROM meta",
    ),
    "interval_lookup": (
        _scored(lambda s: tb.interval_lookup(s.select("station_id", "p"), _rates(s), "p", ["rate"]).groupBy("station_id").agg(F.count("*").alias("n"), F.count("rate").alias("n_rate"), F.round(F.avg("rate"), 8).alias("rate"))),
        f"""WITH {SCORED}, r AS (SELECT floor(p * 10) / 10 AS lo, avg(y) AS rate FROM scored WHERE split = 'valid' AND p < 0.9 GROUP BY 1) SELECT station_id, count(*) AS n, count(rate) AS n_rate, round(avg(rate), 8) AS rate FROM scored s LEFT JOIN r ON p >= lo AND (p < (lo * 10 + 1) / 10 OR (lo = (SELECT max(lo) FROM r) AND p = (lo * 10 + 1) / 10)) GROUP BY 1""",
    ),
    "rolling_median": (
        _obs(tb.rolling_median),
        f"WITH {OBS} SELECT strftime(obs.date, '%Y-%m-%d %H:%M:%S') AS date, station_id, network, temp, " + ", ".join(f"CASE WHEN count(temp) OVER ({S.replace('date', 'obs.date')} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) >= {m} THEN round(quantile_cont(temp, 0.5) OVER ({S.replace('date', 'obs.date')} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 6) END AS median{k}" for k, m in ((3, 2), (6, 3), (24, 12))) + " FROM obs",
    ),
    "backward_fill": (
        _obs(lambda o: tb.backward_fill(o.withColumn("temp", F.when(F.col("temp") < 60, F.col("temp"))))),
        f"WITH {OBS}, t AS (SELECT date, station_id, network, CASE WHEN temp < 60 THEN temp END AS temp FROM obs) SELECT strftime(t.date, '%Y-%m-%d %H:%M:%S') AS date, station_id, network, temp, first_value(temp IGNORE NULLS) OVER (PARTITION BY station_id, network ORDER BY t.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM t",
    ),
    "fill_chain": (
        lambda spark, d: _near(spark, d).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss")),
        f"""WITH {OBS}, l AS (SELECT date, station_id, network FROM obs WHERE network = 'cws'), r AS (SELECT date AS rd, station_id, max(temp) AS near FROM obs WHERE network = 'ows' AND temp < 60 GROUP BY 1, 2),
j AS (SELECT l.*, r.near, abs(epoch(date) - epoch(rd)) / 3600.0::DOUBLE AS age, row_number() OVER (PARTITION BY l.station_id, l.date ORDER BY r.near IS NULL, abs(epoch(date) - epoch(rd)), rd) AS k FROM l LEFT JOIN r ON l.station_id = r.station_id AND abs(epoch(date) - epoch(rd)) <= 7200),
ow AS (SELECT station_id, month(rd) AS m, hour(rd) AS h, quantile_cont(near, 0.5) AS own FROM r GROUP BY 1, 2, 3), ne AS (SELECT month(rd) AS m, hour(rd) AS h, quantile_cont(near, 0.5) AS net FROM r GROUP BY 1, 2)
SELECT {DAY}, j.station_id, network, round(coalesce(near, own, net), 6) AS value, CASE WHEN near IS NOT NULL AND age = 0 THEN 'exact' WHEN near IS NOT NULL THEN 'near' WHEN own IS NOT NULL THEN 'station' WHEN net IS NOT NULL THEN 'network' ELSE 'none' END AS how
FROM j LEFT JOIN ow ON ow.station_id = j.station_id AND ow.m = month(date) AND ow.h = hour(date) LEFT JOIN ne ON ne.m = month(date) AND ne.h = hour(date) WHERE k = 1""",
    ),
    "r_squared": (
        lambda spark, d: tb.r_squared(observations(spark, d).join(observations(spark, d).groupBy("date").agg(F.avg("temp").alias("f")), "date"), ["station_id", "network"], "temp", "f"),
        f"WITH {OBS}, f AS (SELECT date, avg(temp) AS f FROM obs GROUP BY 1) SELECT station_id, network, count(*) AS n, CASE WHEN count(*) >= 2 AND var_pop(temp) > 0 THEN round(1 - sum((temp - f) * (temp - f)) / (var_pop(temp) * count(*)), 6) END AS r2 FROM obs JOIN f USING (date) GROUP BY 1, 2",
    ),
    "modes": (
        _scored(lambda s: tb.modes(s, ["station_id"], "split")),
        f"""WITH {SCORED}, c AS (SELECT station_id, split, count(*) AS n FROM scored GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY n DESC, split) AS k FROM c) SELECT station_id, max(split) FILTER (k = 1) AS mode, count(*) AS n_values, string_agg(split, '|' ORDER BY split) AS all_values FROM r GROUP BY 1""",
    ),
    "distinct_stations": (
        lambda spark, d: observations(spark, d).groupBy(F.hour("date").alias("hour")).agg(F.countDistinct("network", "station_id").alias("n_stations"), F.countDistinct("station_id").alias("n_ids"), F.countDistinct("network").alias("n_networks")),
        f"WITH {OBS} SELECT CAST(hour(date) AS INTEGER) AS hour, count(DISTINCT (network, station_id)) AS n_stations, count(DISTINCT station_id) AS n_ids, count(DISTINCT network) AS n_networks FROM obs GROUP BY 1",
    ),
    "dense_rank": (
        _scored(lambda s: tb.ranked(s.groupBy("split", "station_id").agg(F.round(F.avg(F.abs("resid")), 1).alias("mae")), "split", "mae")),
        f"WITH {SCORED}, g AS (SELECT split, station_id, round(avg(abs(resid)), 1) AS mae FROM scored GROUP BY 1, 2) SELECT *, CAST(dense_rank() OVER (PARTITION BY split ORDER BY mae DESC NULLS LAST) AS INTEGER) AS rank FROM g",
    ),
    "category_samples": (
        lambda spark, d: tb.samples(fused(spark, d).select("category", "station_id", "row_key", "line"), "category", ["station_id", "row_key", "line"], 5),
        f"WITH {FUSED}, v AS (SELECT DISTINCT category, station_id, row_key, line FROM fused), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || station_id || '|' || row_key || '|' || line), station_id, row_key, line) AS k FROM v) SELECT category, station_id, row_key, line FROM r WHERE k <= 5",
    ),
    "pivot_counts": (
        _scored(lambda s: tb.pivot_counts(s, "station_id", "split", ["train", "valid", "test"])),
        f"WITH {SCORED} SELECT station_id, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test FROM scored GROUP BY 1",
    ),
    "time_truncate": (
        _obs(lambda o: tb.truncated(o, "2024-01-05 00:00:00", "2024-01-06 12:00:00")),
        f"WITH {OBS} SELECT {DAY}, station_id, network, temp FROM obs WHERE date BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'",
    ),
    "station_names": (
        lambda spark, d: tb.named_ids(stations(spark, d).select("station_id", F.concat(F.lit(" "), F.col("station_id").cast("double").cast("string"), F.lit(" ")).alias("name")), "name"),
        f"WITH {META} SELECT station_id, CAST(station_id AS VARCHAR) AS name FROM meta",
    ),
    "row_means": (
        _context(lambda c: c.groupBy("station_id").agg(F.round(F.avg(su.mean_of(F.col("wind"), F.col("spread"), F.col("km"))), 8).alias("mean"), F.round(F.avg(su.max_of(F.col("wind"), F.col("spread"), F.col("km"))), 8).alias("most"))),
        f"""WITH {CONTEXT} SELECT station_id, round(avg((coalesce(wind, 0) + coalesce(spread, 0) + km) / (CAST(wind IS NOT NULL AS INTEGER) + CAST(spread IS NOT NULL AS INTEGER) + 1)), 8) AS mean, round(avg(greatest(wind, spread, km)), 8) AS most FROM context GROUP BY 1""",
    ),
    "union_distinct": (
        lambda spark, d: stations(spark, d).where("station_id < 60").select("station_id", "lcz").unionByName(stations(spark, d).where("station_id > 30").select("station_id", "lcz"), allowMissingColumns=True).dropDuplicates(),
        f"WITH {META} SELECT station_id, lcz FROM meta WHERE station_id < 60 UNION SELECT station_id, lcz FROM meta WHERE station_id > 30",
    ),
}


def _rates(s):
    tenth = F.floor(F.col("p") * 10)
    return s.where("split = 'valid' AND p < 0.9").groupBy(tenth.alias("k")).agg(F.avg("y").alias("rate")).select((F.col("k") / 10).alias("lo"), ((F.col("k") + 1) / 10).alias("hi"), "rate")


QUERIES = {k: q for k, (q, _) in _SUITE.items()}
ORACLES = {k: s for k, (_, s) in _SUITE.items() if s}
