"""Residual metrics, sigma tables with fallbacks, and thresholds matched to a flag's retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import robust_sigma_of_few
from .ranks import attach, quantiles, running


def residual_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Eleven figures of the residuals, by group; null residuals are left out first."""
    r, a = F.col("resid"), F.abs("resid")
    out = {"bias": F.avg(r), "mae": F.avg(a), "rmse": F.sqrt(F.avg(r * r))} | {f"over_{k}": F.avg((a > k).cast("int")) for k in (1, 2, 3)}
    df = df.where(r.isNotNull())
    at = {"median_abs": 0.5, "p90_abs": 0.9, "p95_abs": 0.95, "p99_abs": 0.99}
    q = quantiles(df.select(*by, a.alias("_abs")), by, "_abs", at)
    g = attach(df.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(c, 6).alias(n) for n, c in out.items())), q.drop("n"), by)
    return g.withColumns({n: F.round(n, 6) for n in at})


def with_sigma(df: DataFrame, levels: list[list[str]], least: int = 200, floor: float = 0.2) -> DataFrame:
    """sigma and z of each row. The sigma of the last of the ``levels`` that has ``least`` train rows
    for the row's group counts, else that of all train rows; nulls are a group of their own. The
    tables have a row a group of flags, hours or months, so they go with the tasks and the rows are not
    exchanged; their joins are null-safe equi-joins."""
    # One fit of all levels and of all rows: a row counts in a group of each, and what a level does not tell
    # apart is null there.
    names = sorted({c for cols in levels for c in cols})
    train, every = df.where("split = 'train'"), [*levels, []]
    kinds = {c: train.schema[c].dataType for c in names}
    own = [F.struct(F.lit(i).alias("_level"), *((F.col(c) if c in cols else F.lit(None).cast(kinds[c])).alias(c) for c in names)) for i, cols in enumerate(every)]
    rows = train.select("resid", F.explode(F.array(*own)).alias("_g")).select("resid", "_g.*")
    fitted = robust_sigma_of_few(rows, ["_level", *names], "resid", floor).persist()  # a row a group
    out = df
    for i, cols in enumerate(levels):
        s = fitted.where(F.col("_level") == i)
        s = s.select(*(F.col(c).alias(f"_{i}{c}") for c in cols), F.when(F.col("n") >= least, F.col("sigma")).alias(f"_s{i}"))
        out = out.join(F.broadcast(s), reduce(lambda a, b: a & b, [out[c].eqNullSafe(s[f"_{i}{c}"]) for c in cols]), "left").drop(*(f"_{i}{c}" for c in cols))
    whole = fitted.where(F.col("_level") == len(levels)).select(F.col("sigma").alias("_s"))  # one row
    out = out.join(F.broadcast(whole), F.lit(True), "left")  # without train rows: the floor
    names = [f"_s{i}" for i in reversed(range(len(levels)))]
    return out.withColumn("sigma", F.coalesce(*names, "_s", F.lit(floor))).drop(*names, "_s").withColumn("z", F.col("resid") / F.col("sigma"))


def sigma_sql(name: str, cols: list[str], floor: float = 0.2) -> str:
    """The same sigma table over the train rows t, in SQL."""
    by = ", ".join(cols)
    key, group = (f"{by}, ", f" GROUP BY {by}") if cols else ("", "")
    on = " AND ".join(f"t.{c} IS NOT DISTINCT FROM m.{c}" for c in cols) or "true"
    of = ", ".join(f"t.{c}" for c in cols)
    out = f"{of}, " if cols else ""
    return f"""{name} AS (SELECT {out}count(resid) AS n, round(greatest(CASE WHEN quantile_cont(abs(resid - med), 0.5) > 0 THEN 1.4826 * quantile_cont(abs(resid - med), 0.5) ELSE stddev_pop(resid) END, {floor}), 6) AS sigma
  FROM t JOIN (SELECT {key}quantile_cont(resid, 0.5) AS med FROM t{group}) m ON {on}{" GROUP BY " + of if cols else ""})"""


def matched_frontier(df: DataFrame, flags: list[str]) -> DataFrame:
    """Per flag: the score threshold that keeps, on valid rows, the share that the flag keeps, and
    what it keeps of the test rows. The quantile is exact and interpolated (ranks.running)."""
    valid = df.where("split = 'valid'")
    share = valid.agg(*(F.avg((F.coalesce(F.col(c), F.lit(0)) == 0).cast("int")).alias(c) for c in flags))
    share = share.unpivot([], flags, "level", "target")
    g = valid.where("p IS NOT NULL").groupBy(F.lit(1).alias("_one"), "p").agg(F.count("*").alias("n"))
    all_rows = g.agg(F.sum("n").alias("all"))  # one row
    at = running(g, ["_one"], "p", {"upto": "n"}).join(F.broadcast(all_rows)).join(F.broadcast(share)).withColumn("pos", F.col("target") * (F.col("all") - 1))  # a row a flag
    value = lambda k: F.min(F.when(F.col("upto") > k, F.col("p")))
    cut = at.groupBy("level", "target", "pos").agg(value(F.floor("pos")).alias("a"), value(F.ceil("pos")).alias("b"))
    cut = cut.select("level", "target", F.round(F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos")), 6).alias("threshold"))
    kept = F.col("p") <= F.col("threshold")
    out = df.where("split = 'test'").join(F.broadcast(cut)).groupBy("level", "target", "threshold")
    return out.agg(F.count_if(kept).alias("n_kept"), F.round(F.avg(F.when(kept, F.abs("resid"))), 6).alias("mae_kept")).withColumn("target", F.round("target", 6))
