"""What scores keep when they are made to keep as much as the QC flags do, and how far that depends on
the stations: thresholds set on the valid rows, policies judged on the test rows, bounds by draws of
blocks.

Specs (method, level, score, threshold, target, residual; a threshold of null: the score is a flag, and
unflagged rows are kept) are levels x scores x residuals rows, a few dozen: they are gathered into one row
that every row of the data is joined with, and the rows are read once for the sums of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running
from .robust import DRAWS, SEED, drawn_sums

#: Residuals over which (absolutely) the share of rows is told.
OVER = (1, 2, 3)
METRICS = ("retention", "bias", "mae", "rmse", *(f"over_{k}" for k in OVER))
#: Stands for all rows, kept or not, among the methods.
ALL = ""


def _named(columns: list[str]) -> Column:
    return F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))


def _one_by_one(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.select(F.explode(_named(columns)).alias(name, "_v"))


def matched_specs(valid: DataFrame, flags: dict[str, str], scores: dict[str, str], residuals: dict[str, str]) -> DataFrame:
    """flags: level to column; scores: name to column; residuals: suffix to column. For each level the flag
    itself and each score, whose threshold is the exact, interpolated quantile of the valid rows at the
    share that the flag keeps of them (a missing flag keeps); a score without values has no spec."""
    level_of = F.create_map(*(x for level, c in flags.items() for x in (F.lit(c), F.lit(level))))
    kept = _one_by_one(valid, list(flags.values()), "score").groupBy("score").agg(F.avg((F.coalesce("_v", F.lit(0)) == 0).cast("int")).alias("target"))
    kept = kept.withColumn("level", level_of[F.col("score")])
    counts = _one_by_one(valid, list(scores.values()), "score").where("_v IS NOT NULL").groupBy("score", "_v").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("score").agg(F.sum("n").alias("all"))  # a row a score
    targets = kept.agg(F.collect_list(F.struct("level", "target")).alias("_t"))  # one row, an entry a flag
    at = running(counts, ["score"], "_v", {"upto": "n"}).join(F.broadcast(sizes), "score").join(F.broadcast(targets)).withColumn("_t", F.explode("_t"))
    at = at.select("score", "_t.*", "_v", "upto", (F.col("_t.target") * (F.col("all") - 1)).alias("pos"))
    value = lambda k: F.min(F.when(F.col("upto") > k, F.col("_v")))
    cut = at.groupBy("score", "level", "target", "pos").agg(value(F.floor("pos")).alias("a"), value(F.ceil("pos")).alias("b"))
    cut = cut.select("level", "score", "target", F.round(F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos")), 9).alias("threshold"))
    specs = kept.select("level", "score", "target", F.lit(None).cast("double").alias("threshold")).unionByName(cut)
    own = F.create_map(*(x for name, c in scores.items() for x in (F.lit(c), F.lit(name))))
    method = F.when(F.col("threshold").isNull(), F.concat(F.lit("flag_"), "level")).otherwise(F.concat(own[F.col("score")], F.lit("_matched_to_"), "level"))
    return specs.withColumn("_r", F.explode(F.array(*(F.struct(F.lit(s).alias("suffix"), F.lit(c).alias("residual")) for s, c in residuals.items())))).select(
        F.concat(method, F.lit("__"), "_r.suffix").alias("method"), "level", "score", "threshold", "target", "_r.residual"
    )


def policy_sums(df: DataFrame, specs: DataFrame, scores: list[str], residuals: list[str], by: list[str]) -> DataFrame:
    """by, method, n and the sums of the residuals that the method keeps; the method ``ALL`` counts every
    row. ``scores`` and ``residuals`` are the columns that specs may name."""
    one = specs.agg(F.collect_list(F.struct("method", "score", "threshold", "residual")).alias("_specs"))
    rows = df.join(F.broadcast(one)).withColumns({"_scores": _named(scores), "_residuals": _named(residuals)})

    def kept(s: Column) -> Column:
        value = F.col("_scores")[s["score"]]
        keep = F.when(s["threshold"].isNull(), F.coalesce(value, F.lit(0.0)) == 0).otherwise(F.coalesce(value <= s["threshold"], F.lit(False)))
        return keep & F.col("_residuals")[s["residual"]].isNotNull()

    used = F.transform(F.filter("_specs", kept), lambda s: F.struct(s["method"].alias("method"), F.col("_residuals")[s["residual"]].alias("r")))
    every = F.array(F.struct(F.lit(ALL).alias("method"), F.lit(None).cast("double").alias("r")))
    r = F.col("_u.r")
    sums = {"s": r, "a": F.abs(r), "q": r * r} | {f"o{k}": (F.abs(r) > k).cast("long") for k in OVER}
    return rows.withColumn("_u", F.explode(F.concat(every, used))).groupBy(*by, "_u.method").agg(F.count("*").alias("n"), *(F.sum(x).alias(c) for c, x in sums.items()))


SUMS = ("n", "s", "a", "q", *(f"o{k}" for k in OVER))


def _metrics(total: str) -> dict[str, Column]:
    n = F.col("n")
    return {"retention": F.try_divide("n", total), "bias": F.try_divide("s", n), "mae": F.try_divide("a", n), "rmse": F.sqrt(F.try_divide("q", n))} | {f"over_{k}": F.try_divide(f"o{k}", n) for k in OVER}


def frontier(test: DataFrame, specs: DataFrame, scores: list[str], residuals: list[str]) -> DataFrame:
    """The specs with what they keep of the test rows; a spec that keeps none has n 0 and no figures."""
    sums = policy_sums(test, specs, scores, residuals, [])
    whole = sums.agg(F.coalesce(F.max(F.when(F.col("method") == ALL, F.col("n"))), F.lit(0)).alias("n_total"))
    there = test.agg(F.map_from_arrays(F.array(*map(F.lit, scores)), F.array(*(F.avg(F.col(c).isNotNull().cast("int")) for c in scores))).alias("_there"))
    out = specs.join(F.broadcast(sums.where(F.col("method") != ALL)), "method", "left").join(F.broadcast(whole)).join(F.broadcast(there))
    out = out.withColumns({"n": F.coalesce("n", F.lit(0)), "score_there": F.col("_there")[F.col("score")]})
    return out.select(*specs.columns, "score_there", "n_total", F.col("n").alias("n_used"), *(c.alias(m) for m, c in _metrics("n_total").items()))


def bootstrap_frontier(test: DataFrame, specs: DataFrame, scores: list[str], residuals: list[str], block: str = "block", draws: int = DRAWS, seed: str = SEED) -> DataFrame:
    """A row a method that keeps rows: blocks, its figures on all of them, and the bounds of these over draws
    of blocks. Draws that leave a method no row have no figure and do not count in its bounds. Blocks in
    which a method keeps nothing count in its retention. The draws see sums of block and method only."""
    sums = policy_sums(test.withColumn("block", F.col(block).cast("string")), specs, scores, residuals, ["block"])
    blocks = sums.where(F.col("method") == ALL).select("block")
    every = sums.groupBy("method").agg(*(F.sum(c).alias(c) for c in SUMS), F.count("*").alias("n_blocks"))
    picked = drawn_sums(blocks, sums, ["method"], list(SUMS), draws, seed).withColumn("n_blocks", F.lit(None).cast("long"))
    part = picked.unionByName(every.withColumn("b", F.lit(0)))  # draw 0: all blocks once
    whole = part.where(F.col("method") == ALL).select("b", F.col("n").alias("n_total"), "n_blocks")  # a row a draw
    part = part.where(F.col("method") != ALL).drop("n_blocks").join(F.broadcast(whole), "b").withColumns(_metrics("n_total"))
    point = lambda c: F.max(F.when(F.col("b") == 0, F.col(c)))
    of_draws = lambda c, q: F.percentile(F.when(F.col("b") > 0, F.col(c)), F.lit(q))
    at = {"low": 0.025, "mid": 0.5, "high": 0.975}
    bounds = [x for m in METRICS for x in (point(m).alias(m), *(of_draws(m, q).alias(f"{m}_{k}") for k, q in at.items()))]
    return part.groupBy("method").agg(F.count_if(F.col("b") > 0).alias("draws"), point("n_blocks").alias("n_blocks"), point("n_total").alias("n_total"), point("n").alias("n_used"), *bounds)
