"""How far results depend on stations: block bootstraps, repeated station holdouts, shifts, tails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluation import split_stations

DRAWS, SEED = 500, "2026"


def log_loss(df: DataFrame, least: float = 1e-6) -> DataFrame:
    """Mean negative log likelihood by split, of scores clipped at both ends; null with one class."""
    p = F.least(F.greatest(F.col("p").cast("double"), F.lit(least)), F.lit(1 - least))
    loss = -F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return df.where("p IS NOT NULL AND y IS NOT NULL").groupBy("split").agg(F.when(F.countDistinct("y") > 1, F.round(F.avg(loss), 6)).alias("log_loss"))


def with_block(df: DataFrame, unit: str = "station", name: str = "block") -> DataFrame:
    """The rows with the block that they are drawn by: their network's station, or that on one day."""
    day = {"station": [], "station_day": [F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("NaT"))]}
    if unit not in day:
        raise ValueError(f"unit {unit}: station or station_day")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Missing"))
    return df.withColumn(name, F.concat_ws("::", part("network"), part("station_id"), *day[unit]))


def drawn(blocks: DataFrame, draws: int = DRAWS, seed: str = SEED) -> DataFrame:
    """blocks: distinct ``block``. b, block, w: how often each draw (with replacement, as many as there
    are) has each block."""
    numbered, slots = _numbered(blocks, draws, seed)
    return slots.groupBy("b", "i").agg(F.count("*").alias("w")).join(numbered, "i").select("b", "block", "w")


def drawn_sums(blocks: DataFrame, sums: DataFrame, by: list[str], cols: list[str], draws: int = DRAWS, seed: str = SEED) -> DataFrame:
    """b, by, ``cols``: the sums of each draw over the blocks that it has, as often as it has them. A draw's
    pick goes to its block once, past a hash table of the blocks' own sums, and is added up at once: no task
    sorts or counts picks, and what is exchanged after is a row a draw and group."""
    numbered, slots = _numbered(blocks, draws, seed)
    own = numbered.join(sums.withColumnRenamed("block", "_own_block"), F.col("block").eqNullSafe(F.col("_own_block"))).select("i", *by, *cols)
    return slots.join(own.hint("shuffle_hash"), "i").groupBy("b", *by).agg(*(F.sum(c).alias(c) for c in cols))


def _numbered(blocks: DataFrame, draws: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The blocks with a number i each, and the picks: b, i. Blocks are numbered by their hash: within the
    4,096 ranges of its first digits, behind the counts of the ranges before, so that no task sees them all."""
    hashed = blocks.withColumn("_h", F.md5(F.coalesce("block", F.lit("")).cast("binary"))).withColumn("_range", F.substring("_h", 1, 3))
    before = hashed.groupBy("_range").agg(F.count("*").alias("_n"))  # 4,096 rows at most
    before = before.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_h", "block")) - 1
    numbered = hashed.withColumn("_inside", inside).join(F.broadcast(before), "_range").select(*blocks.columns, (F.col("_before") + F.col("_inside")).alias("i"))
    size = blocks.agg(F.count("*").alias("m"))  # one row
    slots = numbered.select(F.col("i").alias("slot")).join(F.broadcast(size)).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "b", "slot").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("m")
    return numbered, slots.select("b", pick.alias("i"))


def bootstrap_metrics(df: DataFrame, block: str, group: str, draws: int = DRAWS, seed: str = SEED) -> DataFrame:
    """Bounds of n share, MAE, RMSE and bias of each group, over draws of blocks. The rows are read once,
    for sums of block and group."""
    df = df.where("resid IS NOT NULL").withColumn("block", F.col(block).cast("string"))
    r = F.col("resid")
    sums = df.groupBy("block", group).agg(F.count("*").alias("n"), F.sum(F.abs(r)).alias("a"), F.sum(r * r).alias("q"), F.sum(r).alias("s"))
    part = drawn_sums(sums.select("block").distinct(), sums, [group], [*"naqs"], draws, seed)
    part = part.withColumn("all", F.sum("n").over(W.partitionBy("b")))
    m = {"share": F.col("n") / F.col("all"), "mae": F.col("a") / F.col("n"), "rmse": F.sqrt(F.col("q") / F.col("n")), "bias": F.col("s") / F.col("n")}
    part = part.withColumns(m)
    at = {"low": 0.025, "mid": 0.5, "high": 0.975}
    return part.groupBy(group).agg(F.count("*").alias("draws"), *(F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_{k}") for c in m for k, q in at.items()))


def exploded_policies(df: DataFrame, rules: dict) -> DataFrame:
    """A row for each policy that keeps a row."""
    names = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("policy", F.explode(names))


def bootstrap_policies(df: DataFrame, rules: dict, draws: int = DRAWS, seed: str = SEED) -> DataFrame:
    """Bounds of retention and MAE of each policy over draws of stations."""
    df = df.where("resid IS NOT NULL").withColumn("block", F.col("station_id").cast("string"))
    whole = df.groupBy("block").agg(F.count("*").alias("m"))
    kept = exploded_policies(df, rules).groupBy("block", "policy").agg(F.count("*").alias("n"), F.sum(F.abs("resid")).alias("a"))
    # All rows of a block are a policy without a name: one look at the draws gives both sums.
    sums = kept.unionByName(whole.select("block", F.lit(None).cast("string").alias("policy"), F.col("m").alias("n"), F.lit(0.0).alias("a")))
    part = drawn_sums(whole.select("block"), sums, ["policy"], ["n", "a"], draws, seed)
    total = part.where("policy IS NULL").select("b", F.col("n").alias("m"))  # a row a draw
    part = part.where("policy IS NOT NULL").join(F.broadcast(total), "b")
    part = part.withColumns({"retention": F.col("n") / F.col("m"), "mae": F.col("a") / F.col("n")})
    at = {"low": 0.025, "mid": 0.5, "high": 0.975}
    return part.groupBy("policy").agg(F.count("*").alias("draws"), *(F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_{k}") for c in ("retention", "mae") for k, q in at.items()))


def holdout_runs(df: DataFrame, seeds: list[str]) -> DataFrame:
    """Per seed, on the test stations of its split: rows, MAE, RMSE, bias and share over 2. One pass
    over the rows, for sums of stations."""
    r = F.col("resid")
    sums = df.where("resid IS NOT NULL").groupBy("station_id").agg(F.count("*").alias("n"), F.sum(F.abs(r)).alias("a"), F.sum(r * r).alias("q"), F.sum(r).alias("s"), F.count_if(F.abs(r) > 2).alias("o"))
    runs = None
    for seed in seeds:
        test = split_stations(sums, seed).where("part = 'test'").select("station_id", F.lit(seed).alias("seed"))
        runs = test if runs is None else runs.unionByName(test)
    g = runs.join(sums, "station_id").groupBy("seed").agg(F.count("*").alias("stations"), *(F.sum(c).alias(c) for c in "naqso"))
    return g.select("seed", "stations", "n", (F.col("a") / F.col("n")).alias("mae"), F.sqrt(F.col("q") / F.col("n")).alias("rmse"), (F.col("s") / F.col("n")).alias("bias"), (F.col("o") / F.col("n")).alias("over_2"))


def holdout_summary(runs: DataFrame) -> DataFrame:
    """Mean, deviation (null of one run), least and greatest of each metric over the runs."""
    long = runs.unpivot("seed", ["mae", "rmse", "bias", "over_2"], "metric", "value")
    return long.groupBy("metric").agg(F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


def holdout_comparison(df: DataFrame, seeds: list[str]) -> DataFrame:
    """Per metric: the mean over held-out stations against that over all rows."""
    r = F.col("resid")
    whole = df.where("resid IS NOT NULL").agg(F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(r).alias("bias"), F.avg((F.abs(r) > 2).cast("double")).alias("over_2"))
    every = whole.unpivot([], ["mae", "rmse", "bias", "over_2"], "metric", "whole")  # a row a metric
    return holdout_summary(holdout_runs(df, seeds)).join(F.broadcast(every), "metric").select("metric", "mean", F.round("whole", 6).alias("whole"), F.round(F.col("mean") - F.col("whole"), 5).alias("change"))


def shift_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column and split: values, mean, deviation, and the mean's distance to the train rows' in
    units of theirs. One pass."""
    stats = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")
    g = df.select("split", stats).select("split", "s.*").groupBy("column", "split").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    of_train = lambda c: F.max(F.when(F.col("split") == "train", F.col(c))).over(W.partitionBy("column"))
    distance = F.try_divide(F.col("mean") - of_train("mean"), F.nullif(of_train("std"), F.lit(0.0)))
    return g.select("column", "split", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(distance, 6).alias("shift"))


def tail_audit(df: DataFrame, columns: list[str], least: int = 500, top: int = 100) -> DataFrame:
    """The groups with the largest mean absolute residual, of ``least`` rows at least, over several
    groupings in one pass. The limit is the report's length."""
    cols = [f"CAST(`{c}` AS STRING)" for c in columns]
    named = df.select(*(F.expr(x).alias(f"_{c}") for x, c in zip(cols, columns, strict=True)), "resid")
    keys = [f"_{c}" for c in columns]
    g = named.groupingSets([[F.col(k)] for k in keys], *map(F.col, keys)).agg(F.grouping_id(*keys).alias("_g"), F.count("resid").alias("n"), F.avg(F.abs("resid")).alias("mae"))
    n = len(columns)
    which = F.element_at(F.array(*map(F.lit, columns)), F.lit(0) + sum((F.when(F.col("_g") == (1 << n) - 1 - (1 << (n - 1 - i)), i + 1).otherwise(0) for i in range(n)), F.lit(0)))
    out = g.select(which.alias("column"), F.coalesce(*keys).alias("value"), "n", F.round("mae", 6).alias("mae")).where(F.col("n") >= least)
    return out.orderBy(F.desc("mae"), "column", "value").limit(top)


def proxy_metrics(df: DataFrame, rules: dict) -> DataFrame:
    """Per policy, over rows with a label: a row that it removes counts as a positive. Denominators are
    1 at least."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), (~F.coalesce(c, F.lit(False))).alias("out")) for n, c in rules.items()))).alias("r")
    y = F.col("y") == 1
    g = df.where("y IS NOT NULL").select("y", each).select("y", "r.*").groupBy("policy").agg(F.count_if(F.col("out") & y).alias("tp"), F.count_if(F.col("out") & ~y).alias("fp"), F.count_if(~F.col("out") & y).alias("fn"), F.count_if(~F.col("out") & ~y).alias("tn"))
    one = F.lit(1)
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)
    return g.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(2 * p * r / F.greatest(p + r, F.lit(1e-12)), 6)})


def coverage(df: DataFrame, category: str, corrected: list[str]) -> DataFrame:
    """Rows, rows with a residual, and how many of them a correction reaches, by category."""
    hit = F.col(category).isin(*corrected)
    return df.groupBy(category).agg(F.count("*").alias("n"), F.count("resid").alias("n_resid"), F.count_if(hit & F.col("resid").isNotNull()).alias("n_corrected"), F.round(F.avg((hit & F.col("resid").isNotNull()).cast("double")), 6).alias("share"))


def block_holdout(blocks: DataFrame, seed: str = "42", share: float = 0.2) -> DataFrame:
    """station_id, lat_block, long_block, part: whole spatial blocks to test, by the order of a hash."""
    b = blocks.select("lat_block", "long_block").distinct()
    place = F.row_number().over(W.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "lat_block", "long_block").cast("binary")), "lat_block", "long_block"))
    b = b.select("lat_block", "long_block", (place <= F.ceil(F.count("*").over(W.partitionBy()) * share)).alias("_test"))
    return blocks.join(F.broadcast(b), ["lat_block", "long_block"]).select("station_id", "lat_block", "long_block", F.when(F.col("_test"), "test").otherwise("train").alias("part"))
