"""Metrics, calibration, policies, fusion and bootstrap on scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import attach, quantiles, running


def weak_label(strict: str, lenient: str):
    s, n = F.col(strict), F.col(lenient)
    return F.when((s == 1) & (n == 1), 1).when((s == 0) & (n == 0), 0)


def reliability(df: DataFrame, bins: int = 15) -> DataFrame:
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy("split", b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("event_rate"))


def ece(df: DataFrame, bins: int = 15) -> DataFrame:
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy("split", b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    return g.groupBy("split").agg(F.round(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n"), 6).alias("ece"))


def curve(df: DataFrame) -> DataFrame:
    """Cumulative counts by descending score, over counts per distinct score; the running sums are
    dealt out over the cluster (ranks.running)."""
    g = df.groupBy("split", "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    total = g.groupBy("split").agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all"))
    return attach(running(g, ["split"], "p", {"tp": "pos", "seen": "n"}, descending=True), total, ["split"])


def areas(df: DataFrame) -> DataFrame:
    """auroc and auprc by split, from one curve."""
    neg, above = F.col("n") - F.col("pos"), F.col("tp") - F.col("pos")
    area = F.sum(neg * (above + F.col("pos") / 2))
    roc = F.round(F.try_divide(area, F.max("all_pos") * (F.max("all") - F.max("all_pos"))), 6)
    prc = F.round(F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * F.col("tp") / F.col("seen")), 6)
    return curve(df).groupBy("split").agg(roc.alias("auroc"), prc.alias("auprc"))


def auroc(df: DataFrame) -> DataFrame:
    return areas(df).select("split", "auroc")


def auprc(df: DataFrame) -> DataFrame:
    return areas(df).select("split", "auprc")


def best_f1(df: DataFrame) -> DataFrame:
    """The score threshold with the best F1, by split."""
    c = curve(df).withColumn("f1", F.round(2 * F.col("tp") / (F.col("seen") + F.col("all_pos")), 9))
    return c.groupBy("split").agg(F.max_by("p", F.struct(F.col("f1"), -F.col("p"))).alias("threshold"), F.round(F.max("f1"), 6).alias("f1"))


def f1_on_validation(df: DataFrame) -> DataFrame:
    """The threshold fitted on valid rows only, and precision, recall and F1 that it gives in each
    split. Denominators are 1 at least."""
    fit = best_f1(df.where("split = 'valid'")).select("threshold")  # one row
    hit, y = F.col("p") >= F.col("threshold"), F.col("y") == 1
    g = df.join(F.broadcast(fit)).groupBy("split", "threshold").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    one = F.lit(1)
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)
    return g.select("split", "threshold", "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(2 * precision * recall / (precision + recall + 1e-12), 6).alias("f1"))


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    return df.groupBy("split").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))


def retention(df: DataFrame, shares: list[float]) -> DataFrame:
    """Residuals of what is kept under the score's quantiles, by split."""
    cut = quantiles(df, ["split"], "p", {f"q{i}": q for i, q in enumerate(shares)})
    cut = cut.select("split", F.posexplode(F.array(*(F.col(f"q{i}") for i in range(len(shares))))).alias("step", "cutoff")).withColumn("cutoff", F.round("cutoff", 6))
    # A row a split and share. Each row goes to the least step that keeps it; steps are then added up.
    first = attach(df, cut.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("step", "cutoff"))).alias("_cuts")), ["split"])
    first = first.withColumn("_from", F.size(F.filter("_cuts", lambda x: x["cutoff"] < F.col("p")))).where(F.col("_from") < len(shares))
    a = F.abs("resid")
    part = first.groupBy("split", F.col("_from").alias("step")).agg(F.count("*").alias("n"), F.count("resid").alias("_m"), F.sum(a).alias("_a"), F.sum(F.col("resid") * F.col("resid")).alias("_q"), F.sum("resid").alias("_s"))
    upto = W.partitionBy("split").orderBy("step")  # a row a step
    every = cut.select("split", "step").join(part, ["split", "step"], "left").withColumns({c: F.sum(c).over(upto) for c in ("n", "_m", "_a", "_q", "_s")})
    mean = lambda c: F.try_divide(F.col(c), F.col("_m"))
    return every.where("n > 0").select("split", "step", "n", F.round(mean("_a"), 6).alias("mae"), F.round(F.sqrt(mean("_q")), 6).alias("rmse"), F.round(mean("_s"), 6).alias("bias"))


def station_bias(df: DataFrame, least: int = 24) -> DataFrame:
    """Per station on train rows; with fewer than ``least`` rows the count only."""
    ok = F.count("*") >= least
    r = F.col("resid")
    slope = F.regr_slope(r, F.col("p"))
    return df.where("split = 'train'").groupBy("station_id").agg(F.count("*").alias("n"), F.when(ok, F.round(F.percentile(r, F.lit(0.5)), 6)).alias("median"), F.when(ok, F.round(F.percentile(r, F.lit(0.75)) - F.percentile(r, F.lit(0.25)), 6)).alias("iqr"), F.when(ok, F.round(F.avg((F.abs(r) > 2).cast("int")), 6)).alias("large_share"), F.when(ok, F.round(slope, 5)).alias("slope"))


def policies(df: DataFrame, rules: dict) -> DataFrame:
    """Rows may pass several rules: one pass over the data, one row a rule."""
    named = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    g = df.withColumn("policy", F.explode(named)).groupBy("policy").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("resid")), 6).alias("mae"))
    return g.join(F.broadcast(df.agg(F.count("*").alias("_all")))).select("policy", "n", "mae", F.round(F.col("n") / F.col("_all"), 6).alias("retention"))


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    g = df.where(F.col(col).isNotNull()).groupBy(row, col).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(row)), 6))


def dominance(df: DataFrame, tops: list[int]) -> DataFrame:
    """Share of the sum of absolute residuals that the k stations with the largest contribution hold.
    A contribution is MAE times n: the mean is over residuals, n counts all rows."""
    g = df.groupBy("station_id").agg((F.avg(F.abs("resid")) * F.count("*")).alias("c"))
    g = g.withColumns({"_r": F.row_number().over(W.orderBy(F.desc_nulls_last(F.round("c", 6)), "station_id")), "_all": F.sum("c").over(W.partitionBy())})
    return g.withColumn("k", F.explode(F.array(*map(F.lit, tops)))).where("_r <= k").groupBy("k").agg(F.round(F.sum("c"), 4).alias("top"), F.round(F.sum("c") / F.max("_all"), 6).alias("share"))


def bootstrap(df: DataFrame, draws: int = 500, seed: str = "2026") -> DataFrame:
    """Stations drawn with replacement; additive sums of blocks, so the rows are read once."""
    blocks = df.groupBy("station_id").agg(F.count("*").alias("n"), F.sum(F.abs("resid")).alias("s"))
    blocks = blocks.withColumn("i", F.row_number().over(W.orderBy("station_id")) - 1)
    size = blocks.agg(F.count("*").alias("m"))
    slots = blocks.select(F.col("i").alias("slot")).join(F.broadcast(size)).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "b", "slot").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("m")
    d = slots.withColumn("i", pick).join(blocks, "i").groupBy("b").agg((F.sum("s") / F.sum("n")).alias("mae"))
    return d.agg(*(F.round(F.percentile("mae", F.lit(q)), 6).alias(n) for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))))


def split_stations(df: DataFrame, seed: str = "42", test: float = 0.15, valid: float = 0.15) -> DataFrame:
    """Whole stations to test, valid and train, by the order of a hash."""
    s = df.select("station_id").distinct()
    r = F.row_number().over(W.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "station_id").cast("binary")), "station_id"))
    n = F.count("*").over(W.partitionBy())
    return s.select("station_id", r.alias("_r"), n.alias("_n")).select("station_id", F.when(F.col("_r") <= F.bround(F.col("_n") * test), "test").when(F.col("_r") <= F.bround(F.col("_n") * test) + F.bround(F.col("_n") * valid), "valid").otherwise("train").alias("part"))
