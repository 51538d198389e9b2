"""Relational operators on station tables: checked joins, lookups, bins, shares, samples and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.panels import station_id
from . import fusion as fu
from .features import asof
from .qc import KEY, series

# What is done with each category.
ACTIONS = {
    fu.MISSING: "exclude_missing",
    fu.CONSISTENT: "use_as_is",
    fu.VALID: "use_as_is_or_light_downweight",
    fu.RESCUE: "rescue_use_with_caution",
    fu.SYSTEMIC: "bias_correct_then_use",
    fu.RADIATION: "context_bias_correct_or_downweight",
    fu.CAUTION: "preserve_or_downweight",
    fu.ENVIRONMENT: "preserve_for_microclimate_analysis",
    fu.LIMITED: "review_reference_support_or_downweight",
    fu.CONFIRMED: "exclude_transient_error",
    fu.MISSED: "exclude_or_manual_review",
    fu.REVIEW: "manual_review_or_downweight",
}


def action(category: Column) -> Column:
    pairs = [F.lit(x) for kv in ACTIONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), category)


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table, or an error if two rows share a key (nulls are a key)."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"rows share the key {[twice[0][k] for k in keys]} of {keys}")
    return df


def left_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of many to one, with ``right`` checked to have one row a key."""
    return left.join(unique(right, keys), keys, "left")


def levels(strict: DataFrame, lenient: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer one-to-one join of two flag tables (keys, flag); a side that lacks a row has null."""
    return unique(strict, keys).withColumnRenamed("flag", "strict").join(unique(lenient, keys).withColumnRenamed("flag", "lenient"), keys, "full")


def weak_labels(strict: DataFrame, lenient: DataFrame, keys: list[str]) -> DataFrame:
    """Inner one-to-one join of the levels: 1 if both flag, 0 if neither does, else null. A flag that
    is not 0 or 1 is an error. Both sides meet in one count by key, so no task sorts or holds two tables."""
    both = None
    for side, own in (("strict", strict), ("lenient", lenient)):
        part = own.withColumns({c: F.col("flag") if c == side else F.lit(None) for c in ("strict", "lenient")} | {f"_n_{c}": F.lit(int(c == side)) for c in ("strict", "lenient")}).select(*keys, "strict", "lenient", "_n_strict", "_n_lenient")
        both = part if both is None else both.unionByName(part)
    n = [F.sum(f"_n_{c}").alias(f"_n_{c}") for c in ("strict", "lenient")]
    both = both.groupBy(*keys).agg(F.max("strict").alias("strict"), F.max("lenient").alias("lenient"), *n)
    if twice := both.where("_n_strict > 1 OR _n_lenient > 1").limit(1).collect():
        raise ValueError(f"rows share the key {[twice[0][k] for k in keys]} of {keys}")
    both = both.where("_n_strict = 1 AND _n_lenient = 1").where(F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x)).drop("_n_strict", "_n_lenient")
    ok = lambda c: F.when(F.col(c).isin(0, 1), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c}: not a flag: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("int"))
    s, n = ok("strict"), ok("lenient")
    return both.withColumn("label", F.when((s == 1) & (n == 1), 1).when((s == 0) & (n == 0), 0))


def interval_lookup(df: DataFrame, bins: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """Columns of the bin [lo, hi) that holds the value; the last bin holds its end too. bins: lo, hi,
    without overlaps; a few rows, checked, so they go with the tasks."""
    rows = bins.select("lo", "hi", *columns).orderBy("lo").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("interval_lookup: over 10,000 bins")
    b = df.sparkSession.createDataFrame(rows, bins.select("lo", "hi", *columns).schema)
    last = max((r["hi"] for r in rows), default=None)
    b = b.withColumn("_last", F.col("hi") == F.lit(last))
    on = (df[value] >= b["lo"]) & ((df[value] < b["hi"]) | (b["_last"] & (df[value] == b["hi"])))
    return df.join(F.broadcast(b), on, "left").drop("lo", "hi", "_last")


def rolling_median(obs: DataFrame, sizes=(3, 6, 24)) -> DataFrame:
    """Median of the rows before, where at least half (2 at least) are there."""
    out = {}
    for k in sizes:
        w = series().rowsBetween(-k, -1)
        out[f"median{k}"] = F.when(F.count("temp").over(w) >= max(2, -(-k // 2)), F.round(F.percentile("temp", F.lit(0.5)).over(w), 6))
    return obs.withColumns(out)


def backward_fill(obs: DataFrame) -> DataFrame:
    return obs.withColumn("filled", F.first("temp", ignorenulls=True).over(series().rowsBetween(0, W.unboundedFollowing)))


def fill_chain(obs: DataFrame, source: DataFrame, hours: float = 3) -> DataFrame:
    """A source's value at the date, else the nearest within ``hours``, else the station's median of
    month and hour, else the network's; and which of them it was."""
    rows = asof(obs.select("date", *KEY), source, "near", "nearest", hours).select("date", *KEY, "near", "age_h")
    clock = [F.month("date").alias("_m"), F.hour("date").alias("_h")]
    s = source.select("station_id", *clock, "near")
    own = s.groupBy("station_id", "_m", "_h").agg(F.percentile("near", F.lit(0.5)).alias("_own"))
    net = s.groupBy("_m", "_h").agg(F.percentile("near", F.lit(0.5)).alias("_net"))  # at most 288 rows
    rows = rows.withColumns({"_m": F.month("date"), "_h": F.hour("date")}).join(own, ["station_id", "_m", "_h"], "left").join(F.broadcast(net), ["_m", "_h"], "left")
    how = F.when(F.col("age_h") == 0, "exact").when(F.col("near").isNotNull(), "near").when(F.col("_own").isNotNull(), "station").when(F.col("_net").isNotNull(), "network").otherwise("none")
    return rows.select("date", *KEY, F.round(F.coalesce("near", "_own", "_net"), 6).alias("value"), how.alias("how"))


def r_squared(df: DataFrame, by: list[str], y: str, f: str, least: int = 2) -> DataFrame:
    """1 - residual over total sum of squares of rows that have both; null with fewer than ``least``
    rows or where y does not vary."""
    ok = df.where(F.col(y).isNotNull() & F.col(f).isNotNull())
    d = F.col(y) - F.col(f)
    g = ok.groupBy(*by).agg(F.count("*").alias("n"), F.sum(d * d).alias("_res"), (F.var_pop(y) * F.count("*")).alias("_tot"))
    return g.select(*by, "n", F.when((F.col("n") >= least) & (F.col("_tot") > 0), F.round(1 - F.col("_res") / F.col("_tot"), 6)).alias("r2"))


def modes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value, of ties the least; distinct values, counted and joined."""
    return df.groupBy(*by).agg(F.expr(f"mode() WITHIN GROUP (ORDER BY {value})").alias("mode"), F.countDistinct(value).alias("n_values"), F.concat_ws("|", F.array_sort(F.collect_set(value))).alias("all_values"))


def samples(df: DataFrame, by: str, keys: list[str], n: int, seed: str = "42") -> DataFrame:
    """``n`` rows of each group, the first by a hash of their key: the feature is the sample. Rows that are
    equal count once. Groups may be large but are few: the rows are read twice. The first reading takes the
    least and the greatest hash of each of 4,096 ranges of it: a range with rows has one hash at least, and
    two if these differ, so the first ranges that have ``n`` so counted hold the sample. Only rows of these
    are exchanged in the second."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *keys).cast("binary"))
    df = df.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 3))
    found = df.groupBy(by, "_range").agg((1 + (F.min("_h") != F.max("_h")).cast("int")).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    last = found.withColumn("_upto", F.coalesce(upto, F.lit(0))).where(F.col("_upto") < n).groupBy(by).agg(F.max("_range").alias("_last"))
    last = last.withColumnRenamed(by, "_by")  # a row a group
    df = df.join(F.broadcast(last), df[by].eqNullSafe(last["_by"]) & (df["_range"] <= last["_last"])).drop("_by", "_last", "_range").distinct()
    return df.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy("_h", *keys))).where(F.col("_i") <= n).drop("_i", "_h")


def pivot_counts(df: DataFrame, row: str, column: str, names: list[str]) -> DataFrame:
    """Counts of the named values, a column each, 0 where there is none."""
    return df.groupBy(row).pivot(column, names).agg(F.count(F.lit(1))).fillna(0, names)


def truncated(obs: DataFrame, start: str, end: str) -> DataFrame:
    """Dates from start to end, both included."""
    return obs.where(F.col("date").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def ranked(df: DataFrame, by: str, value: str) -> DataFrame:
    """Dense rank, the greatest first."""
    return df.withColumn("rank", F.dense_rank().over(W.partitionBy(by).orderBy(F.desc_nulls_last(value))))


def named_ids(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, station_id(F.col(column)))
