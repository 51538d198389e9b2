"""The surroundings that a target's sources see: their values as of each hour, weighed and compared
with the target's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import asof

KEYS = ["date", "station_id"]


def source_values(keys: DataFrame, pairs: DataFrame, env: DataFrame, value: str, hours: float = 3, direction: str = "nearest") -> DataFrame:
    """date, source_id, value, age_h: each source's value as of every hour that one of its targets asks
    for. Only the hours and sources that meet in a pair are looked up, no grid of all of them."""
    wanted = keys.select("date", "station_id").join(pairs.select("station_id", "source_id"), "station_id").select("date", F.col("source_id").alias("station_id")).distinct()
    known = env.where(F.col(value).isNotNull()).select("date", "station_id", value)
    return asof(wanted, known, value, direction, hours).select("date", F.col("station_id").alias("source_id"), value, "age_h")


def local_environment(keys: DataFrame, pairs: DataFrame, env: DataFrame, value: str, prefix: str, hours: float = 3, direction: str = "nearest", k: int | None = None) -> DataFrame:
    """A row per distinct key (date, station_id) with what its sources have; ``k`` takes the nearest ones.

    {prefix}_n values; their mean, median, std, min, max and range; weight, the sum of the weights of
    sources with a value, and idw, their weighted mean; mean_km and min_km of all sources, with a value
    or not; the nearest value with its rank and km; mean, median, weighted and nearest age in hours. A
    target without sources, or whose sources have no value, has n = 0 and nulls.

    Keys meet the few sources of their station and then one value each; a group is one target's hour."""
    keys, near = keys.select(*KEYS).distinct(), pairs.select("station_id", "source_id", "rank", "km", "weight")
    near = near.where(F.col("rank") <= k) if k is not None else near
    met = keys.join(near, "station_id").join(source_values(keys, near, env, value, hours, direction), ["date", "source_id"], "left")
    v, age, w = F.col(value), F.col("age_h"), F.col("weight")
    some = v.isNotNull()
    weighted = lambda x: F.try_divide(F.sum(F.when(some & x.isNotNull(), w * x)), F.sum(F.when(some & x.isNotNull(), w)))
    nearest = lambda x: F.min_by(x, F.when(some, F.struct("rank", "km", "source_id")))
    aged = F.when(some, age)
    out = {
        "n": F.count(v), "mean": F.avg(v), "median": F.percentile(v, F.lit(0.5)), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v), "range": F.max(v) - F.min(v),
        "weight": F.coalesce(F.sum(F.when(some, w)), F.lit(0.0)), "idw": weighted(v), "mean_km": F.avg("km"), "min_km": F.min("km"),
        "nearest": nearest(v), "nearest_rank": nearest(F.col("rank")), "nearest_km": nearest(F.col("km")),
        "age_mean": F.avg(aged), "age_median": F.percentile(aged, F.lit(0.5)), "age_idw": weighted(age), "age_nearest": nearest(age),
    }
    found = met.groupBy(*KEYS).agg(*(c.alias(f"{prefix}_{n}") for n, c in out.items()))
    return keys.join(found, KEYS, "left").withColumn(f"{prefix}_n", F.coalesce(f"{prefix}_n", F.lit(0)))


def differences(df: DataFrame, own: str, prefix: str) -> DataFrame:
    """How far the target's own value is from its sources' weighted mean and from the nearest one."""
    out: dict[str, Column] = {}
    for other in ("idw", "nearest"):
        d = F.col(own) - F.col(f"{prefix}_{other}")
        out |= {f"{own}_minus_{prefix}_{other}": d, f"{own}_minus_{prefix}_{other}_abs": F.abs(d)}
    return df.withColumns(out)
