"""Quality tests of single stations and of groups, on long observations (date, station_id, temp)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["station_id", "network"]


def series(*more):
    return W.partitionBy(*KEY).orderBy("date", *more)


def limit_test(obs: DataFrame, low: float = -40, high: float = 60) -> DataFrame:
    """Values outside the open interval become null."""
    return obs.withColumn("temp", F.when((F.col("temp") > low) & (F.col("temp") < high), F.col("temp")))


def slope_test(obs: DataFrame, limit: float = 20) -> DataFrame:
    """A value goes if it is ``limit`` or more away from the row before; without one it stays."""
    d = F.abs(F.col("temp") - F.lag("temp").over(series()))
    return obs.withColumn("temp", F.when(d.isNull() | (d < limit), F.col("temp")))


def densify(obs: DataFrame) -> DataFrame:
    """All dates of the table for each station; dates and stations come from its own distinct rows."""
    grid = obs.select("date").distinct().join(obs.select(*KEY).distinct())
    return grid.join(obs, ["date", *KEY], "left")


def consistency_test(obs: DataFrame, step: float = 0.005, hours: int = 6) -> DataFrame:
    """Seven rows go where six steps in a row are null or under ``step``; from the seventh row on."""
    d = F.abs(F.col("temp") - F.lag("temp").over(series()))
    obs = obs.withColumn("_flat", F.coalesce(d < step, F.lit(True)).cast("int"))
    obs = obs.withColumn("_hit", ((F.sum("_flat").over(series().rowsBetween(1 - hours, 0)) == hours) & (F.row_number().over(series()) > hours)).cast("int"))
    hit = F.max("_hit").over(series().rowsBetween(0, hours))
    return obs.withColumn("temp", F.when(hit == 0, F.col("temp"))).drop("_flat", "_hit")


def z_score_test(obs: DataFrame, least: int = 5, bound: float = 1.2815515655446004) -> DataFrame:
    """Across stations at each hour: fewer than ``least`` values, or a z (population) beyond the bound: null."""
    at = W.partitionBy("date")
    z = F.try_divide(F.col("temp") - F.avg("temp").over(at), F.stddev_pop("temp").over(at))
    return obs.withColumn("temp", F.when((F.count("temp").over(at) >= least) & (F.abs(z) < bound), F.col("temp")))


def month_correlation(obs: DataFrame, least: float = 0.9) -> DataFrame:
    """Correlation of each station with the median of all, by month number; null is kept."""
    med = obs.groupBy("date").agg(F.percentile("temp", F.lit(0.5)).alias("median"))
    g = obs.join(med, "date").groupBy(*KEY, F.month("date").alias("month")).agg(F.corr("temp", "median").alias("r"))
    return g.withColumn("dropped", F.coalesce(F.abs("r") < least, F.lit(False)))


def gap_islands(obs: DataFrame) -> DataFrame:
    """Runs of null or of values: station, run, first, last, rows."""
    n = F.row_number().over(series()) - F.row_number().over(W.partitionBy(*KEY, F.col("temp").isNull()).orderBy("date"))
    return obs.select("*", n.alias("_run"), F.col("temp").isNull().alias("gap")).groupBy(*KEY, "gap", "_run").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n_rows")).drop("_run")


def duplicate_stations(meta: DataFrame, cols: list[str]) -> DataFrame:
    """Metadata faults: a missing key, equal coordinates, a repeated row."""
    w = W.partitionBy(*cols).orderBy(*cols)
    return meta.withColumns({"missing": F.expr(" OR ".join(f"`{c}` IS NULL" for c in cols)), "same": F.coalesce(F.col("lat") == F.col("long"), F.lit(False)), "again": F.row_number().over(w) > 1})


def elevation_correction(obs: DataFrame, meta: DataFrame, lapse: float = 0.0065) -> DataFrame:
    mean = meta.agg(F.avg("elev").alias("_mean"))
    return obs.join(meta.select("station_id", "elev"), "station_id", "left").join(F.broadcast(mean)).withColumn("temp", F.col("temp") + F.coalesce((F.col("elev") - F.col("_mean")) * lapse, F.lit(0.0))).drop("_mean", "elev")
