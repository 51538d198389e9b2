"""Scans of the given tables, and the station data that stands in from them. Files: panels.py."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark, sf_dir: str) -> DataFrame:
    """Hourly station observations that stand in for station panels: date, station_id, network, temp."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("date"),
        (F.col("user_id") % 10).alias("station_id"),
        F.when(F.col("user_id") % 3 == 0, "ows").otherwise("cws").alias("network"),
    ).agg(F.round(F.avg("value"), 4).alias("temp"))


def stations(spark, sf_dir: str) -> DataFrame:
    """Station metadata that stand in from suppliers."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("station_id"), (47 + (k * 7919 % 1000) / 4000.0).alias("lat"), (8 + (k * 104729 % 1000) / 4000.0).alias("long"), (400 + k * 31 % 300).cast("double").alias("elev"), (F.col("s_nationkey") % 5).cast("int").alias("lcz")
    )


def scored(spark, sf_dir: str) -> DataFrame:
    """Scored rows that stand in from line items: station, risk score p, residual, flags, split."""
    return table(spark, sf_dir, "lineitem").select(*_scored_columns())


def _scored_columns() -> list:
    d = F.col("l_shipdate").cast("date")
    return [
        F.col("l_suppkey").alias("station_id"),
        F.col("l_orderkey").alias("row_key"),
        F.col("l_linenumber").alias("line"),
        F.round(F.col("l_discount") * 8 + F.col("l_tax") * 2, 4).alias("p"),
        ((F.col("l_extendedprice") / F.col("l_quantity") - 1500) / 100).alias("resid"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when(F.col("l_linenumber") % 4 == 0, None).otherwise((F.col("l_returnflag") == "A").cast("int")).alias("lenient"),
        (F.col("l_linenumber") > 4).cast("int").alias("strict"),
        F.when(d < F.lit("1999-01-01").cast("date"), "train").when(d < F.lit("2000-06-01").cast("date"), "valid").otherwise("test").alias("split"),
    ]


def context(spark, sf_dir: str) -> DataFrame:
    """Scored rows with surroundings that stand in from the line items' other numbers."""
    part = lambda c, m: (F.col(c) % m).cast("double")
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        *_scored_columns(),
        F.col("l_shipdate").cast("date").alias("day"),
        F.month("l_shipdate").alias("month"),
        (F.col("l_quantity") * 20).alias("solar"),
        F.when(n != 3, F.col("l_tax") * 100).alias("wind"),
        (n % 2).cast("int").alias("is_day"),
        part("l_suppkey", 12).alias("km"),
        (F.col("l_orderkey") % 9).cast("int").alias("n_refs"),
        F.when(n != 5, F.col("l_discount") * 60).alias("spread"),
        (part("l_orderkey", 4) / 3).alias("lcz_differs"),
        (part("l_orderkey", 5) / 4).alias("cover_differs"),
        part("l_partkey", 300).alias("elev_gap"),
        part("l_partkey", 25).alias("building_gap"),
        (part("l_partkey", 17) - 8).alias("lst_diff"),
        (part("l_partkey", 301) - 150).alias("elev_diff"),
        (part("l_partkey", 15) / 10 - 0.7).alias("ndvi_diff"),
    )
