"""Raw station times to an hourly UTC axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .qc import KEY, series


def to_utc(local: Column, zone: str) -> Column:
    """Local wall time as UTC (session zone UTC). A time inside a spring gap moves to the gap's end;
    an ambiguous one is taken as summer time."""
    utc = F.to_utc_timestamp(local, zone)
    skipped = F.from_utc_timestamp(utc, zone) != local
    # Inside a gap the local hour does not exist: its end is the full hour after.
    return F.when(skipped, F.to_utc_timestamp(F.date_trunc("hour", local) + F.expr("INTERVAL 1 HOUR"), zone)).otherwise(utc)


def shift(raw: DataFrame, direction: str | None, minutes: int = 30) -> DataFrame:
    """Stamps of a period's end go back (``forward`` data), those of its start ahead."""
    if direction is None:
        return raw
    sign = {"forward": -1, "backward": 1}[direction]
    return raw.withColumn("date", F.timestamp_seconds(F.unix_seconds("date") + sign * minutes * 60))


def half_hours(raw: DataFrame) -> DataFrame:
    """Means of 30-minute slots on the panel's whole axis; a null between two values becomes their
    mean, a last one the value before it."""
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("date") / 1800) * 1800)
    g = raw.groupBy(*KEY, slot.alias("date")).agg(F.avg("temp").alias("temp"))
    ends = g.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))  # one row
    axis = ends.where("_a IS NOT NULL").select(F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 30 MINUTES"))).alias("date"))
    g = g.select(*KEY).distinct().join(axis).join(g, [*KEY, "date"], "left")
    before, after, n = F.lag("temp").over(series()), F.lead("temp").over(series()), F.row_number().over(series())
    alone = F.col("temp").isNull() & (before.isNotNull() | (n == 1)) & (after.isNotNull() | (F.lead(F.lit(1)).over(series()).isNull()))
    return g.withColumn("temp", F.when(alone, F.coalesce((before + after) / 2, before)).otherwise(F.col("temp")))


def hourly_first(slots: DataFrame) -> DataFrame:
    """The first value of each hour; null if it has none."""
    return slots.groupBy(*KEY, F.date_trunc("hour", "date").alias("date")).agg(F.min_by("temp", F.when(F.col("temp").isNotNull(), F.col("date"))).alias("temp"))


def climatology(obs: DataFrame) -> DataFrame:
    """Nulls filled by the median of the station's month and hour, else of the network's."""
    o = obs.withColumns({"month": F.month("date"), "hour": F.hour("date")})
    own = o.groupBy(*KEY, "month", "hour").agg(F.percentile("temp", F.lit(0.5)).alias("station_median"))
    net = o.groupBy("network", "month", "hour").agg(F.percentile("temp", F.lit(0.5)).alias("network_median"))
    o = o.join(own, [*KEY, "month", "hour"]).join(net, ["network", "month", "hour"])
    return o.withColumn("filled", F.coalesce("temp", "station_median", "network_median")).select("date", *KEY, "temp", "filled", F.col("filled").isNull().cast("int").alias("missing"))


def spatial_blocks(stations: DataFrame, bins: int = 5) -> DataFrame:
    """Quantile blocks of latitude and longitude, closed on the right; the least value is in the first."""
    inner = [i / bins for i in range(1, bins)]
    edges = stations.agg(*(F.percentile(c, F.array(*map(F.lit, inner))).alias(f"_{c}") for c in ("lat", "long")))
    at = lambda c: F.size(F.filter(F.array_distinct(f"_{c}"), lambda e: e < F.col(c)))
    return stations.join(F.broadcast(edges)).select("station_id", at("lat").alias("lat_block"), at("long").alias("long_block"))  # one row


def spline_fill(obs: DataFrame, most: int = 1) -> DataFrame:
    """Inner gaps of ``most`` rows at most get the value of the station's not-a-knot cubic spline;
    longer gaps and the ends stay null, as do stations of fewer than two values. A station's series
    is one task's rows: hours of one station."""
    run = W.partitionBy(*KEY, "_run")
    part = F.row_number().over(series()) - F.row_number().over(W.partitionBy(*KEY, F.col("temp").isNull()).orderBy("date"))
    rows = obs.select("date", *KEY, "temp").withColumn("_run", F.when(F.col("temp").isNull(), part)).withColumn("_n", F.count("*").over(run))
    schema = rows.select("date", *KEY, "temp").schema

    def fill(frame):
        import numpy as np

        from ..functions.numeric import spline

        frame = frame.sort_values("date", kind="stable")
        x = frame["date"].to_numpy("datetime64[s]").astype(float) / 3600
        y = frame["temp"].to_numpy(float)
        some = np.isfinite(y)
        if some.sum() >= 2:
            gap = ~some & (frame["_n"].to_numpy() <= most)
            gap &= (x > x[some][0]) & (x < x[some][-1])
            y[gap] = spline(x[some], y[some], x[gap])
        frame["temp"] = y
        out = frame[["date", *KEY, "temp"]].astype({"temp": object})
        out.loc[~np.isfinite(y), "temp"] = None
        return out

    return rows.groupBy(*KEY).applyInPandas(fill, schema)
