"""Temporal features, fills, as-of joins and spatial references."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .qc import KEY, series
from .ranks import attach, counted, quantiles, quantiles_of_few

EARTH_KM = 6371.0088


def hourly_summary(obs: DataFrame) -> DataFrame:
    c = F.col("temp")
    return obs.groupBy("date").agg(
        F.count(c).alias("n"), F.round(F.avg(c), 9).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 6).alias("median"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.max(c) - F.min(c), 6).alias("span")
    )


def lags(obs: DataFrame, steps=(1, 2, 3, 6, 12, 24)) -> DataFrame:
    return obs.withColumns({f"lag{k}": F.lag("temp", k).over(series()) for k in steps})


def rolling(obs: DataFrame, sizes=(3, 6, 24)) -> DataFrame:
    """Mean and deviation of the rows before, where at least half (2 at least) are there."""
    out = {}
    for k in sizes:
        w = series().rowsBetween(-k, -1)
        ok = F.count("temp").over(w) >= max(2, -(-k // 2))
        out |= {f"mean{k}": F.when(ok, F.round(F.avg("temp").over(w), 9)), f"std{k}": F.when(ok, F.round(F.stddev_samp("temp").over(w), 6))}
    return obs.withColumns(out)


def calendar(obs: DataFrame) -> DataFrame:
    t = F.col("date")
    angle = 2 * F.lit(3.141592653589793) * F.hour(t) / 24
    return obs.withColumns({"hour": F.hour(t), "month": F.month(t), "day_of_year": F.dayofyear(t), "weekday": F.weekday(t), "hour_sin": F.round(F.sin(angle), 6) + 0.0, "hour_cos": F.round(F.cos(angle), 6) + 0.0})


def forward_fill(obs: DataFrame) -> DataFrame:
    before = F.last("temp", ignorenulls=True).over(series().rowsBetween(W.unboundedPreceding, 0))
    return obs.withColumns({"filled": before, "was_missing": F.col("temp").isNull().cast("int")})


def asof(left: DataFrame, right: DataFrame, value: str, direction: str = "backward", hours: float = 3) -> DataFrame:
    """Joins each left row (date, station_id) with the right row nearest in time in a direction, up to
    and including ``hours``; a tie goes back. Stations of two networks may share an id: where both sides
    have a network, it must be the same. One union and one window, no range join."""
    keys = ["station_id", *(["network"] if "network" in left.columns and "network" in right.columns else [])]
    r = right.groupBy(*keys, "date").agg(F.max(value).alias(value))
    both = left.select("*", F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_left")).unionByName(r.select("date", *keys, F.col(value).alias("_v"), F.lit(0).alias("_left")), allowMissingColumns=True)
    here = F.when(F.col("_left") == 0, F.struct(F.col("date").alias("t"), F.col("_v").alias("v")))
    past = W.partitionBy(*keys).orderBy(F.col("date"), F.col("_left")).rowsBetween(W.unboundedPreceding, 0)
    next_ = W.partitionBy(*keys).orderBy(F.col("date"), F.desc("_left")).rowsBetween(0, W.unboundedFollowing)
    both = both.withColumns({"_b": F.last(here, ignorenulls=True).over(past), "_f": F.first(here, ignorenulls=True).over(next_)}).where("_left = 1")
    age = lambda c: F.abs(F.unix_seconds(F.col("date")) - F.unix_seconds(F.col(f"{c}.t"))) / 3600
    ok = lambda c: F.coalesce(age(c) <= hours, F.lit(False))
    back, forth = F.when(ok("_b"), F.col("_b")), F.when(ok("_f"), F.col("_f"))
    if direction == "backward":
        pick = back
    elif direction == "forward":
        pick = forth
    else:
        pick = F.when(ok("_b") & (~ok("_f") | (age("_b") <= age("_f"))), F.col("_b")).otherwise(forth)
    out = both.withColumn("_p", pick)
    return out.select(*left.columns, F.col("_p.v").alias(value), (age("_p")).alias("age_h"), F.col("_p").isNull().cast("int").alias("missing"))


def haversine(lat1, lon1, lat2, lon2):
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def geodesic(lat1, lon1, lat2, lon2):
    """Metres along the WGS-84 ellipsoid by Lambert's formula: exact to a few centimetres over city
    distances."""
    a, f = 6378137.0, 1 / 298.257223563
    b1, b2 = (F.atan((1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    s = 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q), 2) / F.pow(F.cos(s / 2), 2)
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q), 2) / F.nullif(F.pow(F.sin(s / 2), 2), F.lit(0.0))
    return a * (s - f / 2 * (x + F.coalesce(y, F.lit(0.0))))


#: Stations of one place that stand in one row of a list.
LISTED = 256


def placed(stations: DataFrame, cols: tuple[str, ...] = ("lat", "long", "elev")) -> DataFrame:
    """station_id and _place, what tells its place, of the stations that have one."""
    return stations.where("lat IS NOT NULL AND long IS NOT NULL").select("station_id", F.struct(*cols).alias("_place"))


def near_places(targets: DataFrame, sources: DataFrame, km: float) -> DataFrame:
    """_place, _place2, metres: distinct places of two ``placed`` tables up to ``km`` apart, their geodesic
    distance in metres. Places meet in neighbouring cells of a grid, which hold all within ``km``; stations
    that share a place are not told apart, so the work grows with the places and not with the stations."""
    apart = lambda df: df.select("_place").distinct().select("_place", "_place.lat", "_place.long")
    t, s = apart(targets), apart(sources)
    widest = _narrowest(t, s)
    grid = _cells(s, km, widest, 0, 0).withColumnsRenamed({"_place": "_place2", "lat": "lat2", "long": "long2"})
    p = _cells(t, km, widest, 1, 0).join(grid, ["level", "_y", "_x"])
    p = p.withColumn("metres", geodesic(F.col("lat"), F.col("long"), F.col("lat2"), F.col("long2"))).where(F.col("metres") <= km * 1000)
    return p.select("_place", "_place2", "metres")


def _listed(stations: DataFrame, ids: str) -> DataFrame:
    """The stations of a place as lists of some ``LISTED``, so that a crowded place is many rows."""
    n = stations.groupBy("_place").agg(F.count("*").alias("_n"))
    chunk = F.pmod(F.xxhash64("station_id"), F.ceil(F.col("_n") / LISTED))
    return stations.join(n, "_place").groupBy("_place", chunk.alias("_chunk")).agg(F.collect_list("station_id").alias(ids)).drop("_chunk")


def station_pairs(pairs: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """station_id, source_id of every pair of places (_place, _place2), but for a station and itself. The
    pairs come out of lists, behind the last exchange."""
    met = pairs.join(_listed(targets, "_ids"), "_place").join(_listed(sources, "_ids2").withColumnRenamed("_place", "_place2"), "_place2")
    met = met.select(F.explode("_ids").alias("station_id"), "_ids2")
    return met.select("station_id", F.explode("_ids2").alias("source_id")).where("station_id <> source_id")


def radius_counts(targets: DataFrame, sources: DataFrame, km: float = 2.5) -> DataFrame:
    """Per target: how many sources are in the radius, and which. Targets without one have 0. The list of a
    place is made once and goes to its targets, less the target itself."""
    flat = ("lat", "long")
    t, s = placed(targets, flat), placed(sources, flat)
    met = near_places(t, s, km).join(_listed(s, "_ids").withColumnRenamed("_place", "_place2"), "_place2")
    lists = met.groupBy("_place").agg(F.array_sort(F.flatten(F.collect_list("_ids"))).alias("_ids"))
    # An id at several places has the sources of all of them.
    places = t.groupBy("station_id").agg(F.collect_list("_place").alias("_places"))
    one = places.where(F.size("_places") == 1).select("station_id", F.col("_places")[0].alias("_place")).join(lists, "_place").drop("_place")
    more = places.where(F.size("_places") > 1).select("station_id", F.explode("_places").alias("_place")).join(lists, "_place")
    more = more.groupBy("station_id").agg(F.array_sort(F.flatten(F.collect_list("_ids"))).alias("_ids"))
    near_ids = F.filter("_ids", lambda x: x != F.col("station_id"))
    g = one.unionByName(more).select("station_id", near_ids.alias("near_ids")).where(F.size("near_ids") > 0)
    return targets.select("station_id").join(g, "station_id", "left").select("station_id", F.coalesce(F.size("near_ids").cast("long"), F.lit(0).cast("long")).alias("n_near"), "near_ids")


def _narrowest(t: DataFrame, s: DataFrame) -> float:
    """A degree of longitude is shortest where stations are farthest from the equator: its share there."""
    far = t.select("lat").union(s.select("lat")).agg(F.max(F.abs("lat"))).first()[0]
    return max(0.01, math.cos(math.radians(min(89.0, (far or 0.0) + 1))))


#: Sides of the grid's cells: the radius, doubled so often.
LEVELS = 13


def _cells(df: DataFrame, km: float, widest: float, spread: int, levels: int = LEVELS) -> DataFrame:
    """A row per level and cell of the grid, or per cell around it."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    side = F.lit(km / 110.0) * F.pow(F.lit(2.0), F.col("level"))
    df = df.withColumn("level", level).withColumns({"_y": F.floor(F.col("lat") / side), "_x": F.floor(F.col("long") * F.lit(widest) / side)})
    near = F.sequence(F.lit(-spread), F.lit(spread))
    return df.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near)).withColumns({"_y": F.col("_y") + F.col("_dy"), "_x": F.col("_x") + F.col("_dx")}).drop("_dy", "_dx")


def neighbours(targets: DataFrame, sources: DataFrame, k: int = 5, radius_km: float = 5) -> DataFrame:
    """Pairs of target and source: the k nearest in the radius, or the k nearest if none is in it.

    No target meets all sources: places are put into cells of a grid, and a target's place meets the
    cells around its own, which hold all within the radius. For a target without one, the counts of cells
    tell how coarse a grid must be that the cells around it hold k stations; two levels further up
    they hold the k nearest. Stations must not lie across the 180th meridian.

    Targets of one place have the same sources but for themselves, and of the sources of one place only
    the first k + 1 ids can be among a target's k: distances are taken of places, so the work grows with
    these, and a target meets k + 1 ids."""
    place = F.struct("lat", "long")
    by_id = lambda *o: F.dense_rank().over(W.partitionBy("_place").orderBy(*o))
    t = targets.where("lat IS NOT NULL AND long IS NOT NULL").withColumn("_place", place).select("station_id", "_place", "elev", "lcz")
    s = sources.where("lat IS NOT NULL AND long IS NOT NULL").select(F.col("station_id").alias("source_id"), place.alias("_place"), F.col("elev").alias("elev2"), F.col("lcz").alias("lcz2"), F.col("lat").alias("lat2"), F.col("long").alias("long2"))
    s = s.withColumn("_first", by_id("source_id")).where(F.col("_first") <= k + 1).drop("_first", "_place")
    at = t.select("_place").distinct().select("_place", "_place.lat", "_place.long")
    widest = _narrowest(at, s.select(F.col("lat2").alias("lat")))
    grid = _cells(s.withColumnsRenamed({"lat2": "lat", "long2": "long"}), radius_km, widest, 0).withColumnsRenamed({"lat": "lat2", "long": "long2"})

    def met(rows: DataFrame) -> DataFrame:
        p = rows.join(grid, ["level", "_y", "_x"]).withColumn("km", F.round(haversine(F.col("lat"), F.col("long"), F.col("lat2"), F.col("long2")), 6))
        return p.select("_place", "source_id", "elev2", "lcz2", "km")

    def first(found: DataFrame, rows: DataFrame) -> DataFrame:
        """Each target with the first of its place, less itself. An id counts once, by its nearest row."""
        nearest = found.withColumn("_km", F.min("km").over(W.partitionBy("_place", "source_id")))
        few = nearest.withColumn("_rank", by_id("_km", "source_id")).where(F.col("_rank") <= k + 1).drop("_rank", "_km")
        return rows.join(few, "_place").where(F.col("station_id") != F.col("source_id"))

    inside = first(met(_cells(at, radius_km, widest, 1, 0)).where(F.col("km") <= radius_km), t)
    alone = t.join(inside.select("station_id").distinct(), "station_id", "left_anti")
    around = _cells(alone.select("_place").distinct().select("_place", "_place.lat", "_place.long"), radius_km, widest, 1)
    held = grid.groupBy("level", "_y", "_x").agg(F.count("*").alias("_held"))
    # One more than k, for the target may be a source itself.
    enough = around.join(held, ["level", "_y", "_x"]).groupBy("_place", "level").agg(F.sum("_held").alias("_held"))
    level = enough.groupBy("_place").agg(F.least(F.lit(LEVELS), F.coalesce(F.min(F.when(F.col("_held") > k, F.col("level"))) + 2, F.lit(LEVELS))).alias("_level"))
    outside = first(met(around.join(level, "_place").where("level = _level").drop("_level")), alone)
    own = W.partitionBy("station_id")
    p = inside.unionByName(outside).withColumn("rank", F.row_number().over(own.orderBy("km", "source_id"))).where(F.col("rank") <= k)
    p = p.withColumn("weight", 1 / F.pow(F.greatest("km", F.lit(0.05)), 2))
    return p.select("station_id", "source_id", "rank", "km", F.round(F.col("weight") / F.sum("weight").over(own), 6).alias("weight"), F.round(F.col("elev") - F.col("elev2"), 6).alias("elev_diff"), (F.col("lcz") == F.col("lcz2")).cast("int").alias("same_lcz"))


def local_reference(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Weighted reference of each target and hour from its sources' values."""
    o = obs.select("date", F.col("station_id").alias("source_id"), "temp").where("temp IS NOT NULL")
    return pairs.join(o, "source_id").groupBy("station_id", "date").agg(
        F.round(F.stddev_samp("temp"), 6).alias("std"),
        F.min("temp").alias("low"),
        F.max("temp").alias("high"),
        F.round(F.max("temp") - F.min("temp"), 6).alias("spread"),
        F.count("*").alias("n"), F.round(F.try_divide(F.sum(F.col("weight") * F.col("temp")), F.sum("weight")), 5).alias("idw"), F.round(F.percentile("temp", F.lit(0.5)), 6).alias("median"), F.min_by("temp", F.struct("rank", "km")).alias("nearest")
    )


def robust_sigma(df: DataFrame, by: list[str], value: str, floor: float = 0.2) -> DataFrame:
    """1.4826 MAD by group; population deviation where it is 0; the floor at least. Groups of null meet;
    a group without values has no row. All comes from the counts of each value about the group's median: the rows are read once."""
    counts = counted(df, by, value)
    away = attach(counts, quantiles(counts, by, "_v", {"_med": 0.5}, "_n").drop("n"), by).select(*by, "_n", (F.col("_v") - F.col("_med")).alias("_off"))
    n, total, square = (F.sum(c) for c in (F.col("_n"), F.col("_n") * F.col("_off"), F.col("_n") * F.col("_off") * F.col("_off")))
    g = away.groupBy(*by).agg(n.alias("n"), F.sqrt(F.greatest(F.lit(0.0), square / n - (total / n) * (total / n))).alias("_sd"))
    mad = quantiles(away.withColumn("_off", F.abs("_off")), by, "_off", {"_mad": 0.5}, "_n").drop("n")
    mad, g = 1.4826 * F.col("_mad"), attach(g, mad, by)
    return g.select(*by, "n", F.round(F.greatest(F.when(mad > 0, mad).otherwise(F.col("_sd")), F.lit(floor)), 6).alias("sigma"))


def robust_sigma_of_few(df: DataFrame, by: list[str], value: str, floor: float = 0.2) -> DataFrame:
    """``robust_sigma`` of groups that are few, whatever their size: the rows are read four times, for sums by bucket and
    for the values of the buckets around the two medians, so exchanges do not grow with the rows."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    # A row a group; kept, for all that follows reads it.
    med = quantiles_of_few(rows, by, "_v", {"_med": 0.5}).drop("n").persist()
    away = attach(rows, F.broadcast(med), by).select(*by, (F.col("_v") - F.col("_med")).alias("_off"))
    n, total, square = F.count("*"), F.sum("_off"), F.sum(F.col("_off") * F.col("_off"))
    g = away.groupBy(*by).agg(n.alias("n"), F.sqrt(F.greatest(F.lit(0.0), square / n - (total / n) * (total / n))).alias("_sd"))
    mad = quantiles_of_few(away.withColumn("_off", F.abs("_off")), by, "_off", {"_mad": 0.5}).drop("n")
    mad, g = 1.4826 * F.col("_mad"), attach(g, mad, by)
    return g.select(*by, "n", F.round(F.greatest(F.when(mad > 0, mad).otherwise(F.col("_sd")), F.lit(floor)), 6).alias("sigma"))
