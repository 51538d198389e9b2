"""The quality chain: group tests, trust and correlation that take values out, the statistics table.

Observations are long (date, station_id, network, temp). A test nulls ``temp`` and keeps all rows and
other columns, so a chain can carry a column a stage and count all stages in one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import beyond_one, beyond_qn, qn_scale, t_quantile, without
from . import qc
from .features import near_places, placed, station_pairs
from .qc import KEY

# Bounds of the buddy test, and its least number of buddies, reach and height.
BUDDY_LOW, BUDDY_HIGH, BUDDIES, BUDDY_METRES, BUDDY_HEIGHT = 0.075, 0.925, 5, 2000.0, 100.0
#: Side of a tile of places in reaches, and groups of dates to which a tile's work is dealt.
TILE, DEALT = 4, 16


def normal(q: float) -> float:
    return NormalDist().inv_cdf(q)


def distribution_test(obs: DataFrame, scale: str = "qn", student: bool = False, low: float = 0.1, high: float = 0.9, least: int = 5) -> DataFrame:
    """Across stations at each date: a score outside of the quantiles goes, as do all values of a date
    with fewer than ``least``. scale: 'z' (mean, population deviation), 'mad' (median, mean absolute
    deviation / 0.6745) or 'qn' (median, Qn). The quantiles are normal or Student's with n - 1 degrees.
    Where the scale is 0 all values go."""
    at = W.partitionBy("date")
    value = F.col("temp")
    if scale == "z":
        rows = obs.withColumns({"_mid": F.avg(value).over(at), "_scale": F.stddev_pop(value).over(at), "_n": F.count(value).over(at)})
    else:
        own = obs.where("temp IS NOT NULL")
        if scale == "mad":
            own = own.withColumn("_away", F.abs(value - F.avg(value).over(at)))
        spread = qn_scale("temp") if scale == "qn" else F.avg("_away")
        # Spark does not mix pandas and other aggregates: the median comes by itself.
        mids = own.groupBy("date").agg(F.percentile("temp", F.lit(0.5)).alias("_mid"), F.count("*").alias("_n"))
        per = mids.join(own.groupBy("date").agg(spread.alias("_scale")), "date")
        per = per.withColumn("_scale", F.col("_scale") / 0.6745) if scale == "mad" else per
        rows = obs.join(per, "date", "left")
    z = F.try_divide(value - F.col("_mid"), F.col("_scale"))
    if student:
        bound = F.pandas_udf(lambda n: pd.Series([t_quantile(high, int(k) - 1) if k and k > 1 else None for k in n], dtype=float), "double")
        # A row a number of values, not a row an observation, goes to Python; the low bound mirrors it.
        assert abs(low + high - 1) < 1e-9, "Student's quantiles are taken on both sides alike"
        limits = rows.select("_n").distinct().withColumn("_high", bound("_n"))
        limits = limits.select(F.col("_n").alias("_m"), F.when(~F.isnan("_high"), F.col("_high")).alias("_high"))
        rows = rows.join(limits, rows["_n"].eqNullSafe(limits["_m"]), "left").drop("_m").withColumn("_low", -F.col("_high"))
    else:
        rows = rows.withColumns({"_low": F.lit(normal(low)), "_high": F.lit(normal(high))})
    ok = (F.col("_n") >= least) & (z >= F.col("_low")) & (z <= F.col("_high"))
    return rows.withColumn("temp", F.when(ok, value)).drop("_mid", "_scale", "_n", "_low", "_high")


def with_heights(test: Callable[[DataFrame], DataFrame], meta: DataFrame, lapse: float = 0.0065) -> Callable[[DataFrame], DataFrame]:
    """The test on values that are corrected for height; what it keeps comes back as it was."""

    def run(obs: DataFrame) -> DataFrame:
        high = qc.elevation_correction(obs.withColumn("_own", F.col("temp")), meta, lapse)
        return test(high).withColumn("temp", F.when(F.col("temp").isNotNull(), F.col("_own"))).drop("_own")

    return run


def buddy_pairs(meta: DataFrame, metres: float = BUDDY_METRES, height: float = BUDDY_HEIGHT, least: int = BUDDIES) -> DataFrame:
    """station_id, buddy_id: stations within reach and height, of those that have enough. Distances and
    numbers are of places; stations come in at the end, so no exchange holds their pairs."""
    m = placed(meta)
    places = _reach(m, metres, height)
    return station_pairs(places, _with_enough(m, places, least), m).withColumnRenamed("source_id", "buddy_id")


def _reach(m: DataFrame, metres: float, height: float) -> DataFrame:
    """_place, _place2: places of ``placed`` stations that are within reach and height of one another."""
    own = m.select("_place").distinct().withColumn("_at", F.struct("_place.lat", "_place.long"))
    flat = own.select(F.col("_at").alias("_place"))
    met = near_places(flat, flat, metres / 1000).where(F.col("metres") <= metres).withColumnsRenamed({"_place": "_at", "_place2": "_at2"})
    met = met.join(own, "_at").join(own.withColumnsRenamed({"_at": "_at2", "_place": "_place2"}), "_at2")
    return met.where(F.abs(F.col("_place.elev") - F.col("_place2.elev")) <= height).select("_place", "_place2").repartition("_place")


def _with_enough(m: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """The stations that have enough others in reach: the sizes of the places less the station itself."""
    sizes = m.groupBy(F.col("_place").alias("_place2")).agg(F.count("*").alias("_n"))
    reach = places.join(sizes, "_place2").groupBy("_place").agg(F.sum("_n").alias("_n"))
    itself = m.join(m.withColumnRenamed("_place", "_place2"), "station_id").join(places, ["_place", "_place2"]).groupBy("station_id").agg(F.count("*").alias("_self"))
    n = m.join(reach, "_place").groupBy("station_id").agg(F.sum("_n").alias("_n")).join(itself, "station_id", "left")
    return m.join(n.where(F.col("_n") - F.coalesce("_self", F.lit(0)) >= least), "station_id", "left_semi")


def buddy_test(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """A value goes that is too far from the median of its buddies at its date, in units of their Qn.
    With fewer than two buddy values, or a Qn of 0, it stays; so do stations without buddies."""
    values = obs.where("temp IS NOT NULL").select("date", F.col("station_id").alias("buddy_id"), F.col("temp").alias("_v"))
    met = pairs.join(values, "buddy_id")
    per = met.groupBy("station_id", "date").agg(F.percentile("_v", F.lit(0.5)).alias("_mid")).join(met.groupBy("station_id", "date").agg(qn_scale("_v").alias("_qn")), ["station_id", "date"])
    rows = obs.join(per, ["station_id", "date"], "left")
    z = (F.col("temp") - F.col("_mid")) / F.nullif(F.col("_qn"), F.lit(0.0))
    out = F.coalesce((z < normal(BUDDY_LOW)) | (z > normal(BUDDY_HIGH)), F.lit(False))
    return rows.withColumn("temp", F.when(~out, F.col("temp"))).drop("_mid", "_qn")


def buddy_test_near(obs: DataFrame, meta: DataFrame, metres: float = BUDDY_METRES, height: float = BUDDY_HEIGHT, least: int = BUDDIES) -> DataFrame:
    """``buddy_test`` of the ``buddy_pairs`` of ``meta``, without a row a pair and date: values go to the tile
    of their place and to those tiles that have a place in reach, once each. There the values of
    a date are sorted once, and a place's are picked from them for all of its stations."""
    spark = obs.sparkSession
    m = placed(meta)
    places = _reach(m, metres, height)
    enough = _with_enough(m, places, least)
    # Whoever has several rows has the buddies of all of them, each as often as rows meet.
    several = m.groupBy("station_id").agg(F.count("*").alias("_n")).where("_n > 1").select("station_id")
    single = enough.join(several, "station_id", "left_anti")
    cell = lambda c: F.floor(F.col(c) / F.lit(TILE * metres / 110_000))
    tile = F.shiftleft(cell("_place.lat"), 32) + cell("_place.long")
    near = places.join(single.select("_place").distinct(), "_place").withColumn("_tile", tile)
    # Places are numbered in each tile.
    number = near.select("_tile", F.explode(F.array("_place", "_place2")).alias("_place")).distinct()
    number = number.withColumn("_no", F.row_number().over(W.partitionBy("_tile").orderBy("_place")))
    lists = near.join(number.withColumnsRenamed({"_place": "_place2", "_no": "_no2"}), ["_tile", "_place2"]).groupBy("_tile", "_place").agg(F.collect_list("_no2").alias("_near"))
    lists = lists.join(number, ["_tile", "_place"]).select("_tile", "_no", "_near", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_deal"))
    tested = single.select("station_id", tile.alias("_home"))
    at = m.join(number, "_place").join(tested, "station_id", "left").select("station_id", F.struct("_tile", "_no", F.col("_tile").eqNullSafe(F.col("_home")).alias("_own")).alias("_to"))
    at = at.groupBy("station_id").agg(F.collect_list("_to").alias("_at"), F.max("_to._own").alias("_tested"))
    # What is not tested passes by.
    passes = F.array(F.struct(F.lit(None).cast("long").alias("_tile"), F.lit(None).cast("int").alias("_no"), F.lit(True).alias("_own")))
    to = F.when(F.col("date").isNull() | F.col("_at").isNull(), passes).when(F.col("_tested"), F.col("_at")).otherwise(F.concat("_at", passes))
    rows = obs.join(at, "station_id", "left").withColumn("_to", F.explode(to)).select(*obs.columns, "_to.*").where("_own OR temp IS NOT NULL")
    rows = rows.withColumns({c: F.when(F.col("_own"), F.col(c)) for c in obs.columns if c not in ("date", "temp")})
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64("date"), F.lit(DEALT)).cast("int")).unionByName(lists, allowMissingColumns=True)
    # A number of its own, so that small inputs are not put together: the work is in the tasks.
    laid = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_tile", "_deal").sortWithinPartitions("_tile", "_deal", "date")
    tests = laid.mapInArrow(_tested_by_tile(obs.columns), obs.schema)
    odd = enough.join(several, "station_id", "left_semi")
    if odd.isEmpty():
        return tests
    ids = odd.select("station_id").distinct()
    pairs = station_pairs(places, odd, m).withColumnRenamed("source_id", "buddy_id")
    return tests.join(ids, "station_id", "left_anti").select(*obs.columns).unionByName(buddy_test(obs, pairs).join(ids, "station_id", "left_semi").select(*obs.columns))


def _tested_by_tile(columns: list[str]) -> Callable:
    """Rows sorted by tile, deal and date, those of a date one after the other; before them, without a date,
    the tile's lists of places. One date of one tile is held at once."""

    def changes(column: pa.ChunkedArray) -> np.ndarray:
        code = pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        return code[1:] != code[:-1]

    def run(batches):
        near: dict[int, np.ndarray] = {}
        reach = np.zeros(0, bool)

        def tested(t: pa.Table, starts: np.ndarray) -> pa.Table:
            nonlocal reach
            no = pc.fill_null(t["_no"], 0).to_numpy()
            temp = t["temp"].cast(pa.float64())
            valid, temp = temp.is_valid().to_numpy(), temp.fill_null(0.0).to_numpy()
            listed, own = t["_near"].is_valid().to_numpy(), pc.fill_null(t["_own"], False).to_numpy()
            at_tile = t["_tile"].is_valid().to_numpy()
            ids = t["station_id"].combine_chunks().dictionary_encode().indices
            ids = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False)
            out = np.zeros(t.num_rows, bool)
            for i, j in zip(starts, [*starts[1:], t.num_rows], strict=True):
                if listed[i]:
                    near.clear()
                    part = t["_near"].slice(i, j - i).combine_chunks()
                    ends = np.cumsum(part.value_lengths().to_numpy())
                    near.update(zip(no[i:j].tolist(), np.split(part.flatten().to_numpy(), ends[:-1]), strict=True))
                    reach = np.zeros(1 + max(no[i:j].max(), max(x.max() for x in near.values())), bool)
                elif at_tile[i]:
                    rows = i + np.flatnonzero(valid[i:j])
                    out[rows] = _far_from_buddies(no[rows], temp[rows], np.where(own[rows], ids[rows], -1), near, reach)
            t = t.append_column("_out", pa.array(out))
            t = t.filter(pa.array(own))
            return t.set_column(t.column_names.index("temp"), "temp", pc.if_else(t["_out"], pa.scalar(None, t["temp"].type), t["temp"])).select(columns)

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            starts = np.flatnonzero(np.concatenate([[True], changes(t["_tile"]) | changes(t["_deal"]) | changes(t["date"])]))
            last = int(starts[-1])
            if last:
                yield from tested(t.slice(0, last).combine_chunks(), starts[:-1]).to_batches()
            rest = t.slice(last)
        if rest is not None:
            yield from tested(rest.combine_chunks(), np.array([0])).to_batches()

    return run


def _far_from_buddies(no: np.ndarray, temp: np.ndarray, station: np.ndarray, near: dict[int, np.ndarray], reach: np.ndarray) -> np.ndarray:
    """The values of one date. no: of their places; station: of those that are tested, else -1; near: the
    places in reach of those that have such stations; reach: False for each place, to be marked in."""
    low, high = normal(BUDDY_LOW), normal(BUDDY_HIGH)
    out = np.zeros(len(temp), bool)
    order = np.argsort(temp, kind="stable")
    value, place = temp[order], no[order]
    tested = np.flatnonzero(station >= 0)
    tested = tested[np.argsort(no[tested], kind="stable")]
    starts = np.flatnonzero(np.diff(no[tested], prepend=-1))
    again = np.bincount(station[tested])[station[tested]] > 1
    for i, j in zip(starts, [*starts[1:], len(tested)], strict=True):
        at = int(no[tested[i]])
        reach[near[at]] = True
        u, itself = value[reach[place]], bool(reach[at])
        reach[near[at]] = False
        rows, twice = tested[i:j], again[i:j]
        one = rows[~twice]
        out[one] = beyond_qn(u, temp[one], low, high, itself)
        for r in rows[twice]:  # several values of the station at the date: none is of its buddies
            others = without(u, *temp[rows[station[rows] == station[r]]]) if itself else u
            out[r] = beyond_one(others, temp[r], low, high)
    return out


def outliers(obs: DataFrame, before: str, after: str = "temp") -> DataFrame:
    """``_out``: the value became null between two columns."""
    return obs.withColumn("_out", F.col(before).isNotNull() & F.col(after).isNull())


def trust_table(obs: DataFrame, flag: str, most: float = 0.2) -> DataFrame:
    """Per station and month: flagged rows, all hours of the month in the panel (of any station), and
    whether the share of flagged ones is over ``most``."""
    month = F.date_trunc("month", "date").alias("month")
    hours = obs.select(month, "date").distinct().groupBy("month").agg(F.count("*").alias("hours"))
    g = obs.groupBy(*KEY, month).agg(F.sum(F.col(flag).cast("long")).alias("flagged"))
    return g.join(F.broadcast(hours), "month").withColumn("dropped", F.col("flagged") / F.col("hours") > most)  # a row a month


def trust_test(obs: DataFrame, flag: str, most: float = 0.2) -> DataFrame:
    """Station-months with too many flagged hours become null."""
    t = trust_table(obs, flag, most).where("dropped").select(*KEY, "month", F.lit(True).alias("_drop"))
    rows = obs.withColumn("month", F.date_trunc("month", "date")).join(t, [*KEY, "month"], "left")
    return rows.withColumn("temp", F.when(F.col("_drop").isNull(), F.col("temp"))).drop("_drop", "month")


def correlation_test(obs: DataFrame, least: float = 0.9) -> DataFrame:
    """Values of station and calendar month go whose correlation with the median of all stations is
    weak; a correlation that is not there keeps them."""
    bad = qc.month_correlation(obs, least).where("dropped").select(*KEY, F.col("month").alias("_m"), F.lit(True).alias("_drop"))
    rows = obs.withColumn("_m", F.month("date")).join(bad, [*KEY, "_m"], "left")
    return rows.withColumn("temp", F.when(F.col("_drop").isNull(), F.col("temp"))).drop("_drop", "_m")


def without_empty(obs: DataFrame) -> DataFrame:
    """Only stations that have a value."""
    return obs.join(obs.where("temp IS NOT NULL").select(*KEY).distinct(), KEY, "left_semi")


def without_duplicates(obs: DataFrame, meta: DataFrame, cols: list[str]) -> DataFrame:
    """Drops the stations that metadata faults name; a repeated one loses all its rows."""
    bad = qc.duplicate_stations(meta, cols).where("missing OR same OR again").select("station_id").distinct()
    return obs.join(bad, "station_id", "left_anti")


def run_chain(obs: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The observations on the panel's whole grid, with a column of values after each stage."""
    rows = qc.densify(obs).withColumn("raw", F.col("temp"))
    for name, test in stages.items():
        rows = test(rows).withColumn(name, F.col("temp"))
    return rows


def statistics(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Per stage: size of the panel (dates times stations with a value), values, their share, stations,
    and the change against the stage before and against the first, in percent. One pass."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("stage"), F.col(n).alias("v")) for i, n in enumerate(stages)))).alias("s")
    long = rows.select("date", *KEY, each).select("date", *KEY, "s.*")
    per = long.groupBy("i", "stage", *KEY).agg(F.count("v").alias("_n"), F.count("*").alias("_dates"))
    g = per.groupBy("i", "stage").agg(F.sum("_n").alias("n"), F.count_if(F.col("_n") > 0).alias("stations"), F.max("_dates").alias("_dates"))  # a row a stage
    by = W.orderBy("i")
    change = lambda base: F.round(F.try_divide(F.col("n").cast("double"), base) * 100 - 100, 6)
    return g.select("stage", (F.col("_dates") * F.col("stations")).alias("size"), "n", "stations", F.round(F.try_divide(F.col("n") * 100.0, F.col("_dates") * F.col("stations")), 6).alias("available"), change(F.lag("n", 1).over(by)).alias("step"), change(F.first("n").over(by)).alias("total"))


def profile(obs: DataFrame) -> DataFrame:
    """Per network: stations, first and last date, rows, values, missing share, least and greatest."""
    return obs.groupBy("network").agg(
        F.countDistinct("station_id").alias("stations"), F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n_rows"), F.count("temp").alias("n"), F.round(1 - F.count("temp") / F.count("*"), 6).alias("missing"), F.min("temp").alias("low"), F.max("temp").alias("high")
    )


def missing_test(obs: DataFrame, most: float = 0.5) -> DataFrame:
    """Stations lose all values if more than ``most`` of the panel's hours have none. Off by default."""
    share = F.avg(F.col("temp").isNull().cast("double")).over(W.partitionBy(*KEY))
    return obs.withColumn("_s", share).withColumn("temp", F.when(F.col("_s") <= most, F.col("temp"))).drop("_s")
