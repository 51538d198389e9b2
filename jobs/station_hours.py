"""Keeps hourly station values and their quality flags current while reading files arrive.

    python -m jobs.station_hours SOURCE OUT [--config FILE]

SOURCE is a Parquet table or folder of readings to which files are added. A file stream takes the
files that its checkpoint (OUT/checkpoint) does not know and ends when there are no more. Each batch

1. adds up its readings by station and hour and writes the sums to OUT/sums/day=D/batch=B,
2. takes the days that it brought readings for and the days beside them, whose first and last hours
   may be judged otherwise now, reads all sums of those days and of one more on each side, and writes
   OUT/hours/day=D anew, and
3. writes what it read and wrote to OUT/log/batch=B.

Each step replaces whole partitions and depends on its input alone, so a batch that failed halfway
runs again with the same result, late readings are taken, and a run without new files does nothing.
No test looks back or ahead over more than ``flat_hours`` hours twice and one more, which must be
less than a day.

Flags, the first that applies: ``limit`` (outside the open range), ``slope`` (at least ``slope`` away
from the hour before), ``flat`` (in ``flat_hours`` hours in a row of which the values differ by less
than ``flat_step``), ``spatial`` (z among all stations of the hour, or too few stations). Null values
and readings without a time or station are left out; an hour's value is rounded to 4 digits.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.operators import qc
from skyledger.sources import panels

from .common import LOG, main, stream_path, write
from .common import config as read_config

CONFIG = "station_hours.json"
SUMS = "date timestamp, station_id string, network string, total double, n long, day string, batch long"
HOURS = "date timestamp, station_id string, network string, temp double, n_readings long, flag string, day string"
LOGGED = "read long, first timestamp, last timestamp, days array<string>, written long, flagged long, batch long"


def hourly_sums(readings: DataFrame, c: dict) -> DataFrame:
    """Sums of the readings by hour, station and network."""
    rows = readings.select(
        F.date_trunc("hour", F.expr(c["time"]).cast("timestamp")).alias("date"),
        F.expr(c["station"]).cast("string").alias("station_id"),
        F.expr(c["network"]).cast("string").alias("network"),
        F.expr(c["value"]).cast("double").alias("value"),
    )
    rows = rows.where("date IS NOT NULL AND station_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    sums = rows.groupBy("date", "station_id", "network").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return sums.withColumn("day", F.date_format("date", "yyyy-MM-dd"))


def flagged(sums: DataFrame, c: dict) -> DataFrame:
    """The hours of all sums with their flags. Each test sees what the ones before it left."""
    hours = sums.groupBy("date", "station_id", "network", "day").agg(F.sum("total").alias("total"), F.sum("n").alias("n_readings"))
    hours = hours.withColumn("temp", F.round(F.col("total") / F.col("n_readings"), 4)).drop("total").withColumns({"value": F.col("temp"), "_hour": F.floor(F.unix_timestamp("date") / 3600)})
    own = W.partitionBy(*qc.KEY).orderBy("_hour")
    n = int(c["flat_hours"])

    def limit(df: DataFrame) -> DataFrame:
        return qc.limit_test(df, c["low"], c["high"])

    def slope(df: DataFrame) -> DataFrame:
        before = F.max("temp").over(own.rangeBetween(-1, -1))
        return df.withColumn("temp", F.when(before.isNull() | (F.abs(F.col("temp") - before) < c["slope"]), F.col("temp")))

    def flat(df: DataFrame) -> DataFrame:
        last = own.rangeBetween(1 - n, 0)
        ends = (F.count("temp").over(last) == n) & (F.max("temp").over(last) - F.min("temp").over(last) < c["flat_step"])
        df = df.withColumn("_ends", F.coalesce(ends, F.lit(False)).cast("int"))
        return df.withColumn("temp", F.when(F.max("_ends").over(own.rangeBetween(0, n - 1)) == 0, F.col("temp"))).drop("_ends")

    def spatial(df: DataFrame) -> DataFrame:
        return qc.z_score_test(df, c["least_stations"], c["z_bound"])

    hours = hours.withColumn("flag", F.lit(None).cast("string"))
    for test in (limit, slope, flat, spatial):
        failed = F.col("_had") & F.col("temp").isNull()
        hours = test(hours.withColumn("_had", F.col("temp").isNotNull())).withColumn("flag", F.coalesce("flag", F.when(failed, test.__name__)))
    return hours.select("date", "station_id", "network", F.col("value").alias("temp"), "n_readings", "flag", "day")


def around(days: set[date], reach: int) -> list[str]:
    return sorted({(d + timedelta(k)).isoformat() for d in days for k in range(-reach, reach + 1)})


def take(batch: DataFrame, number: int, out: str, c: dict) -> None:
    """One batch of new readings."""
    spark = batch.sparkSession
    write(hourly_sums(batch, c).withColumn("batch", F.lit(number).cast("long")), f"{out}/sums", ["day", "batch"])
    sums = spark.read.schema(SUMS).parquet(f"{out}/sums")
    new = sums.where(F.col("batch") == number)
    # A row a day of the batch: as many as the calendar has.
    by_day = new.groupBy("day").agg(F.sum("n").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).collect()
    days = {date.fromisoformat(r["day"]) for r in by_day}
    if not days:
        LOG.info("station_hours: batch %d has no readings", number)
        return
    context = sums.where(F.col("day").isin(around(days, 2)))
    write(flagged(context, c).where(F.col("day").isin(around(days, 1))), f"{out}/hours", ["day"])
    done = spark.read.schema(HOURS).parquet(f"{out}/hours").where(F.col("day").isin(around(days, 1)))
    counts = done.agg(F.count("*"), F.count("flag")).first()
    line = (sum(r["n"] for r in by_day), min(r["first"] for r in by_day), max(r["last"] for r in by_day), around(days, 0), counts[0], counts[1], number)
    write(spark.createDataFrame([line], LOGGED).coalesce(1), f"{out}/log", ["batch"])
    LOG.info("station_hours: batch %d read %d readings of %d days (%s to %s), wrote %d hours, %d flagged", number, line[0], len(days), line[1], line[2], line[4], line[5])


def run(spark: SparkSession, source: str, out: str, c: dict | None = None) -> DataFrame:
    """Takes what is new in ``source`` and returns all hours as they stand then."""
    c = c or read_config(spark, None, CONFIG)
    if 2 * int(c["flat_hours"]) + 1 >= 24:
        raise ValueError("flat_hours must be less than 12: the tests must not look over more than a day")
    out = out.rstrip("/")
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(c["files_per_batch"])).parquet(stream_path(spark, source))
    started = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, out, c)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(HOURS).parquet(f"{out}/hours")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all events into one new folder; the hours after the second."""
    out = panels.work_folder(spark, "station-hours")
    c = read_config(spark, None, CONFIG) | QUERY_SETTINGS
    for _ in range(2):
        hours = run(spark, f"{sf_dir}/events.parquet", out, c)
    return hours.select(F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("station_id").cast("long").alias("station_id"), "network", "temp", "n_readings", "flag", "day")


#: The given events have values from 0 up that jump from hour to hour: bounds under which each test finds some.
QUERY_SETTINGS = {"low": 1, "high": 200, "slope": 120, "flat_step": 40, "flat_hours": 2}

SQL = """WITH raw AS (SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS date, user_id % 10 AS station_id, CASE WHEN user_id % 3 = 0 THEN 'ows' ELSE 'cws' END AS network, round(sum(value) / count(value), 4) AS temp, count(value) AS n_readings
  FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2, 3),
l AS (SELECT *, CASE WHEN temp > 1 AND temp < 200 THEN temp END AS a FROM raw),
s AS (SELECT l.*, CASE WHEN p.a IS NULL OR abs(l.a - p.a) < 120 THEN l.a END AS b FROM l LEFT JOIN l p ON p.station_id = l.station_id AND p.network = l.network AND p.date = l.date - INTERVAL 1 HOUR),
e AS (SELECT s.*, coalesce(abs(s.b - p.b) < 40, false) AS ends FROM s LEFT JOIN s p ON p.station_id = s.station_id AND p.network = s.network AND p.date = s.date - INTERVAL 1 HOUR),
f AS (SELECT e.*, CASE WHEN e.ends OR coalesce(n.ends, false) THEN NULL ELSE e.b END AS c FROM e LEFT JOIN e n ON n.station_id = e.station_id AND n.network = e.network AND n.date = e.date + INTERVAL 1 HOUR),
z AS (SELECT *, (c - avg(c) OVER w) / nullif(stddev_pop(c) OVER w, 0) AS z, count(c) OVER w AS many FROM f WINDOW w AS (PARTITION BY date))
SELECT strftime(date, '%Y-%m-%d %H:%M:%S') AS date, station_id, network, temp, n_readings,
  CASE WHEN a IS NULL THEN 'limit' WHEN b IS NULL THEN 'slope' WHEN c IS NULL THEN 'flat' WHEN NOT coalesce(many >= 5 AND abs(z) < 1.2815515655446004, false) THEN 'spatial' END AS flag, strftime(date, '%Y-%m-%d') AS day FROM z"""

if __name__ == "__main__":
    main(run, CONFIG, __doc__)
