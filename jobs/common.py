"""What the jobs share: their command line, configuration, folders and log."""

from __future__ import annotations

import argparse
import json
import logging
import pathlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("jobs")


def config(spark: SparkSession, path: str | None, default: str) -> dict:
    """The settings of the job's own file, and above them those of a file that Spark reads."""
    found = json.loads((pathlib.Path(__file__).parent / default).read_text())
    if path:
        found |= json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    return found


def write(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stream_path(spark: SparkSession, path: str) -> str:
    """A folder as it is; a single file as a pattern that only it matches, since streams take folders
    and patterns."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return f"{at.getParent().toString()}/{{{at.getName()}}}"
    return path


def main(run: Callable[[SparkSession, str, str, dict], DataFrame], default: str, about: str) -> None:
    """The command line: the only place that creates and stops a session."""
    p = argparse.ArgumentParser(description=about)
    p.add_argument("source", help="what is read")
    p.add_argument("out", help="where results, and a checkpoint if there is one, are kept")
    p.add_argument("--config", help="a JSON file of settings that differ from the job's own")
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(about.splitlines()[0]).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.source, args.out, config(spark, args.config, default))
    finally:
        spark.stop()
