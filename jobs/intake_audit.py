"""Reports what came in before a run builds on it: missing values by column, coverage by key.

    python -m jobs.intake_audit SOURCE OUT [--config FILE]

SOURCE is a folder of Parquet tables (NAME.parquet), texts among them. For every table of the
settings one pass counts, for each column and part of the table, rows, nulls, blank texts or lists,
numbers that are none, and lengths of texts, to OUT/columns/table=T; for every pair of tables it is
found how many of one's keys the other has values for, to OUT/coverage/base=B/other=O. A share of
missing values (or of keys without a value) from ``warn_share`` on is marked ``warn``, and ``empty``
if nothing is there. A table that SOURCE does not have is left out, and the log says so.

Every table's partition is replaced as a whole: a second run gives the same result, and a run that
failed is mended by the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import reports
from skyledger.sources import panels

from .common import LOG, main, write
from .common import config as read_config

CONFIG = "intake_audit.json"
COLUMNS = "part string, column string, n_rows long, n_null long, n_blank long, n_unusable long, mean_length double, max_length long, missing_share double, status string, table string"
COVERAGE = "column string, n_keys long, other_rows long, other_filled long, other_keys long, n_shared long, n_repeated long, coverage double, status string, base string, other string"


def status(missing: Column, warn: float) -> Column:
    return F.when(missing >= 1, "empty").when(missing >= warn, "warn").otherwise("ok")


def table(spark: SparkSession, source: str, name: str) -> DataFrame | None:
    path = f"{source.rstrip('/')}/{name}.parquet"
    if not panels.exists(spark, path):
        LOG.warning("intake_audit: %s is not there", path)
        return None
    return spark.read.parquet(path)


def keyed(df: DataFrame, keys: list[str], own: list[str] | None) -> DataFrame:
    """The columns that are keys under their common names."""
    return df.withColumnsRenamed(dict(zip(own or keys, keys, strict=True)))


def run(spark: SparkSession, source: str, out: str, c: dict | None = None) -> DataFrame:
    """Writes both reports; returns all that OUT has, as one table."""
    c, out = c or read_config(spark, None, CONFIG), out.rstrip("/")
    for name, part in c["tables"].items():
        df = table(spark, source, name)
        if df is None:
            continue
        found = reports.missingness(df, part).withColumns({"status": status(F.col("missing_share"), c["warn_share"]), "table": F.lit(name)})
        write(found.coalesce(1), f"{out}/columns", ["table"])
        rows = spark.read.schema(COLUMNS).parquet(f"{out}/columns").where(F.col("table") == name)
        done = rows.agg(F.sum(F.when(F.col("column") == df.columns[0], F.col("n_rows"))).alias("read"), F.count("*").alias("wrote"), F.count_if(F.col("status") != "ok").alias("noted")).first()
        LOG.info("intake_audit: read %s rows of %s, wrote %d lines, %d of them to be looked at", done["read"], name, done["wrote"], done["noted"])
    for pair in c["coverage"]:
        base, other = (table(spark, source, pair[k]) for k in ("base", "other"))
        if base is None or other is None:
            continue
        keys = pair["keys"]
        found = reports.coverage(keyed(base, keys, pair.get("base_keys")), keyed(other, keys, pair.get("other_keys")), keys, pair["values"])
        found = found.withColumns({"status": status(1 - F.col("coverage"), c["warn_share"]), "base": F.lit(pair["base"]), "other": F.lit(pair["other"])})
        write(found.coalesce(1), f"{out}/coverage", ["base", "other"])
        LOG.info("intake_audit: wrote how far %s covers %s", pair["other"], pair["base"])
    return result(spark, out)


def result(spark: SparkSession, out: str) -> DataFrame:
    """Both reports as one table; what a report does not have is null."""
    found = None
    for name, schema in (("columns", COLUMNS), ("coverage", COVERAGE)):
        rows = spark.read.schema(schema).parquet(f"{out}/{name}") if panels.exists(spark, f"{out}/{name}") else spark.createDataFrame([], schema)
        rows = rows.withColumn("report", F.lit(name))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the given tables into one new folder; the reports after the second."""
    out = panels.work_folder(spark, "intake-audit")
    c = read_config(spark, None, CONFIG)
    for _ in range(2):
        found = run(spark, sf_dir, out, c)
    return found


#: Columns of the given tables by kind: texts, lists, real numbers, others.
KINDS = {
    "documents": "n:doc_id s:text s:lang s:source n:n_chars",
    "conversations": "n:conv_id n:turn s:role s:text",
    "pages": "n:page_id s:url s:html",
    "benchmark": "n:item_id s:text",
    "labels": "n:doc_id n:quality n:toxic",
    "embeddings": "n:vec_id l:embedding n:label",
    "events": "n:event_id n:ts n:user_id s:event_type r:value s:props",
    "supplier": "n:s_suppkey s:s_name n:s_nationkey r:s_acctbal",
}
_LOOK = "CASE WHEN {m} >= 1 THEN 'empty' WHEN {m} >= 0.2 THEN 'warn' ELSE 'ok' END AS status"


def sql() -> str:
    """The same reports over the given tables, made by rule from the settings."""
    import json
    import pathlib

    c = json.loads((pathlib.Path(__file__).parent / CONFIG).read_text())
    out, none = [], "NULL::BIGINT"
    for name, part in c["tables"].items():
        for kind, col in (x.split(":") for x in KINDS[name].split()):
            is_blank = {"s": f"trim({col}) = ''", "l": f"len({col}) = 0"}.get(kind, "false")
            bad = {"r": f"isnan({col}) OR isinf({col})", "l": f"len(list_filter({col}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0"}.get(kind, "false")
            size = f"length({col})" if kind == "s" else none
            by = f"coalesce(CAST({part} AS VARCHAR), '')" if part else "''"
            inner = f"SELECT {by} AS part, count(*) AS n_rows, count(*) FILTER ({col} IS NULL) AS n_null, count(*) FILTER ({is_blank}) AS n_blank, count(*) FILTER ({bad}) AS n_unusable, round(avg({size}), 6) AS mean_length, max({size}) AS max_length FROM {name} GROUP BY 1"
            share = "round((n_null + n_blank + n_unusable) / n_rows, 6)"
            out.append(f"SELECT part, '{col}' AS \"column\", n_rows, n_null, n_blank, n_unusable, mean_length, max_length, {share} AS missing_share, {_LOOK.format(m=share)}, '{name}' AS \"table\", 'columns' AS report, {', '.join(f'{none} AS {k}' for k in ('n_keys', 'other_rows', 'other_filled', 'other_keys', 'n_shared', 'n_repeated'))}, NULL::DOUBLE AS coverage, NULL::VARCHAR AS base, NULL::VARCHAR AS other FROM ({inner})")
    for p in c["coverage"]:
        bk, ok = p.get("base_keys", p["keys"])[0], p.get("other_keys", p["keys"])[0]
        for v in p["values"]:
            inner = f"SELECT (SELECT count(DISTINCT {bk}) FROM {p['base']}) AS n_keys, (SELECT count({ok}) FROM {p['other']}) AS other_rows, (SELECT count({v}) FROM {p['other']} WHERE {ok} IS NOT NULL) AS other_filled, (SELECT count(DISTINCT {ok}) FROM {p['other']} WHERE {v} IS NOT NULL) AS other_keys, (SELECT count(DISTINCT {ok}) FROM {p['other']} WHERE {v} IS NOT NULL AND {ok} IN (SELECT {bk} FROM {p['base']})) AS n_shared, (SELECT count(*) FROM (SELECT {ok} FROM {p['other']} WHERE {ok} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS n_repeated"
            share = "round(n_shared / n_keys, 6)"
            out.append(f"SELECT NULL AS part, '{v}', {none}, {none}, {none}, {none}, NULL::DOUBLE, {none}, NULL::DOUBLE, {_LOOK.format(m=f'1 - {share}')}, NULL, 'coverage', n_keys, other_rows, other_filled, other_keys, n_shared, n_repeated, {share}, '{p['base']}', '{p['other']}' FROM ({inner})")
    return "\nUNION ALL ".join(out)


if __name__ == "__main__":
    main(run, CONFIG, __doc__)
