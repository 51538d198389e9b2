"""Reports on what came in: missing and unusable values by column, coverage of keys by another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _odd(c: Column) -> Column:
    x = c.cast("double")
    return F.isnan(x) | (F.abs(x) == float("inf"))


def blank(c: Column, kind: T.DataType) -> Column:
    """A text of spaces only, or a list without entries."""
    if isinstance(kind, T.StringType):
        return F.trim(c) == ""
    return F.size(c) == 0 if isinstance(kind, T.ArrayType) else F.lit(False)


def unusable(c: Column, kind: T.DataType) -> Column:
    """A number that is none or endless, or a list that has such an entry or a null."""
    real = (T.DoubleType, T.FloatType)
    if isinstance(kind, real):
        return _odd(c)
    if isinstance(kind, T.ArrayType):
        bad = lambda x: x.isNull() | _odd(x) if isinstance(kind.elementType, real) else x.isNull()
        return F.exists(c, bad)
    return F.lit(False)


def missingness(df: DataFrame, part: str | None = None) -> DataFrame:
    """One row a column, and a part of the table if ``part`` is an SQL expression: n_rows, n_null,
    n_blank, n_unusable, missing_share (all three), mean_length and max_length of texts.

    One pass over the rows for all columns: they are counted side by side and turned afterwards."""
    stats = []
    for f in df.schema.fields:
        c, text = _quoted(f.name), isinstance(f.dataType, T.StringType)
        count = lambda p: F.count_if(F.coalesce(p, F.lit(False)))
        size = F.length(c) if text else F.lit(None).cast("int")
        stats.append(
            F.struct(
                F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("n_rows"), count(c.isNull()).alias("n_null"), count(blank(c, f.dataType)).alias("n_blank"),
                count(unusable(c, f.dataType)).alias("n_unusable"), F.round(F.avg(size), 6).alias("mean_length"), F.max(size).cast("long").alias("max_length"),
            )
        )
    by = F.coalesce(F.expr(part).cast("string"), F.lit("")) if part else F.lit("")
    rows = df.groupBy(by.alias("part")).agg(F.array(*stats).alias("_s")).select("part", F.inline("_s"))
    return rows.withColumn("missing_share", F.round((F.col("n_null") + F.col("n_blank") + F.col("n_unusable")) / F.col("n_rows"), 6))


def coverage(base: DataFrame, other: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """How far the rows of ``other`` reach the keys of ``base``, one row a value: n_keys (distinct keys of
    base), other_rows, other_filled (rows with a value), other_keys (keys with one), n_shared (keys of
    base that have a value), coverage (their share), n_repeated (keys that other has more than once).
    Keys with a null are left out of both. The rows of ``other`` are counted by key before they meet
    the keys, so a frequent key does not multiply anything."""
    whole = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    own = base.where(whole).select(*keys).distinct().withColumn("_base", F.lit(1))
    found = other.where(whole).groupBy(*keys).agg(F.count("*").alias("_rows"), *(F.count(_quoted(v)).alias(f"_v{i}") for i, v in enumerate(values)))
    met = found.join(own, keys, "full_outer")
    is_base, stats = F.col("_base").isNotNull(), []
    for i, v in enumerate(values):
        filled = F.coalesce(F.col(f"_v{i}") > 0, F.lit(False))
        stats.append(
            F.struct(
                F.lit(v).alias("column"), F.count("_base").alias("n_keys"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("other_rows"), F.coalesce(F.sum(f"_v{i}"), F.lit(0)).alias("other_filled"),
                F.count_if(filled).alias("other_keys"), F.count_if(filled & is_base).alias("n_shared"), F.count_if(F.coalesce(F.col("_rows") > 1, F.lit(False))).alias("n_repeated"),
            )
        )
    rows = met.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))
    return rows.withColumn("coverage", F.round(F.try_divide(F.col("n_shared"), F.col("n_keys")), 6))
