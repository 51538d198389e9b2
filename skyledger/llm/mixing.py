"""Operator 4: mixing sources to target weights. DataFrame functions only, no Python on the rows.

Every document has a hash-random key. Within a source the documents are sorted by key: key ranges
("buckets") are dealt out over the cluster by (source, bucket), the sums of the buckets are added up
in order, in two levels (buckets inside a block of buckets, blocks inside a source), and each bucket
adds its own documents behind the sum of the buckets before it. No exchange of documents is by source
alone, so no task sees more of a hot source than its buckets, and no Python runs.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null
doc_id has the key of the empty text; of rows with equal keys the lesser doc_id, then the lesser size
comes first; repeated rows are rows of their own, and as ties they may change places; a long text
counts as a whole; an empty table gives an empty result; columns other than the three that are read
are ignored.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, parts

WEIGHTS = (5, 2, 1)
#: Times that a source may be repeated at most.
MAX_EPOCHS = 3
#: Documents of a key range, on average.
BUCKET_ROWS = 2000
#: Buckets of a block, for the second level of prefix sums.
BLOCK_BUCKETS = 1000
#: Sources up to which the table of targets is broadcast; beyond, it is joined in SALTS copies.
BROADCAST_SOURCES = 10_000
SALTS = 16
BIG = "decimal(38,0)"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words of the whole text."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, n_docs, target (double) and budget (words, long).

    Sources by code point, null last, take the weights in turn. A target stops at ``max_epochs``
    times its source's size; the excess is shared again by weight. In the order of cap / weight the
    stopped sources come first, so sums over that order give the fixed point without iteration, in
    whole numbers.
    """
    one = lcm(*weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = s.withColumn("_w", weight.cast(BIG)).withColumn("_cap", (F.col("source_size") * max_epochs).cast(BIG))
    by_ratio = W.orderBy((F.col("_cap") * F.lit(one) / F.col("_w")).cast(BIG), F.col("source").asc_nulls_last())
    upto, every = by_ratio.rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    s = s.withColumns(
        {
            "_all": F.sum(F.col("source_size").cast(BIG)).over(every).cast(BIG),
            "_caps": F.sum("_cap").over(upto).cast(BIG),
            "_rest": (F.sum("_w").over(every) - F.sum("_w").over(upto)).cast(BIG),
        }
    )
    s = s.withColumn("_full", F.col("_caps") * F.col("_w") + F.col("_cap") * F.col("_rest") <= F.col("_all") * F.col("_w"))
    over = lambda c, full: F.coalesce(F.sum(F.when(F.col("_full") == full, F.col(c))).over(every), F.lit(0)).cast(BIG)
    s = s.withColumns({"_left": F.col("_all") - over("_cap", True), "_ws": over("_w", False)})
    share = (F.col("_left") * F.col("_w")).cast(BIG)
    return s.select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share.cast("double") / F.nullif(F.col("_ws"), F.lit(0)).cast("double")).alias("target"),
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.floor(share / F.nullif(F.col("_ws"), F.lit(0)))).cast("long").alias("budget"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, budget, before, taken for every row of ``docs``.

    ``taken``: the words that the mix takes from the document. A source's whole epochs count for
    every document; the words that then remain of the budget are cut off exactly in the order of
    the keys, so the document at the cut may give a part. ``before``: words of the source before it.
    """
    spark = docs.sparkSession
    sized = cut(sizes(docs))
    goals = cut(targets(sized, weights, max_epochs).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_rows)).cast("long")))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = sized.withColumns({"_s": named, "_key": key})
    goals = goals.withColumn("_s", named).drop("source")
    if goals.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(goals), "_s")
    else:
        spread = goals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.hash("_key"), F.lit(SALTS))).join(spread, ["_s", "_salt"]).drop("_salt")
    rows = rows.withColumn("_b", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("_n"), 32))
    # Summed before the documents move, and small.
    sums = cut(rows.groupBy("_s", "_b").agg(F.sum("size").alias("_sum")).withColumn("_c", F.expr(f"_b DIV {BLOCK_BUCKETS}")))
    rows = rows.repartition(parts(spark), "_s", "_b")
    earlier = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    blocks = sums.groupBy("_s", "_c").agg(F.sum("_sum").alias("_all"))
    blocks = blocks.select("_s", "_c", F.coalesce(F.sum("_all").over(earlier("_s").orderBy("_c")), F.lit(0)).alias("_base"))
    sums = sums.withColumn("_in", F.coalesce(F.sum("_sum").over(earlier("_s", "_c").orderBy("_b")), F.lit(0)))
    sums = sums.join(blocks, ["_s", "_c"]).select("_s", "_b", (F.col("_in") + F.col("_base")).alias("_before"))
    inside = W.partitionBy("_s", "_b").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(sums, ["_s", "_b"]).withColumn("before", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.expr("CASE WHEN source_size > 0 THEN budget DIV source_size ELSE 0L END")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - epochs * F.col("source_size") - F.col("before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "budget", "before", (F.col("size") * epochs + part).alias("taken"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s0 AS (
  SELECT source, sum(size) AS source_size FROM sized GROUP BY source
), s1 AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS HUGEINT) AS w,
         CAST(source_size * 3 AS HUGEINT) AS cap, sum(source_size) OVER () AS total FROM s0
), s2 AS (
  SELECT *, sum(cap) OVER o AS caps, sum(w) OVER () - sum(w) OVER o AS rest FROM s1
  WINDOW o AS (ORDER BY cap * 10 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), s3 AS (
  SELECT *, caps * w + cap * rest <= total * w AS is_full FROM s2
), s4 AS (
  SELECT *, total - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS remaining, sum(w) FILTER (NOT is_full) OVER () AS ws FROM s3
), goals AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(remaining * w AS DOUBLE) / CAST(ws AS DOUBLE) END AS target,
         CAST(CASE WHEN is_full THEN cap ELSE CAST(remaining * w AS HUGEINT) // CAST(ws AS HUGEINT) END AS BIGINT) AS budget FROM s4
), placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (budget // source_size)
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""
