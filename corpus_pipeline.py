"""A corpus from raw documents to packed sequences, in stages. Each stage takes all that the one
before it kept; all but the last return the columns of documents.

Defined cases, for every stage: a null or empty text fails the quality rules and goes there; called by
itself, line dedup leaves it as it is, near-dedup links it with nothing, mixing drops it (it has no
words) and packing gives it its end token; a null doc_id is a document that comes before all others;
repeated rows share a fate, and near-dedup leaves one of them; of ties the least doc_id stays; very
long texts are read as a whole; an empty table gives an empty result; further columns, whatever their
names, are handed on as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import linedup, mixing, neardup, packing, quality
from skyledger.llm.common import cut, fresh, id_key, table


def same(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the base rules or the likelihood ratio reject go."""
    return quality.passed(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: lines that an earlier line repeats go; n_chars follows. A document goes only if
    every word of it went."""
    count, was = fresh(docs, "_removed", "_was")
    held = docs.withColumnRenamed("n_lines_removed", was) if "n_lines_removed" in docs.columns else docs
    out = linedup.dedup(held, **linedup.WHOLE).withColumnRenamed("n_lines_removed", count).withColumnRenamed(was, "n_lines_removed")
    left = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    out = out.where((F.col(count) == 0) | left)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*same(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near-duplicates the document with the least id stays, once."""
    key, other = fresh(docs, "_id", "_kept_id")
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).where("kept").select(id_key(F.col("doc_id")).alias(other)).distinct()
    rows = docs.withColumn(key, id_key(F.col("doc_id"))).join(kept, F.col(key) == F.col(other), "left_semi")
    return rows.dropDuplicates([key, "text"]).select(*same(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a document is there as often as the mix takes it; one that the cut falls into is
    there as a whole. Documents without words take nothing and go."""
    key, other, times, copy = fresh(docs, "_id", "_mixed_id", "_times", "_copy")
    often = F.ceil(F.col("taken") / F.col("size")).cast("int")
    mixed = mixing.mix(docs.select("doc_id", "source", "text")).where("taken > 0").select(id_key(F.col("doc_id")).alias(other), often.alias(times))
    mixed = mixed.groupBy(other).agg(F.max(times).alias(times))
    rows = docs.withColumn(key, id_key(F.col("doc_id"))).join(mixed, F.col(key) == F.col(other))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*same(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of the documents with their place in the sequences."""
    return packing.pack(cut(packing.pieces(docs)))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the hashed models, signatures and the tokenizer; tests/llm/test_pipeline.py
#: holds run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a cut after each."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
