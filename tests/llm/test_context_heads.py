"""Words with one beginning: they are told apart by more bytes where too many have it, and counts stay the same."""

import numpy as np
from pyspark.sql import functions as F

from skyledger.llm import contextmix as cm


def pairs_of(spark):
    rng = np.random.default_rng(3)
    words = {b"", b"a", b"an", b"and", b"ander", "ción".encode()} | {b"and" + bytes(rng.integers(97, 100, rng.integers(0, 7)).tolist()) for _ in range(300)} | {bytes(rng.integers(97, 123, 5).tolist()) for _ in range(100)}
    rows = [(w, int(s), int(rng.integers(0, 50))) for w in sorted(words) for s in sorted(set(rng.integers(0, 8, 3).tolist()))]
    return spark.createDataFrame([(bytearray(w), s, c) for w, s, c in rows], "w binary, before int, c long"), sorted(words)


def priced(spark, pairs, levels, tasks):
    tree = cm.Tree(np.arange(256))
    head = cm.head_col(levels)
    heads = cm.Heads(pairs.groupBy(head.alias("head"), "before").agg(F.sum("c").alias("c")).orderBy("head", "before").collect(), tree)
    laid = pairs.repartition(tasks, head).sortWithinPartitions("w", "before")
    return sorted((r["key"], r["c"], bytes(r["states"])) for r in cm.price(laid, spark.sparkContext.broadcast((heads, tree, levels))).collect())


def test_counts_do_not_depend_on_the_heads(spark):
    pairs, words = pairs_of(spark)
    levels = cm.crowded(pairs, 12)
    assert len(levels) >= 4 and all(len(b) == cm.LOCAL + k for k, level in enumerate(levels) for b in level)
    counts = pairs.groupBy(cm.head_col(levels).alias("head")).count().collect()
    assert max(r["count"] for r in counts) <= 12
    of = {bytes(r["w"]): bytes(r["head"]) for r in pairs.select("w", cm.head_col(levels).alias("head")).collect()}
    assert of == {w: (w + b" ")[: cm.head_size(w, levels)] for w in words}
    assert priced(spark, pairs, levels, 5) == priced(spark, pairs, [], 1)


def test_many_words_of_one_beginning_are_many_parts(spark):
    words = sorted({b"and%07d" % (i * 7919 % 10_000_000) for i in range(150_000)})
    levels = cm.crowded(spark.createDataFrame([(bytearray(w),) for w in words], "w binary"))
    slices = [{"w": words[i : i + 10_000], "before": [0] * 10_000, "c": [1] * 10_000} for i in range(0, len(words), 10_000)]
    sizes = [len(w) for w, _, _ in cm.parts_by_head(iter(slices), levels)]
    assert sum(sizes) == len(words) and max(sizes) <= cm.PART_PAIRS + 10_000
