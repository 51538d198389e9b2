"""Counts of words go to the blocks of documents that have them, packed, without a join."""

import numpy as np
import zstandard
from pyspark.sql import functions as F

from skyledger.llm import contextmix as cm
from tests.llm.test_context_heads import pairs_of


def test_each_block_gets_the_pairs_that_it_has(spark):
    pairs, _ = pairs_of(spark)
    rng = np.random.default_rng(5)
    rows = [(r["w"], r["before"], int(b) // cm.SPAN, cm.signed(1 << int(b) % cm.SPAN), int(c)) for r in pairs.collect() for b, c in zip(rng.choice(150, 3, False), rng.integers(0, 9, 3), strict=True)]
    dealt = spark.createDataFrame(rows, "w binary, before int, span int, mask long, c long")
    summed = dealt.groupBy("w", "before").agg(F.sum("c").alias("c"))
    tree = cm.Tree(np.arange(256))
    heads = cm.Heads(summed.withColumn("head", cm.head_col([])).groupBy("head", "before").agg(F.sum("c").alias("c")).collect(), tree)
    sent = spark.sparkContext.broadcast((heads, tree, []))
    whole = {r["key"]: (r["c"], bytes(r["states"])) for r in cm.price(summed.coalesce(1).sortWithinPartitions("w", "before"), sent).collect()}
    assert len(whole) == pairs.count()
    masks = dealt.groupBy("w", "before", "span").agg(F.sum("c").alias("c"), F.bit_or("mask").alias("mask"))
    got, unpack = {}, zstandard.ZstdDecompressor().decompress
    for r in cm.price_blocks(masks.repartition(4, cm.head_col([])).sortWithinPartitions("w", "before"), sent).collect():
        key, c, sizes = (np.frombuffer(unpack(r[n]), kind) for n, kind in (("key", np.int64), ("c", np.int64), ("sizes", np.int32)))
        flat, ends = unpack(r["states"]), np.cumsum(sizes)
        for k, n, end, size in zip(key.tolist(), c.tolist(), ends.tolist(), sizes.tolist(), strict=True):
            assert (n, flat[end - size : end]) == whole[k]
            assert k not in got.setdefault(r["block"], set())
            got[r["block"]].add(k)
    want: dict = {}
    for w, before, span, mask, _ in rows:
        want.setdefault(span * cm.SPAN + (mask % (1 << 64)).bit_length() - 1, set()).add(int(cm.keys_of([bytes(w)], [before]).view(np.int64)[0]))
    assert got == want and max(got) >= 2 * cm.SPAN


def test_scores_do_not_depend_on_the_blocks(spark, monkeypatch):
    rows = [(i, f"the bird {i % 7} and tree{i % 11} der baum{i} und " + "wald " * (i % 5)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None), (401, "")], "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in cm.lm_scores(docs).collect()}
    monkeypatch.setattr(cm, "BLOCK_BYTES", 150)
    plan = cm.lm_scores(docs)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r["score"] for r in plan.collect()}
    assert set(got) == set(want) and all(abs(got[d] - want[d]) < 1e-4 * max(1, abs(want[d])) for d in want)


def test_words_seen_once_have_like_states(spark):
    words = sorted({b"x%07d" % (i * 7919 % 10_000_000) for i in range(500)})
    tree = cm.Tree(np.arange(256))
    rows = [(bytearray(w), 0, 1) for w in words]
    heads = cm.Heads([{"head": b"x" + w[1:3], "before": 0, "c": 1} for w in words], tree)
    pairs = spark.createDataFrame(rows, "w binary, before int, c long").coalesce(1)
    last = [bytes(r["states"])[-int(tree.length[32]) :] for r in cm.price(pairs, spark.sparkContext.broadcast((heads, tree, []))).collect()]
    # The closing blank of each was seen once behind its word: once its own bits, never the others.
    assert len(last) == len(words) and set(last) == {bytes([1 << 4]) * int(tree.length[32])}
