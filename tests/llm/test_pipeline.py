"""The pipeline's stages on a small table: near-duplicates against brute force, pieces against token counts."""

import numpy as np

import corpus_pipeline
from skyledger.llm import common, packing


def near(a, b):
    both = len(np.intersect1d(a, b))
    return len(a) and len(b) and 100 * both >= 75 * (len(a) + len(b) - both)


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = before = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf))
        assert docs.columns == before.columns and 0 < docs.count()
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "MinHash near-dedup":
            kept = [(r["doc_id"], common.shingles(r["text"])) for r in docs.collect()]
            every = {r["doc_id"]: common.shingles(r["text"]) for r in before.collect()}
            assert not [(a, b) for i, (a, x) in enumerate(kept) for b, y in kept[:i] if near(x, y)]
            names = {a for a, _ in kept}
            # What went is in a kept document's component: found over the links of all.
            reached, todo = set(names), list(names)
            while todo:
                at = todo.pop()
                new = [d for d, y in every.items() if d not in reached and near(every[at], y)]
                reached.update(new)
                todo += new
            assert reached == set(every)
        before = docs
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    memo = packing.encoder(packing.vocabulary())
    want = sum(len(np.frombuffer(ids, "<u4")) + 1 for ids in memo.texts([r["text"] for r in docs.collect()]))
    got = sum(r["length"] for r in pieces)
    assert got == want
    by: dict = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
