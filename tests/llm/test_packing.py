import zlib

import numpy as np

from skyledger.llm import packing


def texts():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    return [*t, None, "", " \n\t", "it's don't, 12.5 e.g. x… Á, <|endoftext|> a<|ENDOFTEXT|>.", " nbsp wide \x1c x", "'s. 3. ²."]


def test_ids_equal_the_tokenizers():
    memo = packing.encoder(packing.vocabulary())
    every = texts()
    whole = memo.tokenizer.encode_batch([t or "" for t in every], add_special_tokens=False)
    for t, e, got in zip(every, whole, memo.texts(every), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.ids, t


def test_best_fit_and_bounded_bins():
    b = packing.BestFit(10, 2)
    assert b.put(6) == (0, 0) and b.put(7) == (1, 0)
    assert b.put(3) == (1, 7)  # the fullest that fits, now full and closed
    assert b.put(5) == (2, 0)
    assert b.put(9) == (3, 0)  # two bins were open: the fullest, 0, closed
    assert b.put(4) == (2, 5)


def test_packing_is_gapless(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(0, texts()[0], "x"), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    found = packing.pieces(docs)
    got = packing.pack(found, packer_pieces=50).collect()
    assert len(got) == found.count()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SEQUENCE
    assert next(r for r in got if r["doc_id"] is None)["length"] == 3
    empty = [r for r in got if r["doc_id"] == len(texts()) - 5]
    assert empty[0]["length"] == 1 and empty[0]["ids_crc32"] == zlib.crc32(b"\0\0\0\0")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs)).count() == 0
