"""Operator 11 against the library: ids and spans, under several character maps, and as a query."""

import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2, sentencepiece_pb2

from skyledger.llm import pieces

#: Characters that maps replace, join, drop or leave; the escaped space itself; runs of spaces.
ALPHABET = ["a", "b", "é", "é", " ", "  ", "▁", "　", "ｈ", "ﬁ", "①", "㌔", "\n", "\t", "x", "½", "\U0001f600", "한", "​", "﻿", "Å", "ｶﾞ", "一", "the ", "<s>", "<0x41>", "ing", "\x00", "..."]


def texts(seed, n=150):
    rng = random.Random(seed)
    found = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12) if rng.random() < 0.9 else 150)) for _ in range(n)]
    return ["", " ", "   ", "▁", "x", *found]


def library(model, text):
    held = sentencepiece_pb2.SentencePieceText()
    held.ParseFromString(model.encode(text, out_type="serialized_proto"))
    return [[p.id for p in held.pieces], [p.begin for p in held.pieces], [p.end for p in held.pieces]]


def variant(rule, squeeze, prefix, fallback):
    """The public model with another normaliser: its map comes compiled from the library."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    spec = model.normalizer_spec
    spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = prefix, squeeze, True
    if not fallback:
        model.trainer_spec.byte_fallback = False
        for p in model.pieces:
            p.type = pieces.CONTROL if p.type == pieces.BYTE else p.type
    return model.SerializeToString()


@pytest.mark.parametrize(("rule", "squeeze", "prefix", "fallback"), [("identity", False, True, True), ("identity", True, True, True), ("nmt_nfkc", True, True, True), ("nmt_nfkc", False, False, True), ("nfkc", True, False, False), ("nmt_nfkc_cf", False, True, False)])
def test_ids_and_spans_under_maps(rule, squeeze, prefix, fallback):
    proto = variant(rule, squeeze, prefix, fallback)
    own, theirs = pieces.Encoder(proto=proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    all_texts = texts(rule)
    for t, got in zip(all_texts, own.encode(all_texts), strict=True):
        assert [x.tolist() for x in got] == library(theirs, t), repr(t)


def test_a_text_without_spaces():
    long = "ab" * 200_000
    assert pieces.Encoder(pieces.model_path()).encode([long])[0][0].tolist() == sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()).encode(long)


def test_longest_key_wins_and_spans_go_back():
    own = pieces.Encoder(proto=variant("nfkc", False, False, True))
    assert own.map.longest("éx".encode(), 0) == (3, "é".encode())
    assert own.map.longest(b"ex", 0) is None
    norm, origin = own.normalise("ﬁx é")
    assert norm == "fix▁é" and origin.tolist() == [0, 0, 3, 4, 4, 4, 5, 5, 8]


def test_other_models_are_refused():
    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError, match="BPE"):
        pieces.Encoder(proto=model.SerializeToString())


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pieces.op11(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = model.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
        assert r["span_bytes"] == len(docs[r["doc_id"]].encode())


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (4, "a b", "y"), (4, "a b", "y"), (5, "long word " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = pieces.encode(df)
    got = enc.collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in got)[:2] == [(0, 2), (1, 0)]
    by = {r["doc_id"]: r for r in got}
    assert by[2]["ids"] == by[1]["ids"] == [] and by[4]["ids"] == by[None]["ids"] and sum(r["doc_id"] == 4 for r in got) == 2
    assert by[4]["begins"] == [0, 1] and by[4]["ends"] == [1, 3]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(enc).collect()}
    assert back == {1: "", 2: "", None: "a b", 4: "a b", 5: "long word " * 30_000}
    assert pieces.digests(df.limit(0)).collect() == []
