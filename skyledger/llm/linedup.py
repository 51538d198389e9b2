"""Operator 8: line dedup with a deletion-neighbourhood join.

A line is its sequence of words; two lines are the same if they have the same words or are one word
edit apart (one word put in, left out or replaced). The earliest line, by (doc_id, line number),
stays; a line goes if an earlier one of the corpus is the same.

Exact copies meet by their hash. For the rest every line gives all variants with one word left out
as hashed keys, and equal variants are joined:

* two lines of equal length are one edit apart exactly if they share a variant with the word left
  out at the same place, so that place is part of the key, and the members of a key are all within
  the bound of each other: its earliest member is the only one that matters;
* a line and a longer one are one edit apart exactly if a variant of the longer one is the shorter
  line as a whole.

So a key needs no more than a min, whatever its number of lines, and no pairs of a group are made.
The partners found this way are then verified by edit distance on the words themselves. Lines whose
first half and second half both occur in no other line of a length that could match cannot have a
partner and give no variants (a lossless filter: one edit leaves one half as it is).

Defined cases: null and empty texts have no lines and stay as they are; lines under ``min_words``
words are kept and compared with nothing, lines under ``fuzzy_words`` are compared for equality
only; a null doc_id comes before all others; rows that share a doc_id count as one document, so
repeated rows keep the same lines; of lines that could each stay, the one with the least (doc_id,
line number) does; very long texts and lines are compared as a whole; an empty table gives an empty
result; other columns are passed through by ``dedup`` whatever their names, and a column that is
called n_lines_removed is replaced by the count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, id_key, map_arrow, mix64, release, table, word_hashes

#: Words from which a line is compared.
MIN_WORDS = 5
#: Words from which one edit is allowed.
FUZZY_WORDS = 8
#: What op8 and the pipeline take: every line that has a word is compared, and an edit may be up to a
#: fifth of a line. (One edit of a line of one word would make all of them the same.)
WHOLE = {"min_words": 1, "fuzzy_words": 5}
#: Buckets of document ids, the size bound of a broadcast set.
BUCKETS = 1 << 20


def norm(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").split()


def line_hash(tokens: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(tokens))


def _signed(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def half_keys(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of the halves that a partner must share, four a line: as the shorter line of a pair, and
    as the longer one of a pair whose shorter line has one word less. hashes: of the words of all
    lines, one after the other."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = (np.arange(len(hashes)) - starts[row] + 1).astype(np.uint64)
    rear = lengths[row].astype(np.uint64) - place + np.uint64(1)
    # Halves' hashes are sums, so that every half costs two lookups.
    zero = np.zeros(1, np.uint64)
    fore = np.concatenate([zero, np.cumsum(mix64(hashes + place * np.uint64(0x9E3779B97F4A7C15)))])
    back = np.concatenate([zero, np.cumsum(mix64(hashes + rear * np.uint64(0xC2B2AE3D27D4EB4F)))])
    out = np.empty((len(lengths), 4), np.uint64)
    for i, short in enumerate((lengths, lengths - 1)):
        tag = 2 * short.astype(np.uint64)
        half = short // 2
        out[:, 2 * i] = mix64(fore[starts + half] - fore[starts] + tag)
        out[:, 2 * i + 1] = mix64(back[ends] - back[ends - (short - half)] + tag + np.uint64(1))
    return out.view(np.int64)


def lines(docs: DataFrame, min_words: int, fuzzy_words: int) -> DataFrame:
    """_k, pos, h, halves: one row per compared line; no text."""

    def run(slices):
        for s in slices:
            k, pos, h, sizes, every = [], [], [], [], []
            for doc, text in zip(s["_k"], s["text"], strict=True):
                for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    tokens = line.split()
                    if len(tokens) >= min_words:
                        k.append(doc), pos.append(i), h.append(line_hash(tokens)), sizes.append(len(tokens))
                        every += tokens
            if k:
                lengths = np.array(sizes)
                keys = half_keys(word_hashes(every), lengths)
                fuzzy_line = lengths >= fuzzy_words
                offsets = np.concatenate([[0], np.cumsum(4 * fuzzy_line)]).astype(np.int32)
                halves = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[fuzzy_line].ravel()))
                yield {"_k": k, "pos": pos, "h": _signed(h), "halves": halves}

    return map_arrow(docs.select(id_key(F.col("doc_id")).alias("_k"), "text"), run, "_k long, pos int, h long, halves array<long>")


def variants(texts: DataFrame) -> DataFrame:
    """texts: h, line, _k, pos. Rows (key, short, h, _k, pos): a key for each word left out, with
    its place, and the keys that tie a line to those one word shorter or longer."""

    def run(slices):
        for s in slices:
            out: dict[str, list] = {"key": [], "kind": [], "h": [], "_k": [], "pos": []}
            for h, line, k, pos in zip(s["h"], s["line"], s["_k"], s["pos"], strict=True):
                x = word_hashes(norm(line))
                n = len(x)
                place = np.arange(n + 1, dtype=np.uint64)
                at = mix64(x + place[:n] * np.uint64(0x9E3779B97F4A7C15))
                before = mix64(x[1:] + place[: n - 1] * np.uint64(0x9E3779B97F4A7C15))  # a place to the left
                fore = np.concatenate([[np.uint64(0)], np.cumsum(at)])
                rear = np.concatenate([np.cumsum(before[::-1])[::-1], [np.uint64(0)]])
                left = mix64(fore[:n] + rear)  # the line without word i
                same = mix64(left + (place[:n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                whole = mix64(fore[n:])
                out["key"].append(np.concatenate([same, np.unique(left), whole]))
                m = len(np.unique(left))
                out["kind"] += [0] * n + [1] * m + [2]
                for c, v in (("h", h), ("_k", k), ("pos", pos)):
                    out[c] += [v] * (n + m + 1)
            yield {**out, "key": np.concatenate(out["key"]).view(np.int64) if out["key"] else []}

    return map_arrow(texts.select("h", "line", "_k", "pos"), run, "key long, kind int, h long, _k long, pos int")


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Edit distance of at most one, on words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def fuzzy(docs: DataFrame, first: DataFrame) -> DataFrame:
    """h of lines that have an earlier partner one edit away. first: h, _k, pos, halves."""
    halves = first.select("h", F.explode("halves").alias("key"))
    shared = halves.groupBy("key").agg(F.min("h").alias("_lo"), F.max("h").alias("_hi")).where("_lo <> _hi").select("key")
    alive = halves.join(shared, "key", "left_semi").select("h").distinct()
    alive = cut(first.select("h", "_k", "pos").join(alive, "h"))
    wanted = alive.groupBy("_k").agg(F.collect_list(F.struct("pos", "h")).alias("want"))  # bounded by a document's lines
    # Documents that share no bucket of ids with a wanted one need not move: BUCKETS rows at most.
    slot = F.pmod(F.xxhash64("_k"), F.lit(BUCKETS)).alias("_slot")
    rows = docs.select(id_key(F.col("doc_id")).alias("_k"), "text").withColumn("_slot", slot)
    rows = rows.join(F.broadcast(alive.select(slot).distinct()), "_slot", "left_semi").drop("_slot").join(wanted, "_k")

    def pick(slices):
        for s in slices:
            out: dict[str, list] = {"h": [], "line": [], "_k": [], "pos": []}
            for k, text, want in zip(s["_k"], s["text"], s["want"], strict=True):
                split = (text or "").split("\n")
                for w in want:
                    # Rows may share a doc_id: the line must be the one that was hashed.
                    if w["pos"] < len(split) and int(_signed([line_hash(norm(split[w["pos"]]))])[0]) == w["h"]:
                        for c, v in (("h", w["h"]), ("line", split[w["pos"]]), ("_k", k), ("pos", w["pos"])):
                            out[c].append(v)
            yield out

    texts = cut(map_arrow(rows, pick, "h long, line string, _k long, pos int").dropDuplicates(["h"]))
    keys = cut(variants(texts))
    when = F.struct("_k", "pos", "h")
    best = keys.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, when)).alias(f"first{k}") for k in (0, 1, 2)))
    found = keys.join(best, "key").withColumn("first", F.expr("CASE kind WHEN 0 THEN first0 WHEN 1 THEN first2 ELSE first1 END"))
    pairs = found.where((F.col("first") < when) & (F.col("first.h") != F.col("h"))).select("h", F.col("first.h").alias("e")).distinct()
    both = pairs.join(texts.select("h", F.col("line").alias("x")), "h").join(texts.select(F.col("h").alias("e"), F.col("line").alias("y")), "e")

    def check(slices):
        for s in slices:
            yield {"h": [h for h, x, y in zip(s["h"], s["x"], s["y"], strict=True) if within_one(norm(x), norm(y))]}

    out = cut(map_arrow(both.select("h", "x", "y"), check, "h long").distinct())
    for done in (keys, texts, alive):
        release(done)
    return out


def removed(docs: DataFrame, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """_k, gone: list of (pos, h) of the lines that go, for documents that have any."""
    every = cut(lines(docs, min_words, fuzzy_words))
    when = F.struct("_k", "pos")
    first = every.groupBy("h").agg(F.min(when).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    first = cut(first.select("h", "first._k", "first.pos", "n", "halves"))
    near = fuzzy(docs, first).withColumn("near", F.lit(True))
    again = first.join(near, "h", "left").where("n > 1 OR near").select("h", F.col("_k").alias("k0"), F.col("pos").alias("pos0"), "near")
    # Where a line repeats often, its rows are on the side that Spark splits.
    gone = every.select("h", "_k", "pos").join(again, "h").where("near OR _k <> k0 OR pos <> pos0")
    return gone.groupBy("_k").agg(F.collect_set(F.struct("pos", "h")).alias("gone"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, text without the lines that go, and n_lines_removed."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_lines_removed"])
    key, gone_key, gone_col = fresh(docs, "_k", "_gone_k", "_gone")
    gone = removed(docs, min_words, fuzzy_words).toDF(gone_key, gone_col)
    rows = docs.withColumn(key, id_key(F.col("doc_id"))).join(gone, F.col(key) == F.col(gone_key), "left").drop(key, gone_key)
    kept = [f for f in rows.schema.fields if f.name != gone_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_lines_removed int"

    def run(slices):
        for s in slices:
            texts, counts = [], []
            for text, out in zip(s["text"], s.pop(gone_col), strict=True):
                n = 0
                if out and text is not None:
                    drop = {(w["pos"], w["h"]) for w in out}
                    at = {w["pos"] for w in out}
                    split = text.split("\n")
                    stay = [line for i, line in enumerate(split) if i not in at or (i, int(_signed([line_hash(norm(line))])[0])) not in drop]
                    n = len(split) - len(stay)
                    text = "\n".join(stay)
                texts.append(text), counts.append(n)
            yield s | {"text": texts, "n_lines_removed": counts}

    return map_arrow(rows, run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, the lines removed, and the text that stays, as length and digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = F.when(F.col("text").isNull(), 0).otherwise(F.length(F.regexp_replace("text", "[^\n]+", "")) + 1)
    out = dedup(docs.withColumn("n_lines", before.cast("int")), **WHOLE)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_lines_removed", F.length(text).alias("n_chars_kept"), F.md5(text.cast("binary")).alias("text_md5"))
