"""Operator 5: quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed token n-grams (one and two tokens) are counted: one over the trusted
documents (labelled quality 1), one over the whole corpus. A document's verdict is the mean log
ratio of its n-grams against a fixed threshold; fixed base rules come before it. Tokens are taken
from white-space words: runs of leading and trailing marks are tokens of their own, and a word that
is not in lower case also gives its case pattern, so that layout and symbol junk is seen apart from
vocabulary.

Defined cases: null and empty texts have no words and fail the base rules; a null doc_id is kept as
it is; repeated rows are scored each; a ratio equal to the threshold keeps the document; a very long
text is read as a whole; without labels, or with an empty table, every ratio is 0 and the base rules
decide alone; other columns are ignored or, by ``keep`` and ``passed``, handed on.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO, MEMOS, map_arrow, table, windows

N_BITS = 18
#: Trusted documents at most that are counted for the target, the first by a hash of their id.
TRUSTED_ROWS = 20_000
#: Mean log ratio below which a document goes.
THRESHOLD = -0.15
#: Added to each count of the target, and to the counts of the corpus scaled to it.
SMOOTHING = 4.0
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"
_SPLIT = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


class Tokens(dict):
    """Memo from a white-space word to its token hashes (32 bit, as bytes)."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        head, core, tail = _SPLIT.match(word.decode("utf-8", "surrogatepass")).groups()
        found = []
        if head:
            found.append("m" + head)
        if core:
            found.append("w" + core.lower())
            if core != core.lower():
                found.append("c" + ("U" if core == core.upper() and len(core) > 1 else "T" if core[1:] == core[1:].lower() else "M"))
        if tail:
            found.append("m" + tail)
        out = self[word] = np.array([xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) for t in found], "<u4").tobytes()
        return out


TOKENS = Tokens()
MEMOS.append(TOKENS)


def ngrams(tokens: list[bytes], n_bits: int = N_BITS) -> np.ndarray:
    """Buckets of the document's unigrams and bigrams."""
    one = np.frombuffer(b"".join(map(TOKENS.__getitem__, tokens)), "<u4").astype(np.uint64)
    shift = np.uint64(64 - n_bits)
    uni = (one * np.uint64(0x9E3779B97F4A7C15)) >> shift
    if len(one) < 2:
        return uni.astype(np.int64)
    again = one[:-1] == one[1:]  # a token that repeats itself is one event, whatever the token
    two = ((one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> shift
    two[again] = np.uint64(1)
    return np.concatenate([uni, two]).astype(np.int64)


def repeated_words(tokens: list[bytes], n: int = 8) -> int:
    """Words inside n-word windows that the text holds twice or more, first ones included."""
    if len(tokens) <= n:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter([ids.setdefault(w, len(ids)) for w in tokens], np.uint64, len(tokens))
    hashes = windows(seq, n)
    order = np.sort(hashes)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    twice = np.isin(hashes, order[1:][same])
    ends = np.zeros(len(tokens) + 1, np.int64)
    ends[: len(hashes)] += twice
    ends[n : n + len(hashes)] -= twice
    return int((np.cumsum(ends)[:-1] > 0).sum())


def base(text: str, tokens: list[bytes]) -> tuple[int, int, int, int, int]:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            again += line in seen
            seen.add(line)
    return len(tokens), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), again, repeated_words(tokens)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """Distinct ids of trusted rows, ``limit`` at most: the first by a hash of the id."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, n_bits: int = N_BITS, trusted_rows: int = TRUSTED_ROWS, smoothing: float = SMOOTHING) -> np.ndarray:
    """The log ratio of every bucket. All documents are counted; what comes to the driver is
    2 ** n_bits counts, whatever the corpus."""
    mark = trusted_ids(labels, trusted_rows).withColumn("_trusted", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(mark), "doc_id", "left").select("text", F.col("_trusted").isNotNull().alias("trusted"))
    size = 1 << n_bits

    def count(slices):
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for s in slices:
            found = [ngrams((t or "").encode("utf-8", "surrogatepass").split(), n_bits) for t in s["text"]]
            if found:
                raw += np.bincount(np.concatenate(found), minlength=size)
            found = [x for x, y in zip(found, s["trusted"], strict=True) if y]
            if found:
                good += np.bincount(np.concatenate(found), minlength=size)
        at = np.flatnonzero(raw)
        yield {"b": at.astype(np.int32), "raw": raw[at], "good": good[at]}

    sums = map_arrow(rows, count, "b int, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(size), np.zeros(size)
    at = sums["b"].to_numpy()
    raw[at], good[at] = sums["raw"].to_numpy(), sums["good"].to_numpy()
    if not good.sum() or not raw.sum():
        return np.zeros(size, np.float32)
    # Both get the same Dirichlet prior, on the target's scale: a bucket that the corpus holds a few
    # times says little, whether or not the target has it.
    expected = raw * (good.sum() / raw.sum())
    return np.log((good + smoothing) / (expected + smoothing)).astype(np.float32)


def score(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, ratio, kept. ``ratios`` has a fixed
    size, so it goes with the task. ``keep``: columns of ``docs`` to return before them instead of
    doc_id; a kept column with the name of a result is replaced by it."""
    found = SCHEMA.partition(", ")[2]
    names = [part.split()[0] for part in found.split(", ")]
    cols = [c for c in keep or ["doc_id"] if c.lower() not in names]
    return map_arrow(_with_text(docs, cols), lambda slices: _scores(slices, ratios, threshold, cols, names), f"{_head(docs, cols)}{found}")


def passed(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules and the ratio keep."""
    cols = docs.columns

    def run(slices):
        for s in _scores(slices, ratios, threshold, cols, [f"\0{i}" for i in range(8)]):
            ok = s["\0007"]
            yield {c: [x for x, y in zip(s[c], ok, strict=True) if y] for c in cols}

    return map_arrow(_with_text(docs, cols), run, _head(docs, cols).removesuffix(", "))


def _with_text(docs: DataFrame, cols: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in cols], *([] if "text" in cols else ["text"]))


def _head(docs: DataFrame, cols: list[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in cols)


def _scores(slices, ratios: np.ndarray, threshold: float, cols: list[str], names: list[str]):
    """Slices with the columns ``cols`` and the eight results under ``names``."""
    n_bits = len(ratios).bit_length() - 1
    for s in slices:
        out: list[list] = [[] for _ in names]
        for text in s["text"]:
            text = text or ""
            tokens = text.encode("utf-8", "surrogatepass").split()
            n, chars, symbols, lines, again = base(text, tokens)
            grams = ngrams(tokens, n_bits)
            ratio = float(ratios[grams].mean(dtype=np.float64)) if len(grams) else 0.0
            failed = n < 20 or 100 * again > 30 * n
            for column, v in zip(out, (n, chars, symbols, lines, again, failed, ratio, not failed and ratio >= threshold), strict=True):
                column.append(v)
        yield {c: s[c] for c in cols} | dict(zip(names, out, strict=True))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")


def op5(spark, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
