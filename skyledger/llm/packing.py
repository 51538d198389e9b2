"""Operator 7: best-fit packing of tokenized documents into sequences.

A document's tokens are its ids, then an end id. Documents longer than a sequence are cut into full
pieces and a rest. Pieces are dealt out by a hash to packers of bounded size; each packer runs an
online best-fit over a fixed number of open bins. Open bins are kept by their free space, and a
bitset over the free spaces finds the least that suffices; if all bins are open and none suffices,
the fullest one closes.

The tokenizer maps white-space words one by one: its normaliser and its pattern never join text
across white space, so the ids of a text are those of its words, and a memo of words saves most of
the work. ``tests/llm/test_packing.py`` holds this against the tokenizer on whole texts.

Defined cases: null and empty texts are the end id alone; a null doc_id is dealt out as the empty
text; repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import os
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMOS, cut, map_arrow, parts, table

SEQUENCE = 2048
END_ID = 0
#: Words whose ids a Python worker remembers.
WORD_MEMO = 1_200_000
#: Open bins of a packer.
OPEN_BINS = 1024
#: Pieces of a packer, on average. A few bins stay part empty at its end.
PACKER_PIECES = 20_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Memo from a word to its ids (32 bit little-endian bytes), for one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, without the end id.

        The tokenizer lower-cases, so A-Z may be mapped before the words are looked up (but not
        where a text may hold one of its special tokens, which it matches as they stand); and a
        comma or a full stop behind a letter or digit is a token sequence of its own."""
        split = []
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            split.append((raw if b"<|" in raw else raw.lower()).split())
        need = set().union(*split).difference(self)
        if len(self) + len(need) > WORD_MEMO:
            self.clear()
            need = set().union(*split)
        ended, whole = [], {b",", b"."}
        for w in need:
            if len(w) > 1 and w[-1] in b",." and w[:-1].decode("utf-8", "replace")[-1].isalnum():
                ended.append(w)
                whole.add(w[:-1])
            else:
                whole.add(w)
        self._learn([w for w in whole if w not in self])
        for w in ended:
            self[w] = self[w[:-1]] + self[w[-1:]]
        return [b"".join(map(self.__getitem__, s)) for s in split]

    def _learn(self, found: list[bytes]) -> None:
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in found], add_special_tokens=False)
        for word, e in zip(found, encoded, strict=True):
            ids = array.array("I", e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            self[word] = ids.tobytes()


_MEMOS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _MEMOS:
        _MEMOS[path] = WordIds(path)
        MEMOS.append(_MEMOS[path])
    return _MEMOS[path]


def pieces(docs: DataFrame, size: int = SEQUENCE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece of each document."""
    path = path or vocabulary()
    end = end_id.to_bytes(4, "little")

    def run(slices):
        ids = encoder(path)
        for s in slices:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, raw in zip(s["doc_id"], ids.texts(s["text"]), strict=True):
                raw += end
                for i, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    for c, v in zip(out, (doc, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[c].append(v)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Online best-fit with a fixed number of open bins. ``put`` gives the bin and the place in it."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.bits, self.bins = 0, [[] for _ in range(size + 1)]  # bit f: a bin with f free
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        own = self.bins[free]
        name = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return name

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length << length
        if fits:
            free = (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            name, free = self.n_bins, self.size
            self.n_bins += 1
        left = free - length
        if left:  # a full bin is closed
            self.bins[left].append(name)
            self.bits |= 1 << left
            self.n_open += 1
        return name, self.size - free


def pack(found: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """found: doc_id, piece, start, length, ids_crc32. Adds sequence_id and offset.

    The number of packers follows the number of pieces, and what a packer gets follows from hashes
    of the pieces alone, in a fixed order: a task that runs again gives the same sequences."""
    n = found.count()
    packers = max(1, -(-n // packer_pieces))
    rows = found.withColumn("_p", F.pmod(F.xxhash64("doc_id", "piece", F.lit(7)), F.lit(packers)).cast("int"))
    rows = rows.repartition(min(packers, max(parts(found.sparkSession), 1)), "_p").sortWithinPartitions("_p", F.xxhash64("doc_id", "piece", F.lit(11)), "doc_id", "piece", "start", "length", "ids_crc32")

    def run(batches):
        packer, bins = None, None
        for batch in batches:
            seq, off = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for i, (p, length) in enumerate(zip(batch.column("_p").to_pylist(), batch.column("length").to_pylist(), strict=True)):
                if p != packer:
                    packer, bins = p, BestFit(size, open_bins)
                name, off[i] = bins.put(length)
                seq[i] = (p << 32) | name
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7(spark, sf_dir: str) -> DataFrame:
    return pack(cut(pieces(table(spark, sf_dir, "documents"))))
