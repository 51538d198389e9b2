"""Operator 11: SentencePiece encoding that keeps the place of every piece in the original bytes, and
decoding.

A text is normalised by the model's own compiled character map: at each place the longest key of the
map (a double-array trie of bytes) is replaced, other characters stay, spaces are escaped and the
dummy prefix comes first, all as the model's flags say. While that is done an alignment is kept: for
every normalised byte the original byte that it comes from. The normalised text is split into pieces
by the model's merges (the library's, with its own normaliser off), characters without a piece into
byte pieces, and the alignment projects each piece to its span of original bytes: [begin, end).

Characters that stand side by side in some piece of the vocabulary form classes (letters of a script,
signs); no merge crosses from one class to another, or into the spaces before a word from its left. So
a text is split there, and a memo of the parts saves most of the work. Of a character's byte pieces
the last has its span and the others are empty, as in the library.

Takes BPE models with whitespace as a prefix and without user-defined or unused pieces; refuses others.

Defined cases: null counts as empty, which has no pieces and decodes to the empty text; texts of any
length are encoded whole; equal texts have equal rows, and repeated rows each have theirs; of equally
good merges the leftmost comes first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import array
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMOS, map_arrow, table

SPACE = "▁"
#: Parts whose ids a Python worker remembers.
PARTS = 300_000
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2  # of the model file's format


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def char_class(chars) -> str:
    """A regular expression for one of the characters, by ranges; for none of all if there are none."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    inner = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)
    return f"[{inner}]" if inner else "(?!)"


def classes(pieces: list[str]) -> list[set[str]]:
    """Sets of characters that neighbourhood in some piece connects, the largest first."""
    of: dict[str, set[str]] = {}
    for p in pieces:
        for a, b in zip(p, p[1:]):
            small, large = sorted((of.setdefault(a, {a}), of.setdefault(b, {b})), key=len)
            if small is not large:
                large |= small
                of.update((c, large) for c in small)
    return sorted({id(c): c for c in of.values()}.values(), key=len, reverse=True)


class CharMap:
    """A compiled character map: a size, a double array of 32-bit units, replacements that end in 0."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        keys = [k.decode("utf-8", "ignore") for k in self.keys()]
        single = {k[0] for k in keys if len(k) == 1}
        longer = [k for k in keys if len(k) > 1]
        #: Where a key may begin: alone, or by its first two characters.
        self.starts = re.compile(f"{char_class(single)}|{char_class({k[0] for k in longer})}(?={char_class({k[1] for k in longer})})") if keys else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def keys(self) -> list[bytes]:
        units = np.array(self.units, np.uint32)
        labels, bytes_ = units & np.uint32(0x800000FF), np.arange(1, 256, dtype=np.int64)
        found, todo = [], [(self._offset(self.units[0]), b"")] if self.units else []
        while todo:
            base, key = todo.pop()
            at = base ^ bytes_
            inside = at < len(units)
            for byte in bytes_[inside][labels[at[inside]] == bytes_[inside]].tolist():
                child = base ^ byte
                if self.units[child] >> 8 & 1:
                    found.append(key + bytes([byte]))
                todo.append((child ^ self._offset(self.units[child]), key + bytes([byte])))
        return found

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest key that begins at ``at``, and what replaces it."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != raw[k]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Encoder(dict):
    """A model: normaliser, merges and, as a dict, the memo from a part of normalised text to its ids
    (32 bit)."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        trainer, norm = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if trainer.model_type != BPE or trainer.treat_whitespace_as_suffix or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with whitespace as a prefix, without user-defined or unused pieces")
        self.prefix, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.map = CharMap(norm.precompiled_charsmap)
        self.sizes = np.array([len(p.piece.encode()) * (p.type == NORMAL) for p in model.pieces])
        self.values = np.array([int(p.piece[3:5], 16) if p.type == BYTE else -1 for p in model.pieces])
        bare = [p.piece.lstrip(SPACE) for p in model.pieces if p.type == NORMAL]
        self.parts = None  # neighbouring unknowns are one piece, or pieces hold spaces inside: texts stay whole
        if trainer.byte_fallback and not any(SPACE in p for p in bare):
            runs = [f"{SPACE}*{char_class(c)}+" for c in classes(bare)]
            self.parts = re.compile("|".join([*runs, f"{SPACE}*.", f"{SPACE}+"]), re.DOTALL)
        #: The library with the model's pieces and merges, but without a normaliser.
        model.normalizer_spec.Clear()
        model.normalizer_spec.name = "identity"
        for flag in ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"):
            setattr(model.normalizer_spec, flag, False)
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the original byte of each of its bytes, with the end behind."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return "", np.zeros(1, np.int64)
        out, align, fixed, done = [], [], [], 0  # bytes, their origins, whether a space must stay
        if self.map.starts is not None:
            char, byte = 0, 0
            for m in self.map.starts.finditer(text):
                if m.start() < char:
                    continue
                byte += len(text[char : m.start()].encode("utf-8", "surrogatepass"))
                char = m.start()
                hit = self.map.longest(raw, byte)
                if hit is None:
                    continue
                length, new = hit
                out += [raw[done:byte], new]
                align += [np.arange(done, byte), np.full(len(new), byte)]
                lead = len(new) - len(new.lstrip(b" "))
                fixed += [np.zeros(byte - done, bool), np.arange(len(new)) >= lead]
                char += len(raw[byte : byte + length].decode("utf-8", "surrogatepass"))
                byte = done = byte + length
        out.append(raw[done:])
        align.append(np.arange(done, len(raw)))
        data, origin = np.frombuffer(b"".join(out), np.uint8), np.concatenate(align) if done else align[0]
        end = len(raw)
        if self.squeeze:
            space = data == 0x20
            behind = np.concatenate([[True], space[:-1]]) if len(space) else space
            keep = ~(space & behind)
            keep[: sum(map(len, fixed))] |= np.concatenate([np.zeros(0, bool), *fixed])
            data, origin = data[keep], origin[keep]
        norm = data.tobytes().decode("utf-8", "surrogatepass") if done or self.squeeze else text
        if self.escape:
            origin = np.repeat(origin, np.where(data == 0x20, 3, 1))
            norm = norm.replace(" ", SPACE)
        mark = SPACE if self.escape else " "
        if self.prefix:
            first = int(origin[0]) if self.squeeze and len(origin) else 0
            norm = mark + norm
            origin = np.concatenate([np.full(len(mark.encode()), first), origin])
        if self.squeeze and norm.endswith(mark):
            norm = norm.rstrip(mark)
            last = len(norm.encode("utf-8", "surrogatepass"))
            end, origin = int(origin[last]), origin[:last]
        return norm, np.append(origin, end)

    def learn(self, parts: list[list[str]]) -> None:
        """Puts what the memo lacks into it."""
        need = set().union(*parts).difference(self)
        if len(self) + len(need) > PARTS:
            self.clear()
            need = set().union(*parts)
        for part, ids in zip(need, self.merges.encode(list(need), num_threads=1), strict=True):
            self[part] = array.array("i", ids).tobytes()

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes of each piece."""
        out, byte = self.sizes[ids], self.values[ids]
        # Of a character's byte pieces the last has all.
        lead = np.flatnonzero((byte >= 0) & (byte & 0xC0 != 0x80))
        width = np.select([byte[lead] >= 0xF0, byte[lead] >= 0xE0, byte[lead] >= 0xC0], [4, 3, 2], 1)
        out[lead + width - 1] = width
        return out

    def segment(self, norms: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of normalised texts, and the normalised bytes of each piece."""
        if self.parts is None:
            from sentencepiece import sentencepiece_pb2

            out = []
            for norm in norms:
                held = sentencepiece_pb2.SentencePieceText.FromString(self.merges.encode(norm, out_type="serialized_proto"))
                out.append((np.array([p.id for p in held.pieces], np.int32), np.array([p.end - p.begin for p in held.pieces], np.int64)))
            return out
        parts = [self.parts.findall(n) for n in norms]
        self.learn(parts)
        ids = [np.frombuffer(b"".join(map(self.__getitem__, p)), np.int32) for p in parts]
        return [(i, self.lengths(i)) for i in ids]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, begins and ends of whole texts: the pieces and their spans of the UTF-8 bytes."""
        found = [self.normalise(t or "") for t in texts]
        out = []
        for (_, origin), (ids, sizes) in zip(found, self.segment([norm for norm, _ in found]), strict=True):
            ends = np.cumsum(sizes, dtype=np.int64)
            out.append((ids, origin[ends - sizes], origin[ends]))
        return out


_LOADED: dict[str, Encoder] = {}
_DECODERS: dict[str, object] = {}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
        MEMOS.append(_LOADED[path])
    return _LOADED[path]


def decoder(path: str):
    import sentencepiece

    if path not in _DECODERS:
        _DECODERS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _DECODERS[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0), pa.int32()))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, begins, ends: one row a document; the i-th piece is bytes begins[i] to ends[i] of
    the text."""
    path = path or model_path()

    def run(slices):
        model = encoder(path)
        for s in slices:
            found = model.encode(s["text"])
            yield {"doc_id": s["doc_id"], **{c: _lists([f[k] for f in found]) for k, c in enumerate(("ids", "begins", "ends"))}}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids, by the library."""
    path = path or model_path()

    def run(slices):
        model = decoder(path)
        for s in slices:
            yield {"doc_id": s["doc_id"], "text": model.decode([i or [] for i in s["ids"]], num_threads=1) if s["ids"] else []}

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What identifies a document's encoding, in the pass that makes it: doc_id, n_tokens, ids_sha256,
    decoded_sha256, span_bytes (bytes of the text that pieces cover), spans_crc32 (of begins, then
    ends, as little-endian 32 bit)."""
    path = path or model_path()

    def run(slices):
        model, back = encoder(path), decoder(path)
        names = [str(i) for i in range(back.get_piece_size())]
        for s in slices:
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "spans_crc32")}
            for doc, (ids, begins, ends) in zip(s["doc_id"], model.encode(s["text"]), strict=True):
                ids = ids.tolist()
                own = hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest()
                decoded = hashlib.sha256(back.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()
                spans = zlib.crc32(ends.astype("<i4").tobytes(), zlib.crc32(begins.astype("<i4").tobytes()))
                row = doc, len(ids), own, decoded, int((ends - begins).sum()), spans
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, spans_crc32 long")


def op11(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
