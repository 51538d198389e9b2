"""Operator 2: media columns. AVI files of motion-JPEG frames, written, read and cut into shots.

A payload of bytes is stored as 8-bit samples of lossless JPEG frames, so it comes back bit by bit.
Reading parses the RIFF index, decodes every intra frame and detects shots where the difference of
two frames' histograms stands out from the differences just before it.

Defined cases: null and empty texts give a payload of 64 zero bytes (n_bytes 0); a null doc_id is
kept; repeated rows are rows of their own, and equal texts give equal values; a very long text is
stored as a whole, in as many frames as it takes; a frame's difference equal to the bar is no cut; an
empty table gives an empty result; other columns are ignored. A file that cannot be parsed raises ValueError in the functions and gives a row with
``error`` set in ``clips``.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import jpeg
from .common import map_arrow, table

WIDTH = 64
#: Rows of samples in a frame at most.
HEIGHT = 64
FPS = 25
BINS = 16
#: A cut: a histogram difference over MIN_CUT and over mean + SPREAD * deviation of the last WINDOW.
WINDOW, SPREAD, MIN_CUT = 8, 2.5, 0.15


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, comment: bytes = b"", fps: int = FPS) -> bytes:
    """An AVI file of motion-JPEG frames with an index."""
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment)) if comment else b""
    movi, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> dict:
    """fps, width, height, comment and the frames' bytes, by the index (or by walking the chunks of
    a file without one)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("avi: no RIFF header")
    out: dict = {"fps": None, "width": 0, "height": 0, "comment": b"", "frames": []}
    movi, index = None, None

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            body = at + 8
            if body + size > end:
                raise ValueError("avi: a chunk runs past its list")
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, body + size)
                else:
                    walk(body + 4, body + size)
            elif name == b"avih":
                micros, out["width"], out["height"] = struct.unpack_from("<I28xII", data, body)
                out["fps"] = 1_000_000 / micros if micros else None
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                out["fps"] = rate / scale if scale else out["fps"]
            elif name == b"ICMT":
                out["comment"] = data[body : body + size]
            elif name == b"idx1":
                index = (body, size)
            at = body + size + (size & 1)

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movi is None:
        raise ValueError("avi: no movi list")
    if index is not None:
        for name, _, at, size in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]):
            if name[2:] in (b"dc", b"db"):
                # Offsets count from the list's kind, in some files from the start of the file.
                start = movi[0] + at if data[movi[0] + at : movi[0] + at + 4] == name else at
                out["frames"].append(data[start + 8 : start + 8 + size])
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = struct.unpack_from("<4sI", data, at)
            if name[2:] in (b"dc", b"db"):
                out["frames"].append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return out


def store(payload: bytes, n_bytes: int) -> bytes:
    """The payload as samples of an AVI file; n_bytes goes into its comment."""
    rows = len(payload) // WIDTH
    n = -(-rows // HEIGHT)
    height = -(-rows // n)
    samples = np.frombuffer(payload + b"\0" * (n * height * WIDTH - len(payload)), np.uint8).reshape(n, height, WIDTH)
    return write_avi(jpeg.encode_lossless(samples), WIDTH, height, b"%d %d" % (n_bytes, len(payload)))


def frames_of(movie: dict) -> np.ndarray:
    """All frames, decoded: (n, height, width)."""
    return np.stack([jpeg.decode(f) for f in movie["frames"]])


def load(data: bytes) -> tuple[bytes, int, np.ndarray]:
    """Payload, n_bytes and frames of a file that ``store`` wrote."""
    movie = read_avi(data)
    n_bytes, size = map(int, movie["comment"].split())
    frames = frames_of(movie)
    return frames.tobytes()[:size], n_bytes, frames


def histograms(frames: np.ndarray, bins: int = BINS) -> np.ndarray:
    n = len(frames)
    grey = frames if frames.ndim == 3 else frames[..., 0]
    level = (grey.reshape(n, -1).astype(np.int64) * bins) >> 8
    return np.bincount((level + np.arange(n)[:, None] * bins).ravel(), minlength=n * bins).reshape(n, bins)


def shots(hist: np.ndarray) -> list[int]:
    """First frames of the shots. A difference is half the L1 distance of two frames' shares; the
    bar adapts to the differences since the last cut, the last WINDOW at most."""
    starts, recent = [0], []
    share = hist / np.maximum(hist.sum(1, keepdims=True), 1)
    for i, d in enumerate((np.abs(share[1:] - share[:-1]).sum(1) / 2).tolist(), 1):
        bar = MIN_CUT
        if recent:
            mean = sum(recent) / len(recent)
            bar = max(bar, mean + SPREAD * (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5)
        if d > bar:
            starts.append(i)
            recent = []
        else:
            recent = [*recent, d][-WINDOW:]
    return starts


def timed_clips(starts: list[int], n: int, fps: float) -> list[tuple[int, int, int, float, float]]:
    """clip, first and last frame, start and end in ms of each shot of n frames."""
    ms = 1000 / fps
    return [(k, a, b - 1, a * ms, b * ms) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]


def clips(movies: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row per shot of each AVI file: id, clip, first and last frame, start and end in ms."""
    import pyarrow as pa

    kind = dict(movies.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    movie = read_avi(data)
                    hist = histograms(frames_of(movie))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((name, None, None, None, None, None, str(e)))
                    continue
                rows += [(name, *c, None) for c in timed_clips(shots(hist), len(hist), movie["fps"] or FPS)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [batch.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "clip", "first_frame", "last_frame", "start_ms", "end_ms", "error"])

    return movies.select(id_col, media_col).mapInArrow(run, f"id {kind}, clip int, first_frame int, last_frame int, start_ms double, end_ms double, error string")


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: the stored form of every whole text."""

    def run(slices):
        for s in slices:
            yield {"doc_id": s["doc_id"], "media": [store(*payload_of(t)) for t in s["text"]]}

    return map_arrow(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text"), run, "doc_id long, media binary")


def digest(data: bytes) -> tuple:
    payload, n_bytes, frames = load(data)
    hist = histograms(frames)
    starts = shots(hist)
    feature = f"frames={len(frames)} size={frames.shape[2]}x{frames.shape[1]} shots={','.join(map(str, starts))} luma={'.'.join(map(str, hist.sum(0).tolist()))}"
    timed = json.dumps([{"clip": k, "first_frame": a, "last_frame": b, "start_ms": s, "end_ms": e} for k, a, b, s, e in timed_clips(starts, len(frames), FPS)])
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(starts), timed


def digests(docs: DataFrame) -> DataFrame:
    """Every whole text stored as media and read back, with features of what was read and its clips
    (JSON: first and last frame, start and end in ms). The stored form lives for a row only, so
    nothing but the digests leaves a task."""

    def run(slices):
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clips", "clips")
        for s in slices:
            rows = [digest(store(*payload_of(t))) for t in s["text"]]
            yield {"doc_id": s["doc_id"], **dict(zip(names, zip(*rows, strict=True), strict=True))}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips int, clips string"
    return map_arrow(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text"), run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
