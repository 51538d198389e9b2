"""JPEG for intra-coded video frames: a lossless encoder (process 14, SOF3) and a decoder for
lossless and baseline frames, in numpy.

The encoder's Huffman table gives size category c a code of 9 - c bits (c = 0..8), so that code and
extra bits take 9 bits for every sample: an ordinary table for any reader, and one that numpy can
write and read for all samples at once. The decoder takes that way whenever a table has one total
length; other tables are read bit by bit.
"""

from __future__ import annotations

import struct

import numpy as np

SYMBOL_BITS = 9


def _table() -> np.ndarray:
    """9-bit symbol of each difference -255..255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        ones = ((1 << (8 - c)) - 1) << (c + 1)
        out[d + 255] = ones | (d if d >= 0 else d + (1 << c) - 1)
    return out


_SYMBOL = _table()
_DIFF = np.zeros(512, np.int16)
_DIFF[_SYMBOL] = np.arange(-255, 256)
_HEAD = b"\xff\xd8\xff\xc4" + struct.pack(">HB", 28, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """frames: (n, height, width) of 8-bit samples, height * width a multiple of 8. One JPEG each."""
    n, height, width = frames.shape
    x = frames.astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]  # predictor 1: the sample to the left, in the first column the one above
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    s = _SYMBOL[d.reshape(n, -1, 8) + 255]
    out = np.empty((n, s.shape[1], 9), np.uint8)
    for k in range(9):
        high = s[:, :, k - 1] << (8 - k) if k else 0
        out[:, :, k] = (high | (s[:, :, k] >> (k + 1) if k < 8 else 0)) & 255
    sof = b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, height, width, 1, 1, 0x11, 0)
    sos = b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
    return [_HEAD + sof + sos + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in out]


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("jpeg: the scan ends early")
        return (self.value >> self.left) & ((1 << n) - 1)

    def code(self, codes: dict[tuple[int, int], int]) -> int:
        at = 0
        for n in range(1, 17):
            at = (at << 1) | self.take(1)
            if (n, at) in codes:
                return codes[n, at]
        raise ValueError("jpeg: no such code")

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    out, at, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, at] = values[k]
            at, k = at + 1, k + 1
        at <<= 1
    return out


def _segments(data: bytes):
    """(marker, body) of each segment; of the scan, its header and its bytes without stuffing."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("jpeg: no start")
    at = 2
    while at + 4 <= len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            end = len(data) if end < 0 else end
            yield marker, (body, data[at:end])
            at = end
        else:
            yield marker, body


def decode(data: bytes) -> np.ndarray:
    """Samples of one frame: (height, width), or (height, width, components)."""
    tables: dict[int, dict] = {}
    quant: dict[int, np.ndarray] = {}
    frame, restart = None, 0
    for marker, body in _segments(data):
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            frame = (marker, bits, height, width, [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n)])
        elif 0xC5 <= marker <= 0xCF and marker not in (0xC8, 0xCC) or marker == 0xC2:
            raise ValueError("jpeg: this process is not supported")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("jpeg: scan before frame")
            head, scan = body
            ids = {head[1 + 2 * i]: head[2 + 2 * i] for i in range(head[0])}
            if frame[0] == 0xC3:
                return _lossless(frame, ids, head[1 + 2 * head[0]], scan, tables)
            return _baseline(frame, ids, scan, tables, quant, restart)
    raise ValueError("jpeg: no scan")


def symbols(scan: bytes, n: int) -> np.ndarray:
    """Differences of n samples (a multiple of 8) from a scan of the encoder's own table."""
    raw = np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8, n // 8 * 9).reshape(-1, 9).astype(np.uint16)
    s = np.empty((len(raw), 8), np.uint16)
    for k in range(8):
        s[:, k] = ((raw[:, k] << (k + 1)) | (raw[:, k + 1] >> (7 - k))) & 511
    return _DIFF[s].reshape(-1)


def undo(d: np.ndarray) -> np.ndarray:
    """Samples from differences of predictor 1: (n, height, width)."""
    x = d.astype(np.int32)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], 1)
    return (np.cumsum(x, 2) & 255).astype(np.uint8)


def _lossless(frame, ids, predictor, scan, tables) -> np.ndarray:
    _, bits, height, width, comps = frame
    if len(comps) != 1 or bits != 8 or predictor not in range(1, 8):
        raise ValueError("jpeg: lossless frames of one 8-bit component only")
    codes = tables[ids[comps[0][0]] >> 4]
    n = height * width
    if predictor == 1 and codes == tables_of_encoder() and n % 8 == 0:
        return undo(symbols(scan, n).reshape(1, height, width))[0]
    b = _Bits(scan.replace(b"\xff\x00", b"\xff"))
    x = np.zeros((height, width), np.int64)
    for i in range(height):
        for j in range(width):
            left, up, corner = (int(x[i, j - 1]) if j else 0), (int(x[i - 1, j]) if i else 0), (int(x[i - 1, j - 1]) if i and j else 0)
            if i == 0 and j == 0:
                guess = 1 << (bits - 1)
            elif i == 0:
                guess = left
            elif j == 0:
                guess = up
            else:
                guess = (left, up, corner, left + up - corner, left + ((up - corner) >> 1), up + ((left - corner) >> 1), (left + up) >> 1)[predictor - 1]
            x[i, j] = (guess + b.signed(b.code(codes))) & 0xFFFF
    return x.astype(np.uint8)


def tables_of_encoder() -> dict[tuple[int, int], int]:
    return _codes(_HEAD[7:23], _HEAD[23:32])


def _zigzag() -> np.ndarray:
    """Place (row * 8 + column) of each coefficient in the order of a scan."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


_ZIGZAG = _zigzag()
_COS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def _baseline(frame, ids, scan, tables, quant, restart) -> np.ndarray:
    _, _, height, width, comps = frame
    across, down = max(c[1] >> 4 for c in comps), max(c[1] & 15 for c in comps)
    cols, rows = -(-width // (8 * across)), -(-height // (8 * down))
    planes = [np.zeros((rows * (c[1] & 15) * 8, cols * (c[1] >> 4) * 8)) for c in comps]
    runs = _restarts(scan)
    b, last = _Bits(runs[0]), [0] * len(comps)
    for unit in range(rows * cols):
        if restart and unit and unit % restart == 0:
            b, last = _Bits(runs[unit // restart]), [0] * len(comps)
        for k, (name, sampling, q) in enumerate(comps):
            dc, ac = tables[ids[name] >> 4], tables[16 | (ids[name] & 15)]
            for y in range(sampling & 15):
                for x in range(sampling >> 4):
                    block = np.zeros(64)
                    last[k] += b.signed(b.code(dc))
                    block[0], i = last[k], 1
                    while i < 64:
                        rs = b.code(ac)
                        if rs == 0:
                            break
                        i += rs >> 4
                        if rs != 0xF0:
                            block[i] = b.signed(rs & 15)
                        i += 1
                    grid = np.zeros(64)
                    grid[_ZIGZAG] = block * quant[q]
                    top, side = (unit // cols * (sampling & 15) + y) * 8, (unit % cols * (sampling >> 4) + x) * 8
                    planes[k][top : top + 8, side : side + 8] = _COS @ grid.reshape(8, 8) @ _COS.T + 128
    out = []
    for c, plane in zip(comps, planes, strict=True):
        whole = plane.repeat(down // (c[1] & 15), 0).repeat(across // (c[1] >> 4), 1)
        out.append(np.clip(np.rint(whole[:height, :width]), 0, 255).astype(np.uint8))
    return out[0] if len(out) == 1 else np.stack(out, 2)


def _restarts(scan: bytes) -> list[bytes]:
    """The scan between restart markers, without stuffing."""
    out, start, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at])
            start = at + 2
        at += 2
    return [x.replace(b"\xff\x00", b"\xff") for x in [*out, scan[start:]]]
