"""FLAC media columns: lossless storage of bytes as 8-bit samples, and reading them back.

The format is that of RFC 9639, one channel. Frames are coded and decoded many
at a time: numpy steps through sample positions, with one lane for each frame.
The writer gives every frame a seek point; the reader takes frame starts from
them (or finds frames by their sync code and header checksum), verifies both
checksums of each frame and the MD5 of the whole stream, and yields PCM blocks
with their sample offsets. A broken stream raises ValueError. Media are written to
the shared folder before anything is read from them, and stay there as the
operator's product.

Defined cases: null and empty texts store 64 zero bytes. Texts of any length are
cut into frames of BLOCK samples. Repeated rows are stored row by row; equal
texts give equal files. Other columns are ignored. An empty table stores nothing
and gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import materialise
from weft.llm.kernels import byte_lengths, chunks

BLOCK = 2048
PAD = 64
RATE, BITS = 8000, 8
LPC_ORDER, LPC_PRECISION = 6, 10
#: Bytes of payload that are coded or decoded together.
CHUNK = 1 << 21
#: How the media column is stored: equal files of a row group once (their dictionary holds 32 MB at most), the rest by zstd.
STORAGE = {"parquet.dictionary.page.size": str(32 << 20), "parquet.compression.codec.zstd.level": "9"}
_SYNC = b"\xff\xf8"


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for n in range(256):
        c = n << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8 = _crc_table(0x07, 8)
_CRC16 = np.array(_crc_table(0x8005, 16), dtype=np.uint32)
#: Leading zeros of 16-bit numbers.
_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], dtype=np.int64)
_FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = _CRC8[c ^ x]
    return c


def _crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, one lane each; longest first so that lanes end in order."""
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    crc = np.zeros(len(s), dtype=np.uint32)
    live = len(s)
    for i in range(int(n[0]) if len(n) else 0):
        while n[live - 1] <= i:
            live -= 1
        c = crc[:live]
        crc[:live] = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ data[s[:live] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


@lru_cache(maxsize=65536)
def _frame_header(number: int, samples: int) -> bytes:
    if number < 0x80:
        coded = bytes([number])
    else:
        more = []
        limit = 0x3F
        n = number
        while n > limit:
            more.append(0x80 | (n & 0x3F))
            n >>= 6
            limit = 0x3F >> (len(more))
        lead = (0xFF << (7 - len(more))) & 0xFF
        coded = bytes([lead | n, *reversed(more)])
    head = _SYNC + (bytes([0xA4, 0x02]) + coded if samples == 1024 else bytes([0x74, 0x02]) + coded + struct.pack(">H", samples - 1))
    return head + bytes([_crc8(head)])


class _Bits:
    """A plane of bits with one row for each frame, written field by field."""

    def __init__(self, rows: int, width: int):
        self.bits = np.zeros(rows * width, dtype=np.uint8)
        self.base = np.arange(rows, dtype=np.int64) * width
        self.at = np.zeros(rows, dtype=np.int64)
        self.width = width

    def put(self, value: np.ndarray | int, width: int) -> None:
        v = np.broadcast_to(np.asarray(value, dtype=np.int64), self.at.shape)
        for j in range(width):
            self.bits[self.base + self.at + j] = (v >> (width - 1 - j)) & 1
        self.at += width

    def rice(self, u: np.ndarray, k: np.ndarray) -> None:
        q = u >> k[:, None]
        length = q + 1 + k[:, None]
        end = np.cumsum(length, axis=1)
        one = (self.base + self.at)[:, None] + end - 1 - k[:, None]
        self.bits[one] = 1
        for width in np.unique(k):
            rows = k == width
            o, r = one[rows], u[rows]
            for j in range(int(width)):
                self.bits[o + 1 + j] = (r >> (int(width) - 1 - j)) & 1
        self.at += end[:, -1]

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.packbits(self.bits.reshape(len(self.at), self.width), axis=1), (self.at + 7) // 8


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 63)


def _rice_parameter(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameter of each row and the bits it takes: the best of three around what the mean suggests."""
    n = u.shape[1]
    mean = u.sum(axis=1) / max(n, 1)
    guess = np.floor(np.log2(np.maximum(mean * 0.7, 1.0))).astype(np.int64)
    tried = [np.clip(guess + d, 0, 14) for d in (0, 1, -1)]
    bits = np.stack([(u >> k[:, None]).sum(axis=1) + n * (k + 1) for k in tried])
    best = bits.argmin(axis=0)
    return np.choose(best, tried), bits.min(axis=0)


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients (rows, order) and shifts, by Levinson's recursion on all rows."""
    rows, n = x.shape
    f = x * np.hanning(n + 2)[1:-1]
    auto = np.stack([(f[:, j:] * f[:, : n - j]).sum(axis=1) for j in range(order + 1)], axis=1)
    a, err = np.zeros((rows, order)), np.maximum(auto[:, 0] * (1 + 1e-9), 1e-9)
    for i in range(order):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(axis=1)) / err
        k = np.clip(k, -0.9999, 0.9999)
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err *= 1 - k * k
    top = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(LPC_PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64), shift


def _subframes(x: np.ndarray) -> list[bytes]:
    """Subframes (padded to bytes) of frames of one length, each by its cheapest method."""
    rows, n = x.shape
    cost = {"constant": np.where((x == x[:, :1]).all(axis=1), 16, 1 << 40), "verbatim": np.full(rows, 8 + BITS * n)}
    data: dict = {}
    for order in range(min(3, n)):
        r = np.diff(x, n=order, axis=1)
        u = _zigzag(r)
        k, bits = _rice_parameter(u)
        data[order], cost[order] = (u, k), bits + 18 + BITS * order
    if n > 4 * LPC_ORDER:
        coef, shift = _lpc(x.astype(np.float64), LPC_ORDER)
        predicted = sum(coef[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None]
        u = _zigzag(x[:, LPC_ORDER:] - predicted)
        k, bits = _rice_parameter(u)
        data["lpc"], cost["lpc"] = (u, k, coef, shift), bits + 27 + LPC_ORDER * (BITS + LPC_PRECISION)
    methods = list(cost)
    best = np.argmin(np.stack([cost[m] for m in methods]), axis=0)
    out: list = [b""] * rows
    for i, method in enumerate(methods):
        at = np.flatnonzero(best == i)
        if not len(at):
            continue
        part = x[at]
        b = _Bits(len(at), int(cost[method][at].max()) + 16)
        if method == "constant":
            b.put(0, 8)
            b.put(part[:, 0] & 0xFF, BITS)
        elif method == "verbatim":
            b.put(1 << 1, 8)
            for j in range(n):
                b.put(part[:, j] & 0xFF, BITS)
        else:
            u, k = data[method][0][at], data[method][1][at]
            order = LPC_ORDER if method == "lpc" else method
            b.put((32 + order - 1 if method == "lpc" else 8 + order) << 1, 8)
            for j in range(order):
                b.put(part[:, j] & 0xFF, BITS)
            if method == "lpc":
                coef, shift = data[method][2][at], data[method][3][at]
                b.put(LPC_PRECISION - 1, 4)
                b.put(shift, 5)
                for j in range(order):
                    b.put(coef[:, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
            b.put(0, 6)  # Rice coding with 4-bit parameters, one partition
            b.put(k, 4)
            b.rice(u, k)
        packed, sizes = b.bytes()
        for row, to in enumerate(at):
            out[to] = packed[row, : sizes[row]].tobytes()
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload (at least one byte)."""
    files: list[bytes] = []
    for a, b in chunks(payloads, CHUNK):
        cut = [(i, j) for i in range(a, b) for j in range(0, len(payloads[i]), BLOCK)]
        by_size: dict[int, list[int]] = {}
        for f, (i, j) in enumerate(cut):
            by_size.setdefault(min(BLOCK, len(payloads[i]) - j), []).append(f)
        frames: list = [b""] * len(cut)
        for n, group in by_size.items():
            x = np.frombuffer(b"".join(payloads[cut[f][0]][cut[f][1] : cut[f][1] + n] for f in group), dtype=np.uint8).reshape(-1, n).astype(np.int64) - 128
            for f, sub in zip(group, _subframes(x), strict=True):
                frames[f] = _frame_header(cut[f][1] // BLOCK, n) + sub
        size = np.array([len(f) for f in frames])
        crc = _crc16(np.frombuffer(b"".join(frames), dtype=np.uint8), np.cumsum(size) - size, size)
        frames = [f + struct.pack(">H", c) for f, c in zip(frames, crc.tolist(), strict=True)]
        at = 0
        for i in range(a, b):
            count = -(-len(payloads[i]) // BLOCK)
            files.append(_assemble(payloads[i], frames[at : at + count]))
            at += count
    return files


def _assemble(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    md5 = hashlib.md5(bytes(np.frombuffer(payload, dtype=np.uint8) ^ 0x80)).digest()
    total = len(payload)
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + ((RATE << 44) | ((BITS - 1) << 36) | total).to_bytes(8, "big") + md5
    points, offset = [], 0
    for i, s in enumerate(sizes):
        points.append(struct.pack(">QQH", i * BLOCK, offset, min(BLOCK, total - i * BLOCK)))
        offset += s
    out, table = [b"fLaC\x00", (34).to_bytes(3, "big"), info], b"".join(points)
    # A metadata block holds 16 MB at most; longer tables go into none, and frames are found by their sync codes.
    if len(table) < 1 << 24:
        out += [b"\x83", len(table).to_bytes(3, "big"), table]
    else:
        out[0] = b"fLaC\x80"
    return b"".join(out + frames)


@lru_cache(maxsize=65536)
def _parse_header(head: bytes) -> tuple[int, int, int]:
    """(samples, coded number, header length) of a frame header, its checksum verified."""
    if len(head) < 6 or head[:2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise ValueError("no frame here")
    size_code, channels, sample_size = head[2] >> 4, head[3] >> 4, (head[3] >> 1) & 7
    if channels or sample_size not in (0, 1):
        raise ValueError("only one channel of 8 bits is read")
    lead = head[4]
    extra = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    if lead >= 0x80 and extra < 1:
        raise ValueError("bad frame number")
    number = lead if not extra else lead & (0x3F >> extra)
    for x in head[5 : 5 + extra]:
        number = number << 6 | (x & 0x3F)
    at = 5 + extra
    if size_code == 6:
        samples, at = head[at] + 1, at + 1
    elif size_code == 7:
        samples, at = int.from_bytes(head[at : at + 2], "big") + 1, at + 2
    elif size_code >= 8:
        samples = 256 << (size_code - 8)
    elif size_code >= 1:
        samples = 192 if size_code == 1 else 576 << (size_code - 2)
    else:
        raise ValueError("reserved block size")
    at += {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
    if len(head) <= at or _crc8(head[:at]) != head[at]:
        raise ValueError("frame header checksum")
    return samples, number, at + 1


def _metadata(file: bytes) -> tuple[dict, list, int]:
    """Stream facts, seek points and where the frames begin."""
    if file[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, {}, []
    while not last:
        last, kind, size = bool(file[at] & 0x80), file[at] & 0x7F, int.from_bytes(file[at + 1 : at + 4], "big")
        body = file[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"rate": packed >> 44, "channels": ((packed >> 41) & 7) + 1, "bits": ((packed >> 36) & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 0xFFFFFFFFFFFFFFFF]
    if info["channels"] != 1 or info["bits"] != 8:
        raise ValueError("only one channel of 8 bits is read")
    return info, points, at


def frame_starts(file: bytes) -> tuple[dict, list[tuple[int, int, int]]]:
    """Stream facts and (byte, sample offset, samples) of each frame: by seek points if they name all frames, else by sync codes."""
    info, points, base = _metadata(file)
    reach = 0
    for sample, _, n in points:
        reach = reach + n if sample == reach else -1 << 60
    if points and reach == info["samples"]:
        return info, [(base + offset, sample, n) for sample, offset, n in points]
    found, at, sample = [], base, 0
    while sample < info["samples"]:
        try:
            n, number, _ = _parse_header(file[at : at + 16])
        except ValueError:
            n = 0
        # What looks like a frame inside another one is out of turn or follows a frame with a wrong checksum.
        if n and number == len(found) and (not found or _frame_ends(file, found[-1][0], at)):
            found.append((at, sample, n))
            sample += n
        nxt = file.find(b"\xff", at + 1)
        if nxt < 0:
            break
        at = nxt
    if sample != info["samples"]:
        raise ValueError("frames are missing")
    return info, found


def _frame_ends(file: bytes, start: int, end: int) -> bool:
    data = np.frombuffer(file[start:end], dtype=np.uint8)
    return end - start > 4 and int(_crc16(data, np.array([0]), np.array([len(data)]))[0]) == 0


class _Lanes:
    """Bit readers over one buffer, one position for each frame."""

    def __init__(self, data: bytes, at: np.ndarray):
        padded = np.frombuffer(data + bytes(16), dtype=np.uint8)
        n = len(padded) - 8
        #: The 64 bits from each byte on.
        self.words = np.zeros(n, dtype=np.uint64)
        for j in range(8):
            self.words <<= np.uint64(8)
            self.words |= padded[j : j + n]
        self.at = at.astype(np.int64) * 8

    def window(self, lanes) -> np.ndarray:
        p = self.at[lanes]
        return self.words[p >> 3] << (p & 7).astype(np.uint64)

    def take(self, lanes, width) -> np.ndarray:
        """Unsigned fields of `width` bits (up to 32, one number or one for each lane)."""
        w = np.broadcast_to(np.asarray(width, dtype=np.int64), np.shape(self.at[lanes]))
        v = np.where(w > 0, self.window(lanes) >> (64 - np.maximum(w, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)
        self.at[lanes] += w
        return v

    def signed(self, lanes, width) -> np.ndarray:
        w = np.broadcast_to(np.asarray(width, dtype=np.int64), np.shape(self.at[lanes]))
        v = self.take(lanes, w)
        return np.where((w > 0) & (v >> np.maximum(w - 1, 0) != 0), v - (np.int64(1) << w), v)


def _rice_codes(lanes: _Lanes, rows: np.ndarray, k: np.ndarray, count: np.ndarray) -> np.ndarray:
    """`count` Rice codes of each lane as residuals (longest count, rows); lanes of any lengths run together."""
    order = np.argsort(-count, kind="stable")
    pos, kk, left = lanes.at[rows[order]], k[order].astype(np.int64), count[order]
    longest = int(left[0]) if len(left) else 0
    rest, step, words = (63 - kk).astype(np.uint64), kk + 1, lanes.words
    codes = np.zeros((longest, len(rows)), dtype=np.int64)
    alive = np.searchsorted(-left, -np.arange(1, longest + 1), side="right")
    seven, one, high = np.int64(7), np.uint64(1), np.uint64(48)
    limit = len(words) * 8
    for j in range(longest):
        n = alive[j]
        p = pos[:n]
        if j % 256 == 0 and p.max() >= limit:
            raise ValueError("residual runs beyond the stream")
        w = words[p >> 3] << (p & seven).view(np.uint64)
        q = _ZEROS[(w >> high).view(np.int64)]
        if q.max() == 16:
            q = _long_unary(words, p)
            w = words[(p + q) >> 3] << ((p + q) & seven).view(np.uint64)
            w <<= one
        else:
            w <<= (q + 1).view(np.uint64)
        w >>= one
        w >>= rest[:n]
        codes[j, :n] = (q << kk[:n]) | w.view(np.int64)
        p += q
        p += step[:n]
    lanes.at[rows[order]] = pos
    out = np.empty_like(codes)
    out[:, order] = (codes >> 1) ^ -(codes & 1)
    return out


def _partitions(lanes: _Lanes, rows: np.ndarray, order: int, n: int, method: int, parts: int) -> np.ndarray:
    """Residuals (n - order, rows) of frames of one length, order and partitioning."""
    out, done, width = np.zeros((n - order, len(rows)), dtype=np.int64), 0, 4 + method
    for i in range(1 << parts):
        count = (n >> parts) - (order if i == 0 else 0)
        k = lanes.take(rows, width)
        raw = k == (1 << width) - 1
        if (own := np.flatnonzero(raw)).size:
            size = lanes.take(rows[own], 5)
            for j in range(done, done + count):
                out[j, own] = lanes.signed(rows[own], size)
        if (own := np.flatnonzero(~raw)).size:
            out[done : done + count, own] = _rice_codes(lanes, rows[own], k[own], np.full(len(own), count))[:count]
        done += count
    return out


def _residuals(lanes: _Lanes, rows: np.ndarray, order: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Residuals (longest, rows) of frames of any lengths and orders."""
    method, parts = lanes.take(rows, 2), lanes.take(rows, 4)
    if (method > 1).any():
        raise ValueError("reserved residual coding")
    out = np.zeros((int((sizes - order).max(initial=0)), len(rows)), dtype=np.int64)
    at = lanes.at.copy()
    k = lanes.take(rows, 4 + method)
    plain = (parts == 0) & (k != (1 << (4 + method)) - 1)
    if (own := np.flatnonzero(plain)).size:
        got = _rice_codes(lanes, rows[own], k[own], (sizes - order)[own])
        out[: len(got), own] = got
    others = np.flatnonzero(~plain)
    lanes.at[rows[others]] = at[rows[others]]
    for m, p, o, n in sorted({(int(method[i]), int(parts[i]), int(order[i]), int(sizes[i])) for i in others}):
        own = others[(method[others] == m) & (parts[others] == p) & (order[others] == o) & (sizes[others] == n)]
        out[: n - o, own] = _partitions(lanes, rows[own], o, n, m, p)
    return out


def _long_unary(words: np.ndarray, pos: np.ndarray) -> np.ndarray:
    q = np.zeros(len(pos), dtype=np.int64)
    live = np.arange(len(pos))
    while len(live):
        p = pos[live] + q[live]
        if (p >> 3).max() >= len(words):
            raise ValueError("residual runs beyond the stream")
        z = _ZEROS[((words[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(48)).astype(np.int64)]
        q[live] += z
        live = live[z == 16]
    return q


def _decode_frames(data: bytes, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Samples of the frames in data[start:end], checksums verified."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if _crc16(raw, start, end - start).any():
        raise ValueError("frame checksum")
    heads = [_parse_header(data[s : s + 16]) if s + 16 <= e else _parse_header(data[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    sizes = np.array([h[0] for h in heads])
    lanes = _Lanes(data, start + np.array([h[2] for h in heads]))
    everyone = np.arange(len(heads))
    kind = lanes.take(everyone, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits are not read")
    kind >>= 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind < 2)).all():
        raise ValueError("reserved subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    longest = int(sizes.max())
    x = np.zeros((longest, len(heads)), dtype=np.int64)
    rows = np.flatnonzero(kind == 0)
    x[:, rows] = lanes.signed(rows, BITS)
    for n in np.unique(sizes[kind == 1]):
        rows = np.flatnonzero((kind == 1) & (sizes == n))
        for j in range(n):
            x[j, rows] = lanes.signed(rows, BITS)
    for o in np.unique(order[order > 0]):
        rows = np.flatnonzero(order == o)
        for j in range(o):
            x[j, rows] = lanes.signed(rows, BITS)
    coef: dict[int, tuple] = {}
    for t in np.unique(kind[fixed | linear]):
        rows, o = np.flatnonzero(kind == t), int(t - 8 if t < 32 else t - 31)
        if t < 32:
            coef[t] = np.array(_FIXED[o], dtype=np.int64).reshape(o, 1), 0
            continue
        precision, shift = lanes.take(rows, 4) + 1, lanes.signed(rows, 5)
        if (shift < 0).any() or (precision == 16).any():
            raise ValueError("bad predictor")
        coef[t] = np.stack([lanes.signed(rows, precision) for _ in range(o)]), shift
    coded = np.flatnonzero(fixed | linear)
    residual = _residuals(lanes, coded, order[coded], sizes[coded])
    for t, (c, shift) in coef.items():
        pick = np.flatnonzero(kind[coded] == t)
        rows, o = coded[pick], int(order[coded[pick][0]])
        y = x[:, rows]
        n = int(sizes[rows].max())
        y[o:n] = residual[: n - o, pick]
        if t == 9:
            np.cumsum(y, axis=0, out=y)
        elif o:
            back = np.ascontiguousarray(c[::-1])
            for i in range(o, n):
                y[i] += (back * y[i - o : i]).sum(axis=0) >> shift
        x[:, rows] = y
    inside = np.arange(longest)[:, None] < sizes[None, :]
    if (np.abs(2 * x + 1) * inside > 255).any():
        raise ValueError("sample out of range")
    columns = np.ascontiguousarray((x + 128).astype(np.uint8).T)
    return [columns[i, :n] for i, n in enumerate(sizes)]


def decode_blocks(files: list[bytes], verify: bool = True) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
    """(file number, [(sample offset, unsigned bytes)]) for each file, in order."""
    for a, b in chunks(files, CHUNK):
        data = b"".join(files[a:b])
        base, start, end, mine, offsets, infos = 0, [], [], [], [], []
        for i in range(a, b):
            info, frames = frame_starts(files[i])
            infos.append(info)
            for f, (at, sample, _) in enumerate(frames):
                start.append(base + at)
                end.append(base + (frames[f + 1][0] if f + 1 < len(frames) else len(files[i])))
                mine.append(i)
                offsets.append(sample)
            base += len(files[i])
        blocks = _decode_frames(data, np.array(start, dtype=np.int64), np.array(end, dtype=np.int64)) if start else []
        at = 0
        for i, info in zip(range(a, b), infos, strict=True):
            own = []
            while at < len(mine) and mine[at] == i:
                own.append((offsets[at], blocks[at]))
                at += 1
            if verify and info["md5"] != bytes(16) and hashlib.md5(b"".join((x ^ 0x80).tobytes() for _, x in own)).digest() != info["md5"]:
                raise ValueError("MD5 of the stream")
            yield i, own


def read_samples(file: bytes, first: int, count: int) -> bytes:
    """`count` bytes from sample `first`, decoding only the frames that hold them."""
    _, frames = frame_starts(file)
    ends = [f[0] for f in frames[1:]] + [len(file)]
    pick = [(f, e) for f, e in zip(frames, ends, strict=True) if f[1] < first + count and f[1] + f[2] > first]
    if not pick:
        return b""
    got = b"".join(x.tobytes() for x in _decode_frames(file, np.array([f[0] for f, _ in pick]), np.array([e for _, e in pick])))
    skip = first - pick[0][0][1]
    return got[max(0, skip) : max(0, skip) + count]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % PAD or (0 if raw else PAD))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a FLAC file) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            sizes = byte_lengths(column)
            for a, b in chunks(sizes, CHUNK):
                made = [payload_of(t) for t in column.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([n for n, _ in made], pa.int64()), pa.array(encode([p for _, p in made]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store_media(docs: DataFrame) -> DataFrame:
    """to_media() written to the shared folder and read back: nothing later sees the texts again."""
    return materialise(to_media(docs), "flac-media", compression="zstd", options=STORAGE)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of a few MB of media."""
    for a, b in chunks(byte_lengths(batch.column("media")), CHUNK):
        yield batch.slice(a, b - a)


def read_range(media: DataFrame, first: int, count: int) -> DataFrame:
    """doc_id, sample_offset, pcm: up to `count` samples from `first` of each file.

    The seek points tell which blocks hold them; only those are decoded, of many files at once. A range beyond the end gives no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch):
                files = rows.column("media").to_pylist()
                starts, ends, skip, per, base = [], [], [], [], 0
                for file in files:
                    frames = frame_starts(file)[1]
                    stops = [f[0] for f in frames[1:]] + [len(file)]
                    held = [(f, e) for f, e in zip(frames, stops, strict=True) if f[1] < first + count and f[1] + f[2] > first]
                    starts += [base + f[0] for f, _ in held]
                    ends += [base + e for _, e in held]
                    skip.append(max(0, first - held[0][0][1]) if held else 0)
                    per.append(len(held))
                    base += len(file)
                decoded = iter(_decode_frames(b"".join(files), np.array(starts), np.array(ends)) if starts else [])
                got = [b"".join(next(decoded).tobytes() for _ in range(n))[s : s + count] for n, s in zip(per, skip, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([first] * len(got), pa.int64()), pa.array(got, pa.binary())], ["doc_id", "sample_offset", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, pcm binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, sample_offset, n_samples, pcm: a row for each frame of each media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch):
                ids, files = rows.column("doc_id").to_pylist(), rows.column("media").to_pylist()
                for i, blocks in decode_blocks(files):
                    n = len(blocks)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([o for o, _ in blocks], pa.int64()), pa.array([len(x) for _, x in blocks], pa.int64()), pa.array([x.tobytes() for _, x in blocks], pa.binary())],
                        ["doc_id", "block", "sample_offset", "n_samples", "pcm"],
                    )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, sample_offset long, n_samples long, pcm binary")


def write_pcm(media: DataFrame, path: str) -> None:
    """The decoded blocks as Parquet, in order within each file, so that sample_offset prunes row groups."""
    pcm_blocks(media).write.parquet(path)


def features(pcm: np.ndarray) -> str:
    """Whole-number features of the samples: mean square, zero crossings, peak, roughness."""
    x = pcm.astype(np.int64) - 128
    step = np.abs(np.diff(x))
    return f"ms={int((x * x).sum()) // len(x)};zc={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())};rough={int(step.sum()) * 100 // max(1, len(step))}"


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of the payloads, from the stored files alone; every block is found by its seek point and verified."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                files, rows = part.column("media").to_pylist(), []
                for i, blocks in decode_blocks(files):
                    pcm = np.concatenate([x for _, x in blocks])
                    raw = pcm.tobytes()
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-PAD:]), len(files[i]), hashlib.sha256(files[i]).hexdigest(), features(pcm)))
                if rows:
                    cols = [part.column("doc_id"), part.column("n_bytes"), *zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return media.mapInArrow(run, ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types, strict=True)))


def op3_flac_media(spark, sf_dir):
    return read_back(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
