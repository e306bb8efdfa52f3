"""Vectorised byte kernels: words of many texts and their hashes, without Python loops over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = np.random.default_rng(20240601)
#: A random odd-free value for each byte, and an odd base with its inverse modulo 2**64.
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: True for the bytes of words `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: True for the bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Texts are taken together up to so many bytes, so that memory stays bounded.
CHUNK_BYTES = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _cache or len(_cache[base]) < n:
        _cache[base] = _powers(base, max(n, CHUNK_BYTES + 64))
    return _cache[base][:n]


def byte_lengths(column: pa.Array) -> list[range]:
    """Stand-ins with the lengths of a column's strings, for chunks() before they are unpacked."""
    return [range(n or 0) for n in pc.binary_length(column).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """(first, last) ranges of texts of about `limit` bytes; a longer text stands alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a chunk of texts: `start` and `end` bytes, `hash`, and `first[i]:first[i+1]` per text."""

    def __init__(self, texts: list[bytes], table: np.ndarray = NON_SPACE, hashed: bool = True):
        # A blank ends every text, so that no word spans two of them.
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self.data = data = _LOWER[data]
        inside = table[data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends]))
        self.offset = np.concatenate([[0], ends[:-1]])
        if hashed:
            n = len(data)
            with np.errstate(over="ignore"):
                sums = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(_BYTE[data] * _power(_BASE, n), out=sums[1:])
                h = (sums[self.end] - sums[self.start]) * _power(_INVERSE, n)[self.start]
                self.hash = mix(h ^ (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)
