"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens by the tokenizer's pattern. A minimal perfect hash
over the vocabulary resolves pre-tokens that are tokens themselves; the others
are merged with a heap of adjacent pairs over a linked list of their bytes. Both
give what merging in rank order gives, as in a byte-level BPE any token of the
vocabulary is reached by its own merges (the lookup of whole pre-tokens is part
of the encoding's definition in the tiktoken library).

Defined cases: null and empty texts have no tokens; their digests are those of
the empty string. Ids and repeated rows are taken row by row. A very long
pre-token costs n log n. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.kernels import _BASE, _BYTE, _power, byte_lengths, chunks, mix

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers; the older half goes when it is full. Longer ones are not kept beyond their texts.
CACHE, LONGEST = 250_000, 64
#: Mean number of keys in a bucket of the perfect hash.
BUCKET = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: In texts below U+0250 these classes equal \s, \p{L} and \p{N} of the pattern.
_SPACE, _LETTER, _NUMBER = "\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_WIDE = re.compile("[^\x00-ɏ]")
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NARROW = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _hashes(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, vectorised over all of them."""
    data = np.frombuffer(b"".join(keys), dtype=np.uint8)
    lens = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    ends = np.cumsum(lens)
    with np.errstate(over="ignore"):
        inner = np.arange(len(data), dtype=np.int64) - np.repeat(ends - lens, lens)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, int(lens.max(initial=0)) + 1)[inner], out=sums[1:])
        return mix((sums[ends] - sums[ends - lens]) ^ (lens.astype(np.uint64) * _STEP))


class PerfectHash:
    """Minimal perfect hash by displacement: each bucket has a shift under which its keys fall into free slots.

    A bucket of one key names its slot itself, which leaves no slot unused.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // BUCKET)
        h = _hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        size = np.diff(bounds)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.slot_key = np.full(n, -1, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        for b in np.argsort(-size, kind="stable"):
            at = order[bounds[b] : bounds[b + 1]]
            if len(at) < 2:
                break
            start = 1
            while True:
                tries = np.arange(start, start + 256, dtype=np.uint64)
                slots = self._slots(h[at][None, :], tries[:, None])
                good = free[slots].all(axis=1)
                for i in np.flatnonzero(good):
                    if len(set(slots[i].tolist())) == len(at):
                        free[slots[i]] = False
                        self.slot_key[slots[i]] = at
                        self.shift[b] = start + i
                        break
                else:
                    start += 256
                    continue
                break
        spare = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(size == 1):
            slot, key = next(spare), order[bounds[b]]
            self.slot_key[slot] = key
            self.shift[b] = -slot - 1

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(h + shift * _STEP) % np.uint64(self.n)).astype(np.int64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """The number of the only key that each of `keys` can equal."""
        h = _hashes(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.slot_key[np.where(shift < 0, -shift - 1, self._slots(h, np.maximum(shift, 0).astype(np.uint64)))]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token: a heap of adjacent pairs over linked bytes, the lowest rank first, then the leftmost."""
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    if not heap:
        return [ranks[p] for p in part]
    heapq.heapify(heap)
    pop, push, get = heapq.heappop, heapq.heappush, ranks.get
    end = list(range(1, n + 1))  # where the token that starts here ends; 0: no token starts here
    back = list(range(-1, n))  # the start of the token before that which starts here
    while heap:
        _, i, stop = pop(heap)
        j = end[i]
        # Stale if the left token grew or vanished, or the right one grew.
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            back[stop] = i
            r = get(piece[i : end[stop]])
            if r is not None:
                push(heap, (r, i, end[stop]))
        k = back[i]
        if k >= 0:
            r = get(piece[k:stop])
            if r is not None:
                push(heap, (r, k, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Vocabulary, perfect hash and a bounded memory of pre-tokens; one per worker."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, pattern: str):
        self.ranks, self.table = ranks, table
        self.keys, self.ids = list(ranks), list(ranks.values())
        self.of_id = {str(i): k for k, i in ranks.items()}
        self.narrow = _NARROW if pattern == _KNOWN_PATTERN else None
        self.pattern = pattern
        self._wide = None
        self.memory: dict[str, str] = {}

    def split(self, text: str) -> list[str]:
        if self.narrow is not None and not _WIDE.search(text):
            return self.narrow.findall(text)
        if self._wide is None:
            import regex

            self._wide = regex.compile(self.pattern)
        return [m[0] for m in self._wide.finditer(text)]

    def learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        for piece, b, c in zip(pieces, raw, self.table.candidates(raw).tolist(), strict=True):
            if self.keys[c] == b:
                self.memory[piece] = str(self.ids[c])
            else:
                self.memory[piece] = " ".join(map(str, merge_bytes(b, self.ranks)))

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids joined by one space, for each text."""
        cut = [self.split(t) for t in texts]
        if len(self.memory) > CACHE:
            self.memory = dict(list(self.memory.items())[CACHE // 2 :])
        new = set().union(*cut).difference(self.memory)
        if new:
            self.learn(list(new))
        get = self.memory.__getitem__
        ids = [" ".join(map(get, pieces)) for pieces in cut]
        for piece in new:
            if len(piece) > LONGEST:
                del self.memory[piece]
        return ids

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.of_id.__getitem__, ids.split(" "))) if ids else b""


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, columns: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """doc_id with any of n_tokens, ids (space-joined), ids_sha256, decoded (bytes) and decoded_sha256.

    `path` names a file of ranks in tiktoken's form on the driver; its table
    (under 1 MB) is broadcast.
    """
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    ranks = load_ranks(path or public_tokenizers.path(VOCABULARY))
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(list(ranks)), pattern))
    types = {"n_tokens": pa.int64(), "ids": pa.string(), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}
    sql = {"n_tokens": "long", "decoded": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            column = batch.column("text")
            sizes = byte_lengths(column)
            for a, b in chunks(sizes):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                out: dict[str, list] = {c: [] for c in columns}
                for ids in encoder.encode(texts):
                    raw = encoder.decode(ids) if "decoded" in out or "decoded_sha256" in out else b""
                    for c, values in out.items():
                        if c == "n_tokens":
                            values.append(ids.count(" ") + 1 if ids else 0)
                        elif c == "ids":
                            values.append(ids)
                        elif c == "ids_sha256":
                            values.append(hashlib.sha256(ids.encode()).hexdigest())
                        elif c == "decoded":
                            values.append(raw)
                        else:
                            values.append(hashlib.sha256(raw).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(out[c], types[c]) for c in columns]], ["doc_id", *columns])

    schema = ", ".join(["doc_id long", *[f"{c} {sql.get(c, 'string')}" for c in columns]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op10_byte_bpe(spark, sf_dir):
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
