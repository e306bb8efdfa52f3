"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(s | h) P(u | s, h) P(word | class), where a word's class is
16 u + s. The OWN most frequent tokens have a class each, others share classes
by their last two bytes. The first two factors are log-linear over hashed
features of the history: the word before, the word two before (skip) and both;
the last is the smoothed share of the word in its class. A shared class keeps a
share for words never seen, which count as one event for each such class; a class
of one token has none. So the probabilities of all words and of those events add
up to one for any history.

Training: word counts and feature-class counts over all training documents set
the weights to damped log ratios; then rounds of distributed gradient updates, each
over its own part of the training documents and all of them together over every one,
refine them (steps scaled by the counts). The weights have a fixed size, whatever the corpus.
Scoring: sparse numpy batches look up a few rows of weights for each token.

Word counts follow the corpus: frequent words (HEAD at most) are broadcast, the
rest of each document's words are joined with the table of counts.

Words are told apart by 64-bit hashes; that two of a billion words agree has a
chance of about 3 %, and would merge their two counts.

Defined cases: null and empty texts consist of the end token. A null id counts
as empty text, which is held out. With no training tokens all words are unknown
and the model is uniform over classes. Repeated rows are scored row by row, and
counted as often. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import is_held_out, materialise, scratch_scope
from weft.llm.kernels import Words, byte_lengths, chunks, mix

FOLDS = 10
SMOOTH = 0.1
#: Classes: S by U, the first OWN of them for one token each.
S, U, OWN = 16, 8, 64
CLASSES = S * U
#: Rows of weights for each kind of feature.
BUCKETS = 2048
KINDS = 3
ROWS = KINDS * BUCKETS + 1
ROUNDS = 2
#: Words whose counts are broadcast, 16 bytes each.
HEAD = 200_000
#: Partial sums of this many tasks are added in one group.
FAN = 64
BLOCKS = 16
#: Damping of the log ratios, as several features speak of the same event.
DAMP, PRIOR, STEP = 0.55, 2.0, 0.5
CHUNK = 1 << 20
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


class HashIndex:
    """Open-addressed table from 64-bit hashes to positions, built and read by numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.at = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.at[slot] < 0
            # Of those that want a free slot, the last written stays.
            self.at[slot[free]] = left[free]
            won = self.at[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int32)
        left, slot = np.arange(len(hashes)), (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            at = self.at[slot]
            hit = (at >= 0) & (self.keys[slot] == hashes[left])
            out[left[hit]] = at[hit]
            more = (at >= 0) & ~hit
            left, slot = left[more], (slot[more] + 1) & self.mask
        return out


class Tokens:
    """Tokens of a chunk of texts in sequence, each text closed by END."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts)
        per = w.counts()
        self.first = np.concatenate([[0], np.cumsum(per + 1)])
        n = int(self.first[-1])
        place = np.arange(len(w.hash)) + np.repeat(np.arange(len(texts)), per)
        self.hash = np.full(n, END, dtype=np.uint64)
        self.hash[place] = w.hash
        last = w.data[w.end - 1].astype(np.uint64)
        before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
        self.shared = np.full(n, CLASSES - 1, dtype=np.int64)
        with np.errstate(over="ignore"):
            self.shared[place] = OWN + (mix(last * np.uint64(257) + before) % np.uint64(CLASSES - OWN)).astype(np.int64)

    def features(self) -> list[np.ndarray]:
        """Rows of weights of each token's history, one array for each kind."""
        h = self.hash
        one, two = np.empty_like(h), np.empty_like(h)
        one[1:], two[2:] = h[:-1], h[:-2]
        start = self.first[:-1]
        one[start] = two[start] = BEGIN
        second = start[np.diff(self.first) > 1] + 1
        two[second] = BEGIN
        size = np.uint64(BUCKETS)
        with np.errstate(over="ignore"):
            keys = (one, two * np.uint64(0x9E3779B97F4A7C15), one * np.uint64(0xC2B2AE3D27D4EB4F) + two)
            return [(mix(k) % size).astype(np.int64) + i * BUCKETS for i, k in enumerate(keys)]


@dataclass
class Model:
    """Broadcast parts: weights, own classes, class denominators, counts of frequent words."""

    own: np.ndarray
    top: np.ndarray  # (ROWS, S)
    sub: np.ndarray  # (ROWS * S, U)
    log_class: np.ndarray | None = None
    head: np.ndarray | None = None
    log_count: np.ndarray | None = None

    def classes(self, t: Tokens) -> np.ndarray:
        if not hasattr(self, "_own"):
            self._own = HashIndex(self.own)
        at = self._own.find(t.hash)
        return np.where(at >= 0, at, t.shared)

    def logits(self, f: list[np.ndarray], s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.top[ROWS - 1] + self.top[f[0]], self.sub[(ROWS - 1) * S + s]
        b = b + self.sub[f[0] * S + s]
        for x in f[1:]:
            a += self.top[x]
            b += self.sub[x * S + s]
        return a, b

    def find_head(self, hashes: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_head"):
            self._head = HashIndex(self.head)
        return self._head.find(hashes)


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and the log of the divisor, rows apart; z is used up."""
    top = z.max(axis=1, keepdims=True)
    z -= top
    e = np.exp(z)
    total = e.sum(axis=1, keepdims=True)
    return e / total, np.log(total[:, 0])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    for batch in batches:
        column = batch.column("text")
        sizes = byte_lengths(column)
        for a, b in chunks(sizes, CHUNK):
            part = batch.slice(a, b - a)
            yield part, Tokens([(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()])


def count_words(training: DataFrame) -> DataFrame:
    """word (hash), shared (its class by suffix), n: over all rows of training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts):
            keys, shared, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            return u, shared[first], np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)

        def out(parts):
            u, shared, n = merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(shared.astype(np.int32)), pa.array(n)], ["word", "shared", "n"])

        parts: list = []
        for _, t in _batches(batches):
            u, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            parts.append((u, t.shared[first], n))
            if sum(len(p[0]) for p in parts) > 2_000_000:
                parts = [merged(parts)]
                if len(parts[0][0]) > 1_000_000:
                    yield out(parts)
                    parts = []
        if parts:
            yield out(parts)

    return training.select("text").mapInArrow(run, "word long, shared int, n long").groupBy("word").agg(F.min("shared").alias("shared"), F.sum("n").alias("n"))


def _summed(training: DataFrame, body, dtype) -> np.ndarray:
    """The sum over all tasks of a vector of fixed size that `body(batches)` gives."""
    size = ROWS * (S + CLASSES)
    cuts = np.linspace(0, size, BLOCKS + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = body(batches)
        if total.any():
            rows = [total[cuts[i] : cuts[i + 1]].astype(dtype).tobytes() for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([TaskContext.get().partitionId() // FAN] * BLOCKS, pa.int32()), pa.array(rows, pa.binary())], ["block", "part", "sums"])

    def add(kind):
        def inner(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, dtype=kind).astype(np.float64) for x in group.column("sums").to_pylist())
            return pa.table({"block": group.column("block").slice(0, 1), "part": group.column("part").slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        return inner

    schema = "block int, part int, sums binary"
    parts = training.select("text").mapInArrow(run, schema).groupBy("block", "part").applyInArrow(add(dtype), schema)
    found = parts.groupBy("block").applyInArrow(add(np.float32), schema)
    out = np.zeros(size)
    for row in found.collect():
        out[cuts[row["block"]] : cuts[row["block"] + 1]] = np.frombuffer(row["sums"], dtype=np.float32)
    return out


def _unpacked(vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return vector[: ROWS * S].reshape(ROWS, S), vector[ROWS * S :].reshape(ROWS * S, U)


def feature_counts(training: DataFrame, model) -> np.ndarray:
    """How often each class follows each feature, over all training documents."""

    def body(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(ROWS * CLASSES)
        for _, t in _batches(batches):
            c = model.value.classes(t)
            for x in [*t.features(), np.full(len(c), ROWS - 1)]:
                total += np.bincount((x * S + c % S) * U + c // S, minlength=len(total))
        sub = total.reshape(ROWS, S, U)
        return np.concatenate([sub.sum(axis=2).ravel(), sub.ravel()])

    return _summed(training, body, np.float32)


def gradient(training: DataFrame, model) -> np.ndarray:
    """Observed less expected counts of all weights over the given documents."""

    def body(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        g1, g2 = np.zeros((S, ROWS)), np.zeros((U, ROWS * S))
        for _, t in _batches(batches):
            c = model.value.classes(t)
            s, u, f = c % S, c // S, t.features()
            a, b = model.value.logits(f, s)
            p, q = _softmax(a)[0], _softmax(b)[0]
            every = np.arange(len(c))
            p[every, s] -= 1
            q[every, u] -= 1
            for x in f:
                for k in range(S):
                    g1[k] -= np.bincount(x, weights=p[:, k], minlength=ROWS)
                y = x * S + s
                for k in range(U):
                    g2[k] -= np.bincount(y, weights=q[:, k], minlength=ROWS * S)
            g1[:, -1] -= p.sum(axis=0)
            for k in range(U):
                g2[k, -S:] -= np.bincount(s, weights=q[:, k], minlength=S)
        return np.concatenate([g1.T.ravel(), g2.T.ravel()])

    return _summed(training, body, np.float32)


def _ratios(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Damped log ratios of P(class | feature) to P(class); the last row has log P(class)."""
    out = []
    for c, groups in zip(_unpacked(counts), (1, S), strict=True):
        n = c.reshape(ROWS, groups, -1)
        base = (n[-1] + SMOOTH) / (n[-1] + SMOOTH).sum(axis=1, keepdims=True)
        given = (n + PRIOR * base) / (n.sum(axis=2, keepdims=True) + PRIOR)
        w = DAMP * np.log(given / base)
        w[-1] = np.log(base)
        out.append(w.reshape(c.shape).astype(np.float32))
    return out[0], out[1]


@dataclass
class Trained:
    model: Model
    counts: DataFrame
    train_tokens: int
    vocabulary: int


def train(docs: DataFrame, rounds: int = ROUNDS) -> Trained:
    """Model and word counts from the rows of docs (doc_id, text) that are not held out."""
    sc = docs.sparkSession.sparkContext
    training = docs.filter(~is_held_out(F.col("doc_id"), FOLDS))
    counts = materialise(count_words(training), "lm-counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, vocabulary = totals["n"] or 0, totals["v"]

    # The least count that leaves HEAD words at most, from the (short) list of different counts.
    least, words = 1 << 62, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(HEAD).collect():
        if words + r["k"] > HEAD:
            break
        least, words = r["n"], words + r["k"]
    frequent = sorted(counts.filter(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"])) if words else []
    head = np.array([r["word"] for r in frequent], dtype=np.int64).view(np.uint64)
    own = np.array([END, *[h for h in head[: 2 * OWN] if h != END][: OWN - 1]], dtype=np.uint64)

    # A class of one token holds nothing else; the others keep a share for words never seen.
    mass, kinds = np.zeros(CLASSES), np.ones(CLASSES)
    kinds[: len(own)] = 0
    for r in counts.groupBy("shared").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        mass[r["shared"]] += r["n"]
        kinds[r["shared"]] += r["k"]
    place = {int(h): i for i, h in enumerate(own)}
    for r in frequent[: 2 * OWN]:
        i = place.get(r["word"] % 2**64)
        if i is not None:
            mass[r["shared"]] -= r["n"]
            kinds[r["shared"]] -= 1
            mass[i] += r["n"]
    kinds[: len(own)] = 1
    model = Model(own, np.zeros((ROWS, S), dtype=np.float32), np.zeros((ROWS * S, U), dtype=np.float32))
    seen = feature_counts(training, sc.broadcast(model))
    model = Model(own, *_ratios(seen))
    for i in range(rounds):
        part = training.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(rounds)) == i)
        g = gradient(part, sc.broadcast(model))
        # A step is bounded: the change of a weight is STEP at most where nothing was expected.
        step = STEP * g / (seen / rounds + np.abs(g) + PRIOR)
        a, b = _unpacked(step)
        model = Model(own, (model.top + a).astype(np.float32), (model.sub + b).astype(np.float32))
    model.log_class = np.log10(mass + SMOOTH * kinds)
    model.head = head
    model.log_count = np.log10(np.array([r["n"] for r in frequent], dtype=float) + SMOOTH)
    return Trained(model, counts.filter(F.col("n") < least), tokens, vocabulary)


def score(docs: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(trained.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, row = shared.value, TaskContext.get().partitionId() << 40
        for part, t in _batches(batches):
            c = m.classes(t)
            s = c % S
            f = t.features()
            a, b = m.logits(f, s)
            every, n = np.arange(len(c)), part.num_rows
            za, zb = a.max(axis=1), b.max(axis=1)
            chosen = a[every, s] - za + b[every, c // S] - zb
            log_p = (chosen - np.log(np.exp(a - za[:, None]).sum(axis=1)) - np.log(np.exp(b - zb[:, None]).sum(axis=1))) / math.log(10) - m.log_class[c]
            at = m.find_head(t.hash)
            known = at >= 0
            counted = np.where(known, m.log_count[np.maximum(at, 0)] if len(m.log_count) else 0.0, 0.0)
            first = t.first[:-1]
            doc = np.repeat(np.arange(n), np.diff(t.first))
            rest = ~known
            # Other words once for each document, with how often they stand there.
            order = np.lexsort((t.hash[rest], doc[rest]))
            h, d = t.hash[rest][order], doc[rest][order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(h)))
            bounds = pa.array(np.searchsorted(d[starts], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(row + np.arange(n, dtype=np.int64)),
                    pa.array(np.diff(t.first).astype(np.int64)),
                    pa.array(np.add.reduceat(known.astype(np.int64), first)),
                    pa.array(np.add.reduceat(counted, first)),
                    pa.array(np.add.reduceat(log_p, first)),
                    pa.ListArray.from_arrays(bounds, pa.array(h[starts].view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
                ],
                ["doc_id", "held_out", "row", "n_tokens", "n_known", "counted", "log_p", "words", "times"],
            )
            row += n

    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, counted double, log_p double, words array<long>, times array<int>"
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id"), FOLDS).alias("held_out"), "text")
    # Written once, so that the row numbers stay as they are whatever is run again.
    parts = materialise(marked.mapInArrow(run, schema), "lm-parts")
    rest = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    known = rest.join(trained.counts.select("word", "n"), "word", "left")
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("logs"))
    all_logs = F.col("counted") + F.coalesce("logs", F.lit(0.0))
    divisor = math.log10(trained.train_tokens + SMOOTH * (trained.vocabulary + 1))
    return parts.drop("words", "times").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(trained.train_tokens).cast("long").alias("train_tokens"),
        (all_logs - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        (all_logs + F.col("log_p")).alias("score"),
    )


def op2_frame(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and score all. Only the result stays in the shared folder."""
    with scratch_scope():
        return materialise(score(docs, train(docs)), "lm-scores", outer=True)


def op2_maxent_lm(spark, sf_dir):
    return op2_frame(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
