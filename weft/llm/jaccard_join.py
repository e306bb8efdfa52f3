"""Size-aware heavy-light join of documents on the Jaccard similarity of word n-grams.

Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of
distinct 4-word shingles. Equal sets are one node. A pair is handled by the size
b of its larger set. For small b both sides enumerate their subsets of one fixed
size, ceil(percent * b / 100), which linked sets share. For large b inverted
lists over the first shingles of each set are scanned; the order of shingles
puts frequent ones last, by a count sketch over the whole corpus, so that a
passage shared by many documents heads no set. The boundary is where the lists
become cheaper for the sizes at hand.

Each list first gives a star of edges from its least member. They are verified
on the whole sets and joined into components; only members of one list that are
then in different components are compared with each other (by size and position
bounds, then on the whole sets). So no link between different texts is lost, and
a group of copies needs no more than a star. To count links, the sets of a
component of three or more are compared all with all, in pairs of blocks of
bounded size; only the count of each set leaves a pair of blocks.

Defined cases: null, empty and blank texts have an empty set and link with
nothing. A text with fewer than four words has one shingle, its whole sequence.
Rows that share an id are one vertex: what either links to is reachable from
both. Rows without an id get their set size and a null component. Other columns
are ignored. An empty table gives an empty result. Two sets that share a number are
noticed by a check, and all is done again with another seed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import discard, materialise, scratch_scope
from weft.llm.kernels import CHUNK_BYTES, Words, byte_lengths, chunks, mix

WORDS = 4
PERCENT = 85
#: Sizes from which the boundary is chosen; enumeration beyond them is never cheaper.
MAX_LIGHT = 24
#: What an entry of an inverted list costs, in keys of an enumerated subset.
SCAN_COST = 4
#: Counters of the sketch that orders shingles: a fixed size, whatever the corpus.
SKETCH_BITS = 21
SKETCH_BLOCKS = 64
#: Sketches of this many tasks are added up in one group.
SKETCH_FAN = 64
#: A block of a component holds about so many sets and shingles; each pair of blocks is one group of rows.
BLOCK_SETS = 256
BLOCK_SHINGLES = 1_000_000
#: Columns of the matrix in which two blocks are compared at a time.
BLOCK_COLUMNS = 4096
#: A task forgets which sets it has seen after so many, and hands on so many entries at a time: its memory is bounded.
SEEN_SETS, OUT_ENTRIES = 500_000, 200_000
#: Seeds tried when two different sets share a node number.
SEEDS = 5
#: Up to this many ids the filter for texts to verify is broadcast (8 bytes each); beyond it, it is a shuffle join.
BROADCAST_IDS = 1_000_000
_SHINGLE = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 3) % 2**64 | 1) for i in range(64)]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        w = Words(texts[a:b])
        h, n = w.hash, len(w.hash)
        with np.errstate(over="ignore"):
            if n >= words:
                g = mix(sum((h[i : n - words + 1 + i] * _SHINGLE[i] for i in range(1, words)), h[: n - words + 1] * _SHINGLE[0]))
            for i in range(b - a):
                s, e = w.first[i], w.first[i + 1]
                if e - s >= words:
                    out.append(np.unique(g[s : e - words + 1]))
                elif e > s:
                    # Fewer words: the sequence with its length is the only shingle.
                    v = np.uint64(e - s)
                    for x, k in zip(h[s:e], _SHINGLE, strict=False):
                        v = v * np.uint64(31) + x * k
                    out.append(mix(np.array([v ^ np.uint64(0x5851F42D4C957F2D)], dtype=np.uint64)))
                else:
                    out.append(np.empty(0, dtype=np.uint64))
    return out


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """So many first shingles meet in any two linked sets."""
    return n - -(-percent * n // 100) + 1 if n else 0


def partners(n: int, percent: int) -> range:
    """Sizes of the larger set in the pairs that a set of n can link in."""
    return range(n, 100 * n // percent + 1)


def subset_cost(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for b in partners(n, percent) if (c := -(-percent * b // 100)) <= n)


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size handled by subsets: that with the least total cost over the given sizes."""
    best, total, at = 0.0, 0.0, 0
    for n in range(1, MAX_LIGHT + 1):
        total += (sizes.get(n, 0) + 1e-3) * (subset_cost(n, percent) - SCAN_COST * prefix_length(n, percent))
        if total <= best:
            best, at = total, n
    return at


def subset_keys(s: np.ndarray, percent: int, light: int) -> np.ndarray:
    """Keys of the fixed-size subsets of a set, for each size of the larger set up to `light`."""
    n, found = len(s), [np.empty(0, dtype=np.uint64)]
    with np.errstate(over="ignore"):
        total = s.sum(dtype=np.uint64)
        for b in partners(n, percent):
            c = -(-percent * b // 100)
            if b <= light and c <= n:
                gone = np.array([np.array(x, dtype=np.uint64).sum(dtype=np.uint64) for x in itertools.combinations(s, n - c)], dtype=np.uint64)
                found.append(mix(total - gone + np.uint64(b * 0x632BE59BD9B4E019 % 2**64)))
    return np.concatenate(found)


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _set_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches of a few MB of text with the sets of their rows, so that little is unpacked at a time."""
    for batch in batches:
        for a, b in chunks(byte_lengths(batch.column("text")), CHUNK_BYTES):
            part = batch.slice(a, b - a)
            yield part, shingle_sets(_texts(part.column("text")), words)


def _node(s: np.ndarray, seed: int) -> tuple[int, int]:
    """128 bits of a set: the node's number and a check."""
    with np.errstate(over="ignore"):
        a, b = mix(s + np.uint64(seed)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA0761D6478BD642F)))
    return int(np.uint64(a ^ np.uint64(len(s))).view(np.int64)), int(b.view(np.int64))


def fingerprints(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, node and check (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _set_batches(batches, words):
            nodes = [_node(s, seed) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in nodes], pa.int64()), pa.array([x for _, x in nodes], pa.int64())],
                ["doc_id", "n_shingles", "node", "check"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, check long")


def _distinct_sets(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each set once per task (or once in SEEN_SETS sets), so that copies weigh little."""
    seen: set[int] = set()
    for _, sets in _set_batches(batches, words):
        for s in sets:
            if len(s) and (node := _node(s, seed)[0]) not in seen:
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(node)
                yield node, s


def count_sketch(docs: DataFrame, words: int, seed: int) -> np.ndarray:
    """Counts of shingles by the low bits of their hash, over all documents.

    A task adds up its own; partial sums are grouped by SKETCH_FAN tasks, then as
    a whole. The result has 2**SKETCH_BITS numbers at any input.
    """
    width, per = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, kept, n = np.zeros(width, dtype=np.int64), [], 0
        for _, s in _distinct_sets(batches, words, seed):
            kept.append(s)
            n += len(s)
            if n > 1 << 20:
                sums += np.bincount((np.concatenate(kept) & np.uint64(width - 1)).astype(np.int64), minlength=width)
                kept, n = [], 0
        if kept:
            sums += np.bincount((np.concatenate(kept) & np.uint64(width - 1)).astype(np.int64), minlength=width)
        if sums.any():
            part = TaskContext.get().partitionId() // SKETCH_FAN
            rows = [sums[i * per : (i + 1) * per].astype(np.uint32).tobytes() for i in range(SKETCH_BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([part] * SKETCH_BLOCKS, pa.int32()), pa.array(rows, pa.binary())], ["block", "part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(per, dtype=np.uint64)
        for x in group.column("sums").to_pylist():
            total += np.frombuffer(x, dtype=np.uint32)
        whole = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
        return pa.table({"block": group.column("block").slice(0, 1), "part": group.column("part").slice(0, 1), "sums": pa.array([whole], pa.binary())})

    schema = "block int, part int, sums binary"
    parts = docs.select("text").mapInArrow(count, schema).groupBy("block", "part").applyInArrow(add, schema)
    whole = parts.groupBy("block").applyInArrow(add, schema)
    sketch = np.zeros(width, dtype=np.uint32)
    for row in whole.collect():
        sketch[row["block"] * per : (row["block"] + 1) * per] = np.frombuffer(row["sums"], dtype=np.uint32)
    return sketch


def _entries(batches: Iterator[pa.RecordBatch], counts: np.ndarray, words: int, percent: int, light: int, seed: int) -> Iterator[pa.RecordBatch]:
    """key, node, size, pos of the sets in the batches, about OUT_ENTRIES at a time."""
    mask = np.uint64(len(counts) - 1)

    def out(rows):
        keys, nodes, sizes, pos = zip(*rows, strict=True)
        lens = [len(k) for k in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, dtype=np.int64), lens)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), lens)), pa.array(np.concatenate(pos).astype(np.int32))],
            ["key", "node", "size", "pos"],
        )

    rows, n = [], 0
    for node, s in _distinct_sets(batches, words, seed):
        if len(s) <= light:
            k = subset_keys(s, percent, light)
            rows.append((k, node, len(s), np.full(len(k), -1)))
            n += len(k)
        if partners(len(s), percent)[-1] > light:
            first = np.lexsort((s, counts[(s & mask).astype(np.int64)]))[: prefix_length(len(s), percent)]
            rows.append((s[first], node, len(s), np.arange(len(first))))
            n += len(first)
        if n > OUT_ENTRIES:
            yield out(rows)
            rows, n = [], 0
    if rows:
        yield out(rows)


def list_entries(docs: DataFrame, words: int, percent: int, light: int, seed: int, sketch) -> DataFrame:
    """key, node, size, pos: entries of the inverted lists, and of subsets (pos -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _entries(batches, sketch.value, words, percent, light, seed)

    return docs.select("text").mapInArrow(run, "key long, node long, size int, pos int")


def _may_link(size_a: str, pos_a: str, size_b: str, pos_b: str, percent: int):
    """What two sets can still share from a common shingle on is enough for a link.

    It holds at the first shingle that linked sets share, so some list passes them.
    """
    rest = lambda size, pos: F.col(size) - F.greatest(F.col(pos), F.lit(0))
    return F.least(rest(size_a, pos_a), rest(size_b, pos_b)) * (100 + percent) >= (F.col(size_a) + F.col(size_b)) * percent


def _texts_of(pairs: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """node, text of the nodes in `pairs`, from one document each (rows that share its id come along)."""
    return _texts_at(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, source)


def _texts_at(wanted: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """node, text of the nodes in `wanted`, which has each once."""
    wanted = materialise(wanted.join(nodes, "node").select("node", "first_id"), "join-wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return source.join(few, F.col("doc_id") == F.col("first_id")).select("node", "text")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """Those of `pairs` (a, b) whose sets link, on whole texts; texts of other sets under the same id don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                a, b, left = rows.column("a").to_pylist(), rows.column("b").to_pylist(), rows.column("ta")
                right, good = shingle_sets(_texts(rows.column("tb")), words), []
                for i, y in enumerate(right):
                    if last[0] != a[i]:
                        x = shingle_sets(_texts(left.slice(i, 1)), words)[0]
                        if not len(x) or _node(x, seed)[0] != a[i]:
                            continue
                        last = (a[i], x)
                    x = last[1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both) and len(y) and _node(y, seed)[0] == b[i]:
                        good.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    full = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every node in `edges` (a, b).

    Each round takes the least label among neighbours and then follows labels of
    labels; nothing reaches the driver but whether a label moved. Hot nodes are
    pre-aggregated by the minimum, which Spark combines before the shuffle.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "cc-labels")
    while True:
        far = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(far, "node").select("node", "component", F.least("component", "near").alias("low"))
        # Whom my label points to may itself have moved on.
        jump = met.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = materialise(met.join(jump, "low").select("node", F.least("low", "lower").alias("component"), (F.least("low", "lower") != F.col("component")).alias("moved")), "cc-labels")
        discard(labels)
        labels = new
        if not new.filter("moved").limit(1).count():
            discard(both)
            return labels.select("node", "component")


def links_between(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set of `left` and each of `right`, whether they link."""
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (left, right)]
    _, column, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    # A shingle of one set alone adds to no intersection.
    used = times > 1
    number = np.cumsum(used) - 1
    row, column = row[used[column]], number[column[used[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), dtype=np.int64)
    for at in range(0, int(used.sum()), BLOCK_COLUMNS):
        s, e = np.searchsorted(column, [at, at + BLOCK_COLUMNS])
        m = np.zeros((len(left) + len(right), BLOCK_COLUMNS), dtype=np.float32)
        m[row[s:e], column[s:e] - at] = 1
        both += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def count_within(label: DataFrame, nodes: DataFrame, source: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """node, k: rows whose sum of k is the number of links of a set inside its component.

    Blocks are dealt by hash, so a component of any size is spread over tasks; what is
    broadcast of the components in several blocks is at most one row for BLOCK_SETS sets.
    """
    sized = label.join(nodes.select("node", "size"), "node")
    whole = sized.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("volume")).filter("n > 2")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("volume") / BLOCK_SHINGLES)).cast("int")
    whole = materialise(whole.select("component", blocks.alias("n_blocks")), "join-sized")
    large = whole.filter("n_blocks > 1")
    large = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    of_large = label.join(large, "component").select("node", "component", "n_blocks")
    of_small = label.join(large, "component", "left_anti").join(whole.filter("n_blocks = 1"), "component").select("node", "component", "n_blocks")
    member = materialise(of_large.union(of_small), "join-members")

    def run(group: pa.Table) -> pa.Table:
        side, own = np.array(group.column("block").to_pylist()), group.column("node").to_pylist()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sets = shingle_sets(_texts(group.column("text")), words)
        # Rows that share an id come along with texts of other sets, or with the same one twice.
        at: dict[int, int] = {}
        for x, node in enumerate(own):
            if len(sets[x]) and _node(sets[x], seed)[0] == node:
                at.setdefault(node, x)
        left, right = [x for x in at.values() if side[x] == i], [x for x in at.values() if side[x] == j]
        if not left or not right:
            return pa.table({"node": pa.array([], pa.int64()), "k": pa.array([], pa.int64())})
        linked = links_between([sets[x] for x in left], [sets[x] for x in right], percent)
        if i == j:
            found, of = linked.sum(axis=1) - 1, left
        else:
            found, of = np.concatenate([linked.sum(axis=1), linked.sum(axis=0)]), left + right
        return pa.table({"node": pa.array([own[x] for x in of], pa.int64()), "k": pa.array(found, pa.int64())})

    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    placed = member.join(_texts_at(member.select("node"), nodes, source), "node")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")).withColumn("other", other)
    placed = placed.select("component", "node", "text", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    inside = placed.groupBy("component", "i", "j").applyInArrow(run, "node long, k long")
    # Two sets that are a component link with each other.
    return inside.union(label.join(member, "node", "left_anti").select("node", F.lit(1).cast("long").alias("k")))


def _named_sets(source: DataFrame, words: int) -> tuple[DataFrame, DataFrame, int]:
    """Prints of all rows, one row for each set, and the first seed under which no two sets share a number."""
    for seed in range(1, SEEDS + 1):
        prints = materialise(fingerprints(source, words, seed), "join-prints")
        named = prints.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
        nodes = materialise(named.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("size"), F.min("check").alias("low"), F.max("check").alias("high")), "join-nodes")
        if not nodes.filter("low <> high").limit(1).count():
            return prints, nodes, seed
    raise ValueError(f"different sets share a node number under each of {SEEDS} seeds")


def _candidates(shared: DataFrame, label: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b that share a list across components, and may link by their sizes and positions."""
    marked = shared.join(label, "node", "left").select("key", "node", "size", "pos", F.coalesce("component", "node").alias("part"))
    split = marked.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("key")
    open_lists = materialise(marked.join(split, "key", "left_semi").distinct(), "join-open")
    x, y = open_lists.alias("x"), open_lists.alias("y")
    near = _may_link("x.size", "x.pos", "y.size", "y.pos", percent)
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & near)
    pairs = materialise(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti"), "join-pairs")
    discard(open_lists)
    return pairs


def _joined(docs: DataFrame, words: int, percent: int, by_id: bool) -> DataFrame:
    """Per row: doc_id, n_shingles, node, component_id and its component_node (the least node that carries it), n_links."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints, nodes, seed = _named_sets(source, words)
    sizes = {r["size"]: r["n"] for r in nodes.filter(F.col("size") <= MAX_LIGHT).groupBy("size").agg(F.count("*").alias("n")).collect()}
    light = choose_boundary(sizes, percent)
    sketch = spark.sparkContext.broadcast(count_sketch(source, words, seed))
    entries = materialise(list_entries(source.filter("doc_id IS NOT NULL"), words, percent, light, seed, sketch), "join-entries")
    # A list's head is where the shingle comes first: of copies, the one with the least of its own.
    lists = entries.groupBy("key").agg(F.min(F.struct("pos", "node", "size")).alias("head"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key", "head")
    shared = materialise(entries.join(lists, "key").distinct(), "join-lists")
    discard(entries)
    near = _may_link("head.size", "head.pos", "size", "pos", percent)
    star = shared.filter((F.col("node") != F.col("head.node")) & near)
    star = materialise(star.select(F.least("head.node", "node").alias("a"), F.greatest("head.node", "node").alias("b")).distinct(), "join-star")
    linked = materialise(_verify(star, _texts_of(star, nodes, source), words, percent, seed), "join-links")
    label = components(linked)
    pairs = _candidates(shared, label, star, percent)
    discard(shared, star)
    far = materialise(_verify(pairs, _texts_of(pairs, nodes, source), words, percent, seed), "join-links2")
    discard(pairs)

    links = linked.union(far).distinct()
    if by_id:
        # Ids carried by several sets tie these together.
        named = prints.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
        several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("m")).filter("a <> m").select("doc_id", "a")
        links = links.union(named.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b").distinct())
    final = components(links)
    ends = far.distinct()
    ends = ends.select(F.col("a").alias("node"), F.lit(1).cast("long").alias("k")).union(ends.select("b", F.lit(1).cast("long")))
    degree = ends.union(count_within(label, nodes, source, words, percent, seed)).groupBy("node").agg(F.sum("k").alias("n_links"))
    group = nodes.join(final, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("part"))
    least = group.groupBy("part").agg(F.min(F.struct("first_id", "node")).alias("least"))
    answer = group.join(least, "part").join(degree, "node", "left").select("node", F.col("least.first_id").alias("component_id"), F.col("least.node").alias("component_node"), "n_links")
    return prints.join(answer, "node", "left").select(
        "doc_id", "n_shingles", "node", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "component_node", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.lit(seed).alias("seed")
    )


def join_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """As join_documents, but rows that share an id are told apart by their sets.

    Columns more: node (number of the row's set, null for the empty one), component_node (of the sets in the
    component that have a row of component_id, the least number) and seed, with which with_node() gives the same numbers.
    """
    with scratch_scope():
        return materialise(_joined(docs, words, percent, False), "join-result", outer=True)


def join_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and n_links (verified links of its set) per row."""
    with scratch_scope():
        found = _joined(docs, words, percent, True).select("doc_id", "n_shingles", "component_id", "n_links")
        return materialise(found, "join-result", outer=True)


def with_node(docs: DataFrame, name: str, words: int = WORDS, seed: int = 1) -> DataFrame:
    """docs with the number of each row's set; null for the empty one."""

    @F.arrow_udf("long")
    def number(texts: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for a, b in chunks(byte_lengths(texts), CHUNK_BYTES):
            out += [_node(s, seed)[0] if len(s) else None for s in shingle_sets(_texts(texts.slice(a, b - a)), words)]
        return pa.array(out, pa.int64())

    return docs.withColumn(name, number("text"))


def op4_jaccard_join(spark, sf_dir):
    return join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Brute force over all pairs that share a shingle; n_links counts linked sets that differ.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS h FROM g),
r AS (SELECT min(doc_id) AS node, h, any_value(n_shingles) AS n FROM n WHERE n_shingles > 0 GROUP BY h),
e AS (SELECT r.node, r.n, unnest(g.s) AS s FROM r JOIN g ON r.node = g.doc_id),
p AS (SELECT x.node AS a, y.node AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb FROM e x JOIN e y ON x.s = y.s AND x.node < y.node GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(node, seen) AS (SELECT node, node FROM r UNION SELECT c.node, u.b FROM c JOIN u ON c.seen = u.a),
m AS (SELECT node, min(seen) AS component_id FROM c GROUP BY node),
d AS (SELECT a AS node, count(*) AS k FROM u GROUP BY a)
SELECT n.doc_id, n.n_shingles, coalesce(m.component_id, n.doc_id) AS component_id, coalesce(d.k, 0) AS n_links
FROM n LEFT JOIN r ON n.h = r.h AND n.n_shingles > 0 LEFT JOIN m ON r.node = m.node LEFT JOIN d ON r.node = d.node
"""
