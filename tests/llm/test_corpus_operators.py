"""Operators over the whole corpus: similarity join, mixing, language model, toxicity, pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import SCHEMA, WORDS, hard_rows, passage, save
from weft.llm import jaccard_join, maxent_lm, mixing, toxicity
from weft.llm import registry


def test_join_on_hard_rows(hard):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join_documents(hard).collect()]
    want = brute.groups([(i, t) for i, t, *_ in hard_rows()])
    assert len(rows) == len(hard_rows())
    assert {(i, c) for i, _, c in rows if i is not None} == set(want.items())
    assert [c for i, _, c in rows if i is None] == [None]
    sizes = collections.Counter((i or 0, len(brute.shingles(t))) for i, t, *_ in hard_rows())
    assert collections.Counter((i or 0, n) for i, n, _ in rows) == sizes


def test_join_finds_all_links_of_edited_copies(spark):
    """Groups of copies at all distances around the threshold, large and small sets, a shared passage."""
    rng = random.Random(11)
    shared = passage(rng, 60)
    rows = []
    for n in (5, 6, 7, 8, 9, 11, 12, 14, 17, 20, 30, 60, 150):
        for _ in range(3):
            base = passage(rng, n).split()
            for _ in range(7):
                w = list(base)
                for _ in range(rng.randrange(0, 2 + n // 12)):
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([[], [rng.choice(WORDS)], [w[at], rng.choice(WORDS)]])
                rows.append(" ".join(w))
    rows += [shared + " " + passage(rng, 40) for _ in range(25)]
    rng.shuffle(rows)
    docs = list(enumerate(rows))
    want = brute.groups(docs)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


@pytest.mark.parametrize("block", [256, 7])
def test_join_counts_all_links(spark, monkeypatch, block):
    """Also between the members of a component that head no list, and across blocks of a component."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "BLOCK_COLUMNS", 50)
    base = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(base)), (2, " ".join([*base, "one"])), (3, " ".join([*base, "two", "more"])), (4, " ".join(base))]
    rng = random.Random(3)
    for n in (12, 30, 200):
        text = passage(rng, n).split()
        for _ in range(30):
            w = list(text)
            for _ in range(rng.randrange(0, 2 + n // 30)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append((len(docs) + 1, " ".join(w)))
    docs += [(500, passage(rng, 50)), (501, None), (502, passage(rng, 80)), (503, passage(rng, 80))]
    docs.append((504, docs[-1][1] + " end"))
    want = brute.links(docs)
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.join_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert [want[i] for i in (1, 2, 3, 4)] == [2, 2, 2, 2] and max(want.values()) > 15
    assert got == want


def test_entries_of_short_texts_keep_memory_bounded(monkeypatch):
    """Many two-line texts in one partition: batches of bounded size, and memory that their number doesn't move."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(jaccard_join, "SEEN_SETS", 2_000)
    monkeypatch.setattr(jaccard_join, "OUT_ENTRIES", 10_000)

    def batches():
        for i in range(20):
            yield pa.RecordBatch.from_arrays([pa.array([f"line {i} of {j}\nand two {j % 7} more words {j % 11}" for j in range(i * 1000, (i + 1) * 1000)])], ["text"])

    tracemalloc.start()
    most, n = 0, 0
    for batch in jaccard_join._entries(batches(), np.zeros(1 << 10, dtype=np.uint32), 4, 85, 24, 1):
        most, n = max(most, batch.num_rows), n + batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 100_000 and most < 11_000 and peak < 60 << 20, (n, most, peak)


def test_sets_forgotten_by_a_task_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, passage(rng, 30)) for i in range(40)] + [(100 + i, passage(random.Random(i), 8)) for i in range(20)]
    docs += [(200 + i, t) for i, t in docs[:50]]
    monkeypatch.setattr(jaccard_join, "SEEN_SETS", 2)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.groups(docs)


def test_a_shared_number_asks_for_another_seed(spark, monkeypatch):
    """With numbers of a few bits, two sets clash under the first seeds; the check notices and a later seed serves."""
    real = jaccard_join._node
    monkeypatch.setattr(jaccard_join, "_node", lambda s, seed: (real(s, seed)[0] % 3 if seed < 3 else real(s, seed)[0], real(s, seed)[1]))
    calls = []

    def local(docs, words, seed):
        calls.append(seed)
        rows = [(r["doc_id"], jaccard_join.shingle_sets([(r["text"] or "").encode()], words)[0]) for r in docs.collect()]
        return spark.createDataFrame([(i, len(s), *jaccard_join._node(s, seed)) for i, s in rows], "doc_id long, n_shingles long, node long, check long")

    monkeypatch.setattr(jaccard_join, "fingerprints", local)
    docs = spark.createDataFrame([(i, passage(random.Random(i), 20)) for i in range(12)], "doc_id long, text string")
    assert jaccard_join._named_sets(docs, 4)[2] == 3 and calls == [1, 2, 3]


@pytest.mark.parametrize("light", [0, 9, 16])
def test_keys_of_linked_sets_meet(light):
    """Whatever the boundary, linked sets share a subset key or a list entry."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 30))
        a = np.unique(rng.integers(1, 2**62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(1, 2**62, int(rng.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            larger = max(len(a), len(b))
            if larger <= light:
                assert np.intersect1d(jaccard_join.subset_keys(a, 85, light), jaccard_join.subset_keys(b, 85, light)).size
            else:
                first = lambda s: np.sort(s)[: jaccard_join.prefix_length(len(s), 85)]
                assert np.intersect1d(first(a), first(b)).size


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard_join.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_join_of_nothing(empty, spark):
    assert jaccard_join.join_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(r["component_id"] for r in jaccard_join.join_documents(blank).collect()) == [1, 2]


def water_fill(sizes):
    """source -> target by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix_on_hard_rows(hard):
    rows = mixing.mix(hard).collect()
    sizes = collections.defaultdict(int)
    for _, t, _, s, _ in hard_rows():
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = water_fill(sizes)
    assert len(rows) == len(hard_rows())
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own) / 2 + 1


def test_mix_of_many_rows_is_near_and_repeatable(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(4000)]
    d = spark.createDataFrame(rows, SCHEMA)
    first = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(3)).collect()}
    again = mixing.mix(d.repartition(7, "n_chars")).collect()
    assert first == {r["doc_id"]: r["taken"] for r in again}
    for s in {r[3] for r in rows}:
        own = [r for r in again if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 21


def test_mix_of_very_many_equal_rows(spark):
    """A boundary inside thousands of rows with one id and text: taken words stay within half a row of the target."""
    rows = [(7, "a b c d", "en", "hot", 1)] * 3000 + [(i, "x y", "en", "cold", 1) for i in range(100, 1600)] + [(None, "p q r", None, None, 1)] * 900
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in out) == len(rows) and all(abs(r["taken"] - r["target"]) <= r["size"] / 2 + 1e-6 for r in out)
    whole = mixing.mixed_documents(d).groupBy("source").count().collect()
    assert {r["source"]: r["count"] * {"hot": 4, "cold": 2, None: 3}[r["source"]] for r in whole} == {r["source"]: r["taken"] for r in out}


def test_heavier_documents_come_first(spark):
    d = spark.createDataFrame([(i, "a b c d", "en", "s", 1) for i in range(3000)] + [(10_000 + i, "x " * 40, "en", "t", 1) for i in range(3000)], SCHEMA)
    got = mixing.mix(d, weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)).filter("source = 't'").groupBy(F.col("doc_id") % 2 == 0).agg(F.sum("taken")).collect()
    taken = {r[0]: r[1] for r in got}
    assert taken[True] > 1.5 * taken[False]


def test_mixed_documents_repeat_rows(hard):
    plan = {}
    for r in mixing.mix(hard).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    out = mixing.mixed_documents(hard)
    assert out.columns == hard.columns
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in plan.items() if v}


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def base_scores(rows):
    c, toks = collections.Counter(), []
    for i, t, *_ in rows:
        w = [*brute.WORD.findall(brute.lower(t)), 0]
        toks.append((i, w))
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return n, [(i or 0, len(w), sum(x in c for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in toks]


def test_lm_base_on_hard_rows(hard):
    n, want = base_scores(hard_rows())
    rows = maxent_lm.score(hard, maxent_lm.train(hard)).collect()
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"]) for r in rows)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 * abs(w[3])
    assert {r["train_tokens"] for r in rows} == {n} and all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_lm_with_words_beyond_the_head(hard, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HEAD", 10)
    _, want = base_scores(hard_rows())
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"]) for r in maxent_lm.score(hard, maxent_lm.train(hard)).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 * abs(w[3])


def test_lm_learns_order(spark):
    """Held-out texts with the corpus' order score better than shuffled ones, and better than by counts alone."""
    rng = random.Random(8)
    follow = {w: rng.sample(WORDS, 2) for w in WORDS}

    def walk():
        w = [rng.choice(WORDS)]
        for _ in range(60):
            w.append(rng.choice(follow[w[-1]]))
        return w

    rows = [(i, " ".join(walk())) for i in range(800)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    mixed = [(i, " ".join(rng.sample(t.split(), len(t.split())))) if i in held[: len(held) // 2] else (i, t) for i, t in rows]
    out = {r["doc_id"]: r for r in maxent_lm.op2_frame(spark.createDataFrame(mixed, "doc_id long, text string")).collect()}
    per = lambda ids, c: np.mean([out[i][c] / out[i]["n_tokens"] for i in ids])
    plain, shuffled = held[len(held) // 2 :], held[: len(held) // 2]
    assert per(plain, "score") > per(shuffled, "score") + 0.2 and per(plain, "score") > per(plain, "base_score") + 0.2


def test_lm_probabilities_add_up(spark):
    """Over all classes of one history the two softmax factors add up to one; words and the unseen fill each class."""
    d = spark.createDataFrame([(i, passage(random.Random(i), 50)) for i in range(60)], "doc_id long, text string")
    m = maxent_lm.train(d).model
    t = maxent_lm.Tokens([b"thing aned reble"])
    f, total = t.features(), np.zeros(len(t.hash))
    for s in range(maxent_lm.S):
        a, b = m.logits(f, np.full(len(t.hash), s))
        total += maxent_lm._softmax(a)[0][:, s] * maxent_lm._softmax(b)[0].sum(axis=1)
    assert np.allclose(total, 1, atol=1e-5)


def test_lm_is_a_distribution(spark):
    """For one history, the probabilities of all words and of the unseen in each shared class add up to one."""
    rows = [(i, passage(random.Random(i), 50)) for i in range(60)]
    trained = maxent_lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    m = trained.model
    words = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split()})
    total = 0.0
    for word in [*words, None]:
        # The word behind "thing", or the end there.
        t = maxent_lm.Tokens([b"thing" if word is None else f"thing {word}".encode()])
        c, f = m.classes(t), t.features()
        a, b = m.logits(f, c % maxent_lm.S)
        p = maxent_lm._softmax(a)[0][1, c[1] % maxent_lm.S] * maxent_lm._softmax(b)[0][1, c[1] // maxent_lm.S]
        total += p * 10 ** (m.log_count[m.find_head(t.hash)[1]] - m.log_class[c[1]])
    share = 10 ** (math.log10(maxent_lm.SMOOTH) - m.log_class[maxent_lm.OWN :])
    t = maxent_lm.Tokens([b"thing x"])
    for k, unseen in enumerate(share, maxent_lm.OWN):
        a, b = m.logits(t.features(), np.full(len(t.hash), k % maxent_lm.S))
        total += unseen * maxent_lm._softmax(a)[0][1, k % maxent_lm.S] * maxent_lm._softmax(b)[0][1, k // maxent_lm.S]
    assert abs(total - 1) < 1e-4


def test_lm_of_nothing(empty, spark):
    assert maxent_lm.op2_frame(empty).count() == 0
    only_held = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = maxent_lm.op2_frame(only_held).first()
    assert r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"])


def toxic_rows():
    rng = random.Random(6)
    slurs = ["gronk", "vlipo", "murzed", "taxxor"]
    docs, labels = [], []
    for i in range(600):
        w = passage(rng, 80).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(slurs))
        docs.append((i, " ".join(w) + ".", "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_learns_words_and_holds_out(spark, tmp_path):
    docs, labels = toxic_rows()
    sf = save(spark, tmp_path, docs, [*labels, (None, 1, 1), (5, None, None)])
    rows = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, sf).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] for i, _ in held)
    assert np.mean([rows[i]["predicted"] == t for i, t in held]) > 0.97


def test_toxicity_without_labels(hard, spark):
    scorer = toxicity.train(hard, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    scores = [r["s"] for r in toxicity.with_score(hard, scorer, "s").collect()]
    assert len(scores) == len(hard_rows()) and all(0 <= s < 0.5 for s in scores)
    assert scorer.scores([None, ""])[0] == scorer.scores([""])[0]


def test_toxicity_clauses():
    s = toxicity.Scorer(dict.fromkeys(toxicity.INSULTS, toxicity.SEED_WEIGHT), toxicity.PRIOR)
    tags = lambda t: dict(zip(("bias", *toxicity.TAGS, "clauses", "density"), s.features(t) > 0, strict=True))
    assert tags("what an idiot")["plain"] and tags("you are an idiot")["directed"]
    assert tags("that is not stupid")["negated"] and not tags("that is not stupid")["plain"]
    assert tags("she said he is a moron")["reported"]
    assert tags("they will kill you")["threat"] and not tags("kill the process")["threat"]
    assert tags("idiot, you")["directed"] and tags("idiot you are")["directed"] and not tags("idiot of a plan for you")["directed"]
    assert not tags("I kill not never no you")["threat"] and not tags("he will kill the process")["threat"] and not tags("all tests beat the baseline")["threat"]
    assert tags("sie sind ein trottel")["directed"] and tags("quel crétin")["plain"]
    assert s.scores(["you idiot, you pathetic loser. you are scum."])[0] > 0.5 > s.scores(["not stupid"])[0]


def plain_tags(s, text):
    """Weights by tag of a text, the machines run one after the other over each clause."""
    out = dict.fromkeys(toxicity.TAGS, 0.0)
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        kinds = [s.symbols.get(w, "o") for w in words]
        for i, (w, k) in enumerate(zip(words, kinds, strict=True)):
            back = kinds[:i]
            # How many words ago the last negation or target stood, up to four.
            near = lambda x: x in back[-toxicity.SCOPE :]  # noqa: E731,B023
            said, weight = "R" in back, s.words.get(w, toxicity.SEED_WEIGHT)
            if k == "I":
                if said:
                    out["reported"] += 0.5 * weight
                elif near("N"):
                    out["negated"] += 0.5 * weight
                elif near("G"):
                    out["directed"] += 1.3 * weight
                else:
                    out["plain"] += weight
            elif k == "T" and said:
                out["reported"] += 0.5 * weight
            elif k == "T" and near("N"):
                out["negated"] += 0.2 * weight
            elif k == "G" and not said:
                # An open insult or threat right before, or with one ordinary word between.
                j = i - 1 if i and kinds[i - 1] in "IT" else i - 2 if i > 1 and kinds[i - 1] == "o" and kinds[i - 2] in "IT" else None
                before = [] if j is None else kinds[max(0, j - toxicity.SCOPE) : j]
                if j is not None and "N" not in before:
                    if kinds[j] == "T":
                        out["threat"] += weight
                    elif "G" not in before:
                        out["directed"] += 0.3 * weight
    return out


def test_toxicity_features_by_plain_rules():
    """Random clauses of all kinds of words: the composed machine against rules on positions."""
    s = toxicity.Scorer(dict.fromkeys(toxicity.INSULTS, toxicity.SEED_WEIGHT) | {"gronk": 1.5}, toxicity.PRIOR)
    rng = random.Random(3)
    pools = [sorted(toxicity.INSULTS) + ["gronk"], sorted(toxicity.THREATS), sorted(toxicity.TARGETS), ["not", "never"], ["said", "wrote"], WORDS, WORDS, WORDS]
    for _ in range(3000):
        text = " ".join(rng.choice(rng.choice(pools)) + rng.choice(["", "", "", "", ",", ".", "!"]) for _ in range(rng.randrange(1, 25)))
        got = s.features(text)[1:6]
        assert np.allclose(got, [math.log1p(plain_tags(s, text)[t]) for t in toxicity.TAGS]), text


def test_toxicity_on_long_and_repeated_texts(spark, empty):
    s = toxicity.Scorer(dict.fromkeys(toxicity.INSULTS, toxicity.SEED_WEIGHT), toxicity.PRIOR)
    bad = "you pathetic idiot, you worthless scum. "
    rows = [(1, bad * 3), (1, bad * 3), (2, passage(random.Random(1), 40_000)), (3, passage(random.Random(1), 2000) + bad * 2000), (4, None)]
    out = toxicity.with_score(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["score"] >= 0.5)
    assert by == {1: {True}, 2: {False}, 3: {True}, 4: {False}}
    assert toxicity.with_score(empty, s).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs, labels = toxic_rows()
    copies = [(1000, docs[1][1], "en", "s", 1), (1001, docs[2][1].replace("thing", "changed", 1), "de", "t", 1)]
    secret = [(1002, passage(random.Random(1), 70) + ' password = "hunter2hunter2" ok.', "en", "t", 1), (1003, None, None, None, None), (1004, "", "en", "t", 0)]
    rows = docs + copies + secret
    sf = save(spark, tmp_path, rows, labels)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, frame, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == frame.columns
        kept[name] = after.collect()
        frame = after
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    toxic = {i for i, _, t in labels if t}
    assert not ids("toxicity") & toxic or len(ids("toxicity") & toxic) <= 3
    assert len(ids("toxicity")) >= len(rows) - len(toxic) - 3
    want = brute.groups([(r["doc_id"], r["text"]) for r in kept["toxicity"]])
    assert ids("jaccard_join") == set(want.values())
    assert ids("secret_scan") == ids("jaccard_join")
    assert "[secret]" in next(r["text"] for r in kept["secret_scan"] if r["doc_id"] == 1002)
    assert len(kept["byte_bpe"]) == len(kept["mix_sources"])
    assert sorted(r["decoded_sha256"] for r in kept["byte_bpe"]) == sorted(brute.sha(r["text"] or "") for r in kept["mix_sources"])
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, kept["byte_bpe"]), key=repr)


@pytest.mark.parametrize("stage", ["toxicity", "jaccard_join", "byte_bpe"])
def test_pipeline_stages_hand_python_small_batches(spark, tmp_path, stage):
    key, row = "spark.sql.execution.arrow.maxBytesPerBatch", 20_000
    sizes = lambda d: [r[0] for r in d.select("text").mapInArrow(lambda batches: (b.from_arrays([[b.nbytes]], ["n"]) for b in batches), "n long").collect()]
    wide = spark.range(0, 500, 1, 1).select("id", F.repeat(F.lit("x"), row).alias("text"))
    sf = save(spark, tmp_path)
    run = dict(corpus_pipeline.STAGES)[stage]
    before = spark.conf.get(key)
    try:
        for bound, most in (("64m", corpus_pipeline.BATCH_BYTES), ("100k", 100 << 10)):
            spark.conf.set(key, bound)
            run(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
            found = sizes(wide)
            assert max(found) <= most + 2 * row and sum(found) >= 500 * row
        spark.conf.set(key, "64m")
        if stage == "byte_bpe":
            corpus_pipeline.run(spark, sf)
            assert spark.conf.get(key) == "64m"
    finally:
        spark.conf.set(key, before)


def test_near_copies_at_five_words_and_four_fifths(spark, tmp_path):
    """Pairs between the limits of op4 and of the stage, and groups around the stage's limit."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(140)]
    edited = [f"new{i}" if i in (30, 70, 110) else w for i, w in enumerate(base)]
    texts = [" ".join(base), " ".join(edited)]
    for n in (6, 9, 15, 40, 100):
        text = passage(rng, n).split()
        for _ in range(12):
            w = list(text)
            for _ in range(rng.randrange(0, 3 + n // 25)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    docs = list(enumerate(texts))
    want = set(brute.groups(docs, 80, 5).values())
    assert 1 not in want and 1 in set(brute.groups(docs).values())
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], SCHEMA)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame, str(tmp_path)).collect()} == want


def test_near_copies_of_rows_that_share_an_id(spark, tmp_path):
    """Unrelated texts under one id both stay; copies go wherever they stand; wordless and id-less rows pass."""
    rng = random.Random(12)
    a, b, c = passage(rng, 60), passage(rng, 60), passage(rng, 60)
    rows = [(1, a, "en"), (1, b, "en"), (1, b, "de"), (2, a + " end", "en"), (3, c, "en"), (3, c, "en"), (None, a, "en"), (4, "", "en"), (4, None, "en"), (5, b.upper(), "en")]
    frame = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], SCHEMA)
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, frame, str(tmp_path)).collect()))
    assert kept == sorted([(1, a), (1, b), (3, c), (0, a), (4, ""), (4, "")])


def test_stages_with_clashing_columns(hard, spark, tmp_path):
    """Each stage keeps the columns it gets, whatever their names."""
    save(spark, tmp_path / "t", labels=[(4, 1, 0), (5, 1, 1)])
    frame = hard.withColumns({c: F.lit("clash") for c in ("__weft_node", "__weft_base", "__gone", "__id", "component_id", "seed", "taken")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, str(tmp_path / "t"))
        assert after.columns == frame.columns and after.filter("size = 'clash'").count() == after.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "").count() == frame.count()


def test_scratch_is_deleted(spark, tmp_path):
    import os

    from weft.llm.common import shared_dir

    sf = save(spark, tmp_path)
    before = set(os.listdir(shared_dir(spark)))
    corpus_pipeline.run(spark, sf).count()
    left = set(os.listdir(shared_dir(spark))) - before
    assert len(left) == 1 and "pipeline-result" in next(iter(left))


def test_pipeline_on_hard_rows_and_on_nothing(spark, tmp_path):
    sf = save(spark, tmp_path / "a")
    assert corpus_pipeline.run(spark, sf).count() > 0
    sf = save(spark, tmp_path / "b", [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_registry_has_the_ten():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))
