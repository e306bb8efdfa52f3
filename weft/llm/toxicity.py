"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps words to symbols: insults and threats, hand-written and
learned from labels, targets, negations and verbs of reported speech. Five transducers
(reported speech, negation, target, insult, threat) are composed into one machine, which
tags every insult or threat of a clause as plain, directed, negated or reported.
A document's features are the tagged weights of its matched clauses; a logistic
model over them, fitted near hand-set weights, gives the score.

Labels are learned only from rows that are not held out (crc32 of the id as text
mod 5 is 0), on a sample by hash of at most about SAMPLE rows. The score reads
the text alone.

Defined cases: null and empty texts match nothing and get the score of no match,
below 0.5. With no labels the hand-set lexicon and weights hold. Repeated rows
get equal scores. Several labels of one id count one by one; null labels don't. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import is_held_out

FOLDS = 5
#: Labelled rows to learn from: about this many at most, by hash.
SAMPLE = 20_000
#: Learned words: in at least so many toxic rows, so much likelier there (at the lower end of a 90 % interval).
MIN_ROWS, MIN_RATIO = 4, 8.0

INSULTS = {"idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "clowns", "dumb", "imbecile", "filth", "vermin", "jerk", "bastard", "dummkopf", "trottel", "versager", "abschaum", "schwachkopf", "idioten", "imbécile", "crétin", "ordure", "abruti", "raclure", "idiota", "imbécil", "estúpido", "escoria"}
THREATS = {"kill", "hurt", "destroy", "murder", "strangle", "stab", "shoot", "beat", "crush", "burn"}
TARGETS = {"you", "your", "youre", "u", "he", "she", "they", "them", "him", "her", "everyone", "people", "all", "tu", "vous", "du", "ihr", "sie", "ustedes", "usted"}
NEGATIONS = {"not", "no", "never", "isn", "aren", "wasn", "don", "doesn", "without", "hardly", "nicht", "kein", "keine", "pas", "jamais", "nunca", "ni"}
REPORTS = {"said", "says", "called", "calls", "wrote", "writes", "reported", "claims", "claimed", "quoted", "alleged", "sagte", "nannte", "dit", "appelé", "dijo", "llamó"}
#: How far a negation reaches, and how near a target must be, in words.
SCOPE = 4
SEED_WEIGHT = 3.0
TAGS = ("plain", "directed", "negated", "reported", "threat")
#: Prior of the logistic model: bias, one weight for each tag, one for matched clauses, one for matches in 100 words.
PRIOR = np.array([-3.0, 1.2, 1.6, 0.2, 0.3, 1.0, 0.5, 0.0])


class Transducer:
    """Deterministic weighted transducer: (state, symbol) -> (state, symbol, weight). Missing arcs loop with the symbol as it is."""

    def __init__(self, arcs: dict[tuple, tuple], start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or self.arcs.get((state, "*")) and self._any(state, symbol) or (state, symbol, 1.0)

    def _any(self, state, symbol):
        to, _, weight = self.arcs[(state, "*")]
        return to, symbol, weight

    def compose(self, other: Transducer, alphabet: str) -> Transducer:
        """The machine that feeds this one's output to the other: the reachable part of the product."""
        start = (self.start, other.start)
        arcs, open_states, seen = {}, [start], {start}
        while open_states:
            p, q = open_states.pop()
            for symbol in alphabet:
                p2, mid, w1 = self.step(p, symbol)
                q2, out, w2 = other.step(q, mid)
                arcs[((p, q), symbol)] = ((p2, q2), out, w1 * w2)
                if (p2, q2) not in seen:
                    seen.add((p2, q2))
                    open_states.append((p2, q2))
        return Transducer(arcs, start)


def _decay(symbol: str, inside: dict[str, tuple[str, float]]) -> Transducer:
    """A window of SCOPE words after `symbol`, in which some symbols are rewritten."""
    arcs: dict[tuple, tuple] = {(0, symbol): (1, symbol, 1.0)}
    for k in range(1, SCOPE + 1):
        after = k + 1 if k < SCOPE else 0
        arcs[(k, "*")] = (after, "*", 1.0)
        arcs[(k, symbol)] = (1, symbol, 1.0)
        for s, (out, weight) in inside.items():
            arcs[(k, s)] = (after, out, weight)
    return Transducer(arcs)


def grammar() -> Transducer:
    """Symbols: I insult, T threat, G target, N negation, R report, o other; out: D directed, n negated, r reported, t threat at a target."""
    reported = Transducer({(0, "R"): (1, "R", 1.0), (1, "I"): (1, "r", 0.5), (1, "T"): (1, "r", 0.5)})
    negated = _decay("N", {"I": ("n", 0.5), "T": ("n", 0.2)})
    directed = _decay("G", {"I": ("D", 1.3)})
    # An insult whose target follows ("idiot, you") is directed as well; the target carries a part of its weight.
    insult = Transducer({(0, "I"): (1, "I", 1.0), (1, "I"): (1, "I", 1.0), (1, "G"): (0, "D", 0.3), (1, "o"): (2, "o", 1.0), (1, "*"): (0, "*", 1.0), (2, "I"): (1, "I", 1.0), (2, "G"): (0, "D", 0.3), (2, "*"): (0, "*", 1.0)})
    # A threat counts with its target behind it, one word between them at most; alone it is an ordinary verb.
    threat = Transducer({(0, "T"): (1, "o", 1.0), (1, "T"): (1, "o", 1.0), (1, "G"): (0, "t", 1.0), (1, "o"): (2, "o", 1.0), (1, "*"): (0, "*", 1.0), (2, "T"): (1, "o", 1.0), (2, "G"): (0, "t", 1.0), (2, "*"): (0, "*", 1.0)})
    alphabet = "ITGNRo"
    machine = reported.compose(negated, alphabet).compose(directed, alphabet).compose(insult, alphabet).compose(threat, alphabet)
    # States by number, for speed.
    number = {machine.start: 0}
    for (p, _), (q, _, _) in machine.arcs.items():
        number.setdefault(p, len(number)), number.setdefault(q, len(number))
    return Transducer({(number[p], s): (number[q], o, w) for (p, s), (q, o, w) in machine.arcs.items()})


_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_TAG_OF = {"I": 0, "D": 1, "n": 2, "r": 3, "t": 4}


class Scorer:
    """Lexicon, machine and model; everything a task needs."""

    def __init__(self, words: dict[str, float], model: np.ndarray):
        self.words, self.model = words, model
        self.symbols = {**dict.fromkeys(REPORTS, "R"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(TARGETS, "G"), **dict.fromkeys(THREATS, "T"), **dict.fromkeys(words, "I")}
        self.telling = words.keys() | THREATS
        self.machine = grammar().arcs

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(PRIOR))
        out[0] = 1.0
        lowered = (text or "").lower()
        everything = _WORD.findall(lowered)
        if self.telling.isdisjoint(everything):
            return out
        for clause in _CLAUSE.split(lowered):
            words, state, hit = _WORD.findall(clause), 0, False
            if self.telling.isdisjoint(words):
                continue
            for w in words:
                state, tag, weight = self.machine[(state, self.symbols.get(w, "o"))]
                at = _TAG_OF.get(tag)
                if at is not None:
                    out[1 + at] += weight * self.words.get(w, SEED_WEIGHT)
                    hit = True
            out[-2] += hit
        # Chance matches grow with a text's length; meant ones stand close.
        out[-1] = out[1:-2].sum() * 100 / (100 + len(everything))
        out[1:] = np.log1p(out[1:])
        return out

    def scores(self, texts) -> np.ndarray:
        z = np.array([self.features(t) @ self.model for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn_words(labelled: DataFrame) -> dict[str, float]:
    """Weights of insults, by how much likelier a word is in toxic rows. Rows: text, toxic."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    totals = labelled.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = totals["t"] or 0, totals["c"] or 0
    counts = labelled.select("toxic", F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    ratio = ((F.col("t") + 0.5) / (toxic + 1.0)) / ((F.col("c") + 0.5) / (clean + 1.0))
    seeds = sorted(INSULTS | THREATS)
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    sure = F.log(ratio) - 1.645 * spread >= math.log(MIN_RATIO)
    found = counts.withColumn("ratio", ratio).filter(((F.col("t") >= MIN_ROWS) & sure) | (F.col("word").isin(seeds) & (F.col("t") + F.col("c") >= MIN_ROWS)))
    weights = dict.fromkeys(INSULTS, SEED_WEIGHT)
    # The sample bounds their number: a word stands in MIN_ROWS toxic rows of at most about SAMPLE.
    for r in found.collect():
        if r["word"] not in THREATS:
            weights[r["word"]] = min(5.0, max(0.0, math.log(r["ratio"])))
    return {w: x for w, x in weights.items() if x > 0.1}


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to PRIOR by a ridge."""
    model = PRIOR.copy()
    for _ in range(30 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ model, -30, 30)))
        grad = x.T @ (p - y) + (model - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(model)), grad)
        model -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learn lexicon and model from labelled rows that are not held out."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter(~is_held_out(F.col("__id"), FOLDS))
    n = marks.count()
    if n > sample:
        marks = marks.filter(F.pmod(F.xxhash64(F.col("__id"), F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    # At most about `sample` ids of 8 bytes and a flag, so the broadcast has a bound.
    labelled = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(marks), "__id").select("text", "toxic")
    words = learn_words(labelled)
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(words, PRIOR))

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.features(t.as_py()).tolist() for t in texts], pa.list_(pa.float64()))

    rows = labelled.select(features("text").alias("x"), "toxic").groupBy("x", "toxic").count().collect() if n else []
    x = np.array([r["x"] for r in rows]).reshape(-1, len(PRIOR))
    y, w = np.array([r["toxic"] for r in rows], dtype=float), np.array([r["count"] for r in rows], dtype=int)
    return Scorer(words, fit(np.repeat(x, w, axis=0), np.repeat(y, w)))


def with_score(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """All columns of docs and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        # One text at a time leaves the Arrow buffer, however long the texts are.
        return pa.array(shared.value.scores(t.as_py() for t in texts), pa.float64())

    return docs.withColumn(name, score("text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs, scorer).select("doc_id", is_held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
