"""The battery of op6: planted random tokens, harmless identifiers, a plain Python version, hard rows, long texts."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import hard_rows
from tests.oracle import same
from weft.llm import secret_scan as ss

# None of these words was used to fit the null distributions.
WORDS = "process handler config manager service controller request response adapter provider builder context session cache entity model view template layout widget panel dialog window frame".split()
LENGTHS = (20, 24, 32, 40, 64, 128, 200)


def random_token(rng, encoding, n):
    """A random token whose narrowest alphabet is the given one."""
    while True:
        s = "".join(rng.choice(ss.ALPHABETS[encoding]) for _ in range(n))
        if brute.encoding(s) == encoding and any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            return s


def identifier(rng):
    words, number = [rng.choice(WORDS) for _ in range(rng.randrange(3, 7))], str(rng.randrange(10_000))
    form = rng.choice(["snake", "camel", "path", "kebab"])
    return {"snake": "_".join(words) + number, "camel": "".join(map(str.capitalize, words)) + number, "path": "/".join(words) + "/" + number, "kebab": "-".join(words) + "-" + number}[form]


def structured_hex(rng):
    return rng.choice([f"{rng.randrange(10**6):020d}a", f"2024{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}{rng.randrange(24):02d}{rng.randrange(60):02d}00b{rng.randrange(1000):06d}", "deadbeefdeadbeef" + f"{rng.randrange(100):08d}"])


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(42)
    rows = [(e, n, random_token(rng, e, n)) for e in ss.ALPHABETS for n in LENGTHS for _ in range(30)]
    rows += [("harmless", 0, identifier(rng)) for _ in range(1500)] + [("harmless", 0, structured_hex(rng)) for _ in range(200)]
    return [(i, f"see {s} there", e, n) for i, (e, n, s) in enumerate(rows)]


def test_recall_and_false_discoveries(spark, planted):
    d = spark.createDataFrame([(i, t) for i, t, *_ in planted], "doc_id long, text string")
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in ss.scan(d).collect()}
    hit, all_ = collections.Counter(), collections.Counter()
    for i, _, e, n in planted:
        hit[e] += bool(found[i])
        all_[e] += 1
        if e != "harmless" and n >= 32:
            hit[e, "long"] += bool(found[i])
            all_[e, "long"] += 1
    assert all(hit[e] >= 0.9 * all_[e] and hit[e, "long"] >= 0.95 * all_[e, "long"] for e in ss.ALPHABETS), hit
    added = [i for i, *_ in planted if "random" in found[i]]
    false = [i for i in added if planted[i][2] == "harmless"]
    assert len(added) > 1000 and len(false) <= 0.02 * len(added)


def test_alone_among_identifiers(spark):
    """Identifiers without any secret: the control holds where nothing is to be found."""
    rng = random.Random(7)
    d = spark.createDataFrame([(i, f"{identifier(rng)} and {identifier(rng)}") for i in range(1500)], "doc_id long, text string")
    assert ss.scan(d).filter(F.size("spans") > 0).count() <= 3


def test_equals_plain_version(spark):
    rng = random.Random(3)
    tokens = [random_token(rng, rng.choice(list(ss.ALPHABETS)), rng.randrange(20, 90)) for _ in range(250)] + [identifier(rng) for _ in range(250)] + [structured_hex(rng) for _ in range(40)]
    tokens += ["a/b-c" * 8 + "1", "abcdefghijklmnopqrstuvwxyz0123456789", "token=" + random_token(rng, "alnum", 30), "AKIA" + random_token(rng, "upper", 20), random_token(rng, "base64", 43) + "="]
    rows = [" ".join(rng.sample(tokens, rng.randrange(1, 9))) + rng.choice(["", " é😀", "=", "\n"]) for _ in range(200)] + [None, ""]
    rows += rows[:3]
    d = spark.createDataFrame([(i % 90, t) for i, t in enumerate(rows)], "doc_id long, text string")
    want = brute.secret_spans(rows)
    got = [(r["text"] or "", [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"]]) for r in ss.scan(d).collect()]
    assert sorted(got) == sorted((t or "", s) for t, s in zip(rows, want, strict=True))
    assert sum(k == "random" for s in want for *_, k in s) > 150


def test_equals_sql(spark, tmp_path, planted):
    rng = random.Random(5)
    docs = [(i, f"{t} password = '{random_token(rng, 'alnum', 24)}' {structured_hex(rng)}" if i % 50 == 0 else t) for i, t, *_ in planted] + [(None, None), (None, ""), (3, "token=abcdefghij ſecret=abcdefghij")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(ss.op6_secret_scan(spark, str(tmp_path)), ss.SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"), str(tmp_path / "none"))


def test_hard_rows_with_clashing_columns(hard):
    d = hard.withColumns({"__weft_base": F.lit(1), "__weft_tested": F.lit(2), "hit": F.lit(3)})
    out = ss.scan(d)
    assert sorted(out.columns) == sorted(d.columns)
    want = brute.secret_spans([t for _, t, *_ in hard_rows()])
    got = [((r["doc_id"] or 0), [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"]]) for r in out.collect()]
    assert sorted(got) == sorted((i or 0, s) for (i, *_), s in zip(hard_rows(), want, strict=True))


def test_repeated_rows_and_empty_table(spark, empty):
    t = "token=abcdefgh12 " + random_token(random.Random(1), "base64", 44)
    assert ss.scan(spark.createDataFrame([(1, t)] * 3, "doc_id long, text string")).select("spans").distinct().count() == 1
    assert ss.scan(empty).count() == 0


def test_redaction_of_long_texts(spark):
    """Thousands of spans across many blocks, overlapping and touching ones, against a plain version."""
    rng = random.Random(2)
    pieces = ["token=abcdefgh1 ", "é😀 ", "0f" * 16 + " ", "AKIA" + "B" * 16 + " ", "word " * 40, "secret: " + "ab" * 20, "password='x" + "1f" * 20 + "' "]
    rows = ["".join(rng.choice(pieces) for _ in range(n)) for n in (1, 3, 40, 400, 6000)] + ["", "x" * 1024 + "token=abcdefgh1", "token=abcdefgh1"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    out = {r["doc_id"]: r["x"] for r in ss.scan(d).select("doc_id", ss.redact(F.col("text"), F.col("spans")).alias("x")).collect()}
    for i, t in enumerate(rows):
        want, at = [], 0
        for start, _, end, _ in brute.secret_spans(rows)[i]:
            if start >= at:
                want += [t[at:start], "[secret]"]
            at = max(at, end)
        assert out[i] == "".join(want) + t[at:]


def test_constants_of_random_tokens():
    """Mean and deviation of the runs under randomness, by simulation."""
    rng = random.Random(4)
    for e in ("hex", "lower", "alnum", "base64"):
        runs = [brute.battery(random_token(rng, e, 48))[2] for _ in range(600)]
        mean = sum(runs) / len(runs)
        assert abs(mean) < 0.25 and abs(math.sqrt(sum((x - mean) ** 2 for x in runs) / len(runs)) - 1) < 0.15
