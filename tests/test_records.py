"""Hashes, tool schemas and span masks."""

import hashlib
import json

import xxhash
from pyspark.sql import functions as F

from weft.functions import records


def test_bit_exact_hashes(spark):
    d = spark.createDataFrame([("a",), ("é",), (None,)], "t string")
    rows = d.select("t", records.blake2b_score(F.col("t")).alias("b"), records.xxh3(F.col("t"), 64).alias("x")).collect()
    for r in rows:
        raw = (r["t"] or "").encode()
        assert r["b"] == str(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big")) and r["x"] == xxhash.xxh3_64_hexdigest(raw)


def test_tool_schema():
    out = json.loads(records.normalise_tool('{"type": "function", "function": {"name": "f", "parameters": {"properties": {"a": {"type": ["str", "int"]}, "b": {}}}}}'))
    assert out["function"]["parameters"] == {"type": "object", "required": [], "properties": {"a": {"type": ["string", "integer"]}, "b": {"type": "string"}}}
    assert records.normalise_tool("[1]") is None and records.normalise_tool("{") is None and records.normalise_tool(None) is None


def test_span_masks():
    text = "so \\boxed{ 12 } and \\boxed{34}"
    assert records.answer_spans(text) == [(text.index("34"), text.index("34") + 2)]
    assert sum(records.span_mask(text, records.answer_spans(text))) == 2
    assert records.answer_spans("x \\boxed{7") == [(9, 10)] and records.answer_spans("none") == []
