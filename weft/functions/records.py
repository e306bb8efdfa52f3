"""Tool schemas, chunked messages, hashes and span masks of dataset records."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import strip
from weft.functions.tokens import TOKEN

# Names of types in tool descriptions and their JSON Schema types; all else is string.
JSON_TYPES = {"int": "integer", "integer": "integer", "long": "integer", "float": "number", "double": "number", "number": "number", "bool": "boolean", "boolean": "boolean", "dict": "object", "map": "object", "object": "object", "list": "array", "array": "array", "sequence": "array"}
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
QUESTION_WORDS = ("what ", "which ", "who ", "where ", "when ", "why ", "how ")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")


def json_schema_type(name: Column) -> Column:
    """The JSON Schema type of a loose type name such as "Dict, optional"."""
    plain = F.lower(F.trim(F.get(F.split(F.trim(F.coalesce(name, F.lit(""))), ","), 0)))
    table = F.create_map(*[F.lit(x) for pair in JSON_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), F.lit("string"))


def _schema_type(name) -> str:
    return JSON_TYPES.get(str(name or "").split(",")[0].strip().lower(), "string")


def normalise_tool(text: str | None) -> str | None:
    """A tool description in JSON as {"type": "function", "function": ...} with typed parameters; null if it is no object."""
    try:
        tool = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(tool, dict):
        return None
    inner = dict(tool["function"]) if isinstance(tool.get("function"), dict) else dict(tool)
    given = inner.get("parameters")
    params = dict(given) if isinstance(given, dict) else {}
    params["type"] = "object" if params.get("type") is None else _schema_type(params["type"])
    params.setdefault("required", inner.get("required", []))
    fields = params.get("properties")
    params["properties"] = {}
    for name, spec in (fields if isinstance(fields, dict) else {}).items():
        if isinstance(spec, dict):
            kind = spec.get("type")
            spec = {**spec, "type": [_schema_type(k) for k in kind] if isinstance(kind, list) else _schema_type(kind)}
        params["properties"][name] = spec
    return json.dumps({"type": "function", "function": {**inner, "parameters": params}}, ensure_ascii=False, sort_keys=True)


def merge_chunks(chunks: Column) -> Column:
    """Text of a message given as chunks (struct<type, text>): texts as they are, <img> for images, stripped."""
    part = lambda c: F.when(c["type"] == "text", F.coalesce(c["text"], F.lit(""))).when(c["type"] == "image", "<img>").otherwise("")
    return strip(F.array_join(F.transform(chunks, part), ""))


def answer_fits(question: Column, answer: Column) -> Column:
    """False for plain mismatches: yes or no to an open question, how many without a number, an empty side."""
    one_line = lambda x: F.lower(strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    q, a = one_line(question), F.btrim(one_line(answer), F.lit(" .!?"))
    starts = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.startswith(q, w))
    polar = starts(QUESTION_WORDS) & a.isin("yes", "no")
    uncounted = starts(("how many ", "what number ")) & ~a.rlike(r"\p{Nd}") & ~a.isin(*NUMBER_WORDS)
    return (q != "") & (a != "") & ~polar & ~uncounted


def assembly_reason(views: Column, text: Column, split: Column) -> Column:
    """Why a packed record is rejected, the first check that fails; null if none."""
    return (
        F.when(F.coalesce(views, F.lit(-1)) != 5, "not_five_views")
        .when(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("<img>")) != 1, "bad_image_marker")
        .when(F.contains(text, F.lit("<|im_start|>assistant\n<img>")), "assistant_image_marker")
        .when(~F.coalesce(split, F.lit("")).isin("train", "eval"), "bad_split")
    )


def valid_views(index: Column, images: Column, meta: Column, views: int) -> Column:
    """A visual row as a validating scan wants it: an index from 0, so many images of known kinds, meta that is a JSON object."""
    known = F.forall(images, lambda f: F.lower(F.regexp_extract(F.coalesce(f, F.lit("")), r"(\.[A-Za-z0-9]+)$", 1)).isin(*IMAGE_EXTENSIONS))
    return F.coalesce((index >= 0) & (F.size(images) == views) & known & F.from_json(meta, "map<string,string>").isNotNull(), F.lit(False))


def verify(name: Column, text: Column, value: Column) -> Column:
    """A constraint by name with one argument; unknown names and failing arguments are false."""
    n = value.try_cast("int")
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))
    found = (
        F.when(name == "min_words", words >= n)
        .when(name == "max_words", words <= n)
        .when(name == "contains", F.contains(F.lower(text), F.lower(value)))
        .when(name == "excludes", ~F.contains(F.lower(text), F.lower(value)))
        .when(name == "no_comma", ~F.contains(text, F.lit(",")))
        .when(name == "lowercase", F.lower(text) == text)
        .when(name == "paragraphs", F.size(F.split(text, r"\n\s*\n")) == n)
    )
    return F.coalesce(found, F.lit(False))


def tile_to_thumb(x: Column, offset: Column, scale: Column, crop: Column, thumb_scale: Column, thumb_offset: Column, cell: float, cells: int) -> Column:
    """struct<cell, off>: where a coordinate of a tile falls on the thumbnail's grid, and how far from that cell's centre."""
    at = (((x - offset) / scale + crop) * thumb_scale + thumb_offset) / cell
    index = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(at)))
    return F.struct(index.cast("int").alias("cell"), F.greatest(F.lit(-0.5), F.least(F.lit(0.5), at - index - 0.5)).alias("off"))


def blake2b_score(column: Column, size: int = 8) -> Column:
    """The digest as a decimal string, for orders that must agree with other tools bit by bit."""

    @F.pandas_udf("string")
    def score(values: pd.Series) -> pd.Series:
        return values.map(lambda v: str(int.from_bytes(hashlib.blake2b((v or "").encode(), digest_size=size).digest(), "big")))

    return score(column)


def xxh3(column: Column, bits: int) -> Column:
    """The XXH3 digest in hex, of 64 or 128 bits; another function than Spark's xxhash64. Null counts as empty."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        import xxhash

        of = xxhash.xxh3_64_hexdigest if bits == 64 else xxhash.xxh3_128_hexdigest
        return values.map(lambda v: of((v or "").encode()))

    return digest(column)


def first_response(responses: Column, reference: Column) -> Column:
    """The first filled response of a list (struct with `response`), or else the reference answer."""
    filled = F.filter(F.transform(responses, lambda r: strip(F.coalesce(r["response"], F.lit("")))), lambda x: x != "")
    return F.coalesce(F.get(filled, 0), reference)


_TOKEN = None


def span_mask(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """1 for tokens of `text` that overlap any of the character spans."""
    import regex

    global _TOKEN
    _TOKEN = _TOKEN or regex.compile(TOKEN)
    return [int(any(m.end() > a and m.start() < b for a, b in spans)) for m in _TOKEN.finditer(text)]


def answer_spans(text: str) -> list[tuple[int, int]]:
    """The content of the last box, or what follows an unfinished one."""
    closed = list(re.finditer(r"\\boxed\s*\{\s*([^{}]+?)\s*\}", text))
    if closed:
        return [closed[-1].span(1)]
    at = text.rfind("\\boxed{")
    return [(at + 7, len(text))] if at >= 0 else []


def protocol_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"<\|thought_(?:start|end)\|>", text)]


def token_mask(column: Column, spans) -> Column:
    """span_mask of each text as array<int>."""

    @F.pandas_udf("array<int>")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: span_mask(t or "", spans(t or "")))

    return mask(column)
