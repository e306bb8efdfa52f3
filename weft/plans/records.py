"""Record-level eligibility, lookups, routes and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import chat, degeneration, records
from weft.functions.hashing import hash32
from weft.functions.tokens import token_count
from weft.operators import dedup, packing
from weft.operators.prefix import row_numbers
from weft.plans.clean import _h
from weft.plans.common import on
from weft.plans.scoring import _CANDIDATES, _REWARD, scored

_ID = "doc_id"


def _pick(*values):
    """One of the values by doc_id, in turn."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(_ID) % len(values)).cast("int"))


def _pick_sql(*values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][CAST(doc_id % {len(values)} + 1 AS INTEGER)]"


TYPES = ("Str", "int, optional", "Dict", "list", "weird", "", "FLOAT", None)
QUESTIONS = ("What is it?", "How many cats?", "Is it red?", "how many  dogs", "", "Where")
ANSWERS = ("Yes.", "three", "no", "many", "x", "2 of them", "no!")
VERIFIERS = (("min_words", "300"), ("max_words", "100"), ("contains", "THE"), ("no_comma", "x"), ("lowercase", ""), ("unknown", "1"), ("min_words", "many"))


def _chunks(d):
    c = F.array(F.struct(F.lit("text").alias("type"), F.lit(" see ").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(_pick("text", "audio").alias("type"), F.col("lang").alias("text")))
    return d.select(_ID, records.merge_chunks(c).alias("content"))


def _eligible(most_turns, most_chars):
    def body(t):
        talk = chat.gather(t).select("conv_id", chat.trim_ends(F.filter("msgs", lambda m: m["role"] != "system")).alias("msgs"))
        q = talk.select("conv_id", chat.quality(F.col("msgs")).alias("q"), F.exists("msgs", lambda m: degeneration.has_loop(m["content"])).alias("loop"))
        ok = F.col("q.turns").between(2, most_turns) & ~F.col("q.ocr_doc") & ~F.col("q.bad_generation") & F.col("q.alternating") & (F.col("q.assistant_chars") <= most_chars) & (F.col("q.image_markers") <= 1) & ~F.col("loop")
        return q.filter(ok).select("conv_id")

    return body


def _label_images(d):
    """The image of each label by stem, the first extension in order that exists."""
    stems = d.select(F.concat(F.lit("f"), _ID).alias("stem"))
    exts = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("ext")) for i, e in enumerate(records.IMAGE_EXTENSIONS)])
    files = d.select(F.concat(F.lit("f"), _ID).alias("stem"), F.explode(exts).alias("e"), F.col(_ID)).filter(F.pmod(F.col(_ID) + F.col("e.rank"), F.lit(3)) == 0)
    best = files.groupBy("stem").agg(F.min("e").alias("e"))
    return stems.join(best, "stem", "left").select("stem", F.concat("stem", "e.ext").alias("file"))


def _views(d):
    """The entry of one file in a nested list of views."""
    views = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(F.concat(F.col(_ID).cast("string"), F.lit("-"), i.cast("string"), F.lit(".jpg")).alias("file"), (i * 10).alias("x")))
    want = F.concat(F.col(_ID).cast("string"), F.lit("-"), (F.col(_ID) % 7 + 1).cast("string"), F.lit(".jpg"))
    return d.select(_ID, F.get(F.filter(views, lambda v: v["file"] == want), 0)["x"].alias("x"))


def _missing(d):
    """Names without an entry in the table of known ones."""
    known = d.sparkSession.createDataFrame([(n,) for n, _ in VERIFIERS if n != "unknown"], "name string").distinct()
    return d.select(_pick(*[n for n, _ in VERIFIERS]).alias("name")).join(F.broadcast(known), "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


def _verify(d):
    return d.select(_ID, _pick(*[n for n, _ in VERIFIERS]).alias("name"), records.verify(_pick(*[n for n, _ in VERIFIERS]), F.col("text"), _pick(*[v for _, v in VERIFIERS])).alias("ok"))


def _routes(d):
    """Ten student, three teacher and three general rows for each update, the language split in a cycle of two."""
    updates = row_numbers(d.select(_ID), [_ID], "u")
    chinese = F.when(F.col("u") % 2 == 0, 2).otherwise(1)
    routes = F.flatten(F.array(F.array_repeat(F.lit("student"), 10), F.array_repeat(F.lit("teacher"), 3), F.array_repeat(F.lit("chinese"), chinese), F.array_repeat(F.lit("english"), 3 - chinese)))
    return updates.select("u", F.explode(routes).alias("route")).groupBy("u", "route").agg(F.count("*").alias("n"))


def _buffer(d):
    """The best replay entry of each prompt; of the prompts, the latest 256 stay."""
    good = scored(d).filter(F.col("correct") & (F.col("reward") >= 1.1) & (F.col("cand") <= 2))
    best = dedup.priority_pick(good, "prompt", F.struct("cand", -F.col("reward")))
    return best.orderBy(F.desc("prompt")).limit(256).select("prompt", "cand")


def _provenance(d):
    return packing.block_provenance(d.select(_ID, F.pmod(token_count(F.col("text")), F.lit(64)).alias("n")), _ID, "n", 16)


def _thumb(d):
    x = F.col(_ID) % 448
    p = records.tile_to_thumb(x, F.lit(24), F.lit(0.8), F.lit(100), F.lit(0.5), F.lit(10), 28.0, 16)
    return d.select(_ID, p["cell"].alias("cell"), F.round(p["off"], 9).alias("off"))


def _kwargs(d):
    kwargs = F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.when(F.col(_ID) % 2 == 0, "1"), F.when(F.col(_ID) % 3 == 0, "2"), F.lit("3")))
    return d.select(_ID, F.array_join(F.map_keys(F.map_filter(kwargs, lambda k, v: v.isNotNull())), ",").alias("keys"))




def _answer_mask(spans):
    def body(d):
        t = F.concat("text", F.lit("<|thought_end|> \\boxed{ 12 } tail"))
        mask = records.token_mask(t, spans)
        return d.select(_ID, F.size(mask).cast("long").alias("n"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("marked"))

    return body


QUERIES = {
    "json_schema_type": on("documents", lambda d: d.select(_ID, records.json_schema_type(_pick(*TYPES)).alias("kind"))),
    "merge_chunks": on("documents", _chunks),
    "drop_null_kwargs": on("documents", _kwargs),
    "human_answers": on("documents", lambda d: d.filter((F.col(_ID) % 4 == 0) & F.lower(_pick("human", "Expert", "model")).isin("human", "expert")).select(_ID)),
    "reference_contained": on("documents", lambda d: d.filter(F.contains("text", F.lit("the"))).select(_ID)),
    "source_whitelist": on("documents", lambda d: d.filter(F.lower(F.trim("source")).isin("src1", "src3", "src5")).select(_ID, "source")),
    "chat_eligible": on("conversations", _eligible(5, 2500)),
    "qa_shape": on("documents", lambda d: d.select(_ID, records.answer_fits(_pick(*QUESTIONS), _pick(*ANSWERS)).alias("fits"))),
    "assembly_reason": on("documents", lambda d: d.select(_ID, records.assembly_reason(F.lit(3) + F.col(_ID) % 4, F.concat(F.lit("a"), F.repeat(F.lit("<img>"), (F.col(_ID) % 3).cast("int"))), _pick("train", "eval", "dev", None)).alias("reason"))),
    "valid_choice_index": on("documents", lambda d: d.filter((F.col(_ID) % 6 >= 0) & (F.col(_ID) % 6 < F.size(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))))).select(_ID)),
    "label_image_pick": on("documents", _label_images),
    "view_lookup": on("documents", _views),
    "verifier_missing": on("documents", _missing),
    "verify_constraints": on("documents", _verify),
    "pass_rate_by_constraint": on("documents", lambda d: _verify(d).groupBy("name").agg(F.round(F.avg(F.col("ok").cast("int")), 9).alias("rate"), F.count("*").alias("n"))),
    "block_provenance": on("documents", _provenance),
    "route_mix": on("documents", _routes),
    "replay_buffer": on("documents", _buffer),
    "tile_to_thumb": on("documents", _thumb),
    "train_first_order": on("documents", lambda d: d.select(_ID, F.when(F.pmod(hash32("tf", F.col(_ID)), F.lit(10)) == 0, "eval").otherwise("train").alias("split"), hash32("ord", F.col(_ID)).alias("score")).orderBy(F.col("split") == "eval", "score", _ID)),
    "kept_ratio": on("documents", lambda d: d.agg(F.round(F.count_if(F.length("text") < 3000) / F.greatest(F.lit(1), F.count("*")), 9).alias("ratio"), F.round(F.sum(F.octet_length("text")) / float(1 << 20), 6).alias("mib"))),
    "blake2b_order": on("documents", lambda d: d.select(_ID, records.blake2b_score(F.concat_ws(":", F.lit("7"), _ID)).alias("score"))),
    "xxh3_hash": on("documents", lambda d: d.select(_ID, records.xxh3(F.col("text"), 64).alias("h"))),
    "tool_schema": on("documents", lambda d: d.select(_ID, degeneration.over_texts(F.concat(F.lit('{"name": "f", "required": ["a"], "parameters": {"type": "dict", "properties": {"a": {"type": "'), _pick("str, optional", "List"), F.lit('"}}}}')), records.normalise_tool, "string").alias("tool"))),
    "answer_token_mask": on("documents", _answer_mask(records.answer_spans)),
    "protocol_token_mask": on("documents", _answer_mask(records.protocol_spans)),
}

_NAMES, _VALUES = _pick_sql(*[n for n, _ in VERIFIERS]), _pick_sql(*[v for _, v in VERIFIERS])
_CHECK = f"v AS (SELECT doc_id, text, {_NAMES} AS name, {_VALUES} AS value FROM documents), k AS (SELECT doc_id, name, coalesce(CASE name WHEN 'min_words' THEN len(regexp_extract_all(text, '\\S+')) >= TRY_CAST(value AS INTEGER) WHEN 'max_words' THEN len(regexp_extract_all(text, '\\S+')) <= TRY_CAST(value AS INTEGER) WHEN 'contains' THEN contains(lower(text), lower(value)) WHEN 'no_comma' THEN NOT contains(text, ',') WHEN 'lowercase' THEN lower(text) = text END, false) AS ok FROM v)"
_COUNT = r"len(regexp_extract_all(text, '\p{L}+|\p{N}|[^\s\p{L}\p{N}]')) % 64"

SQL = {
    "json_schema_type": f"SELECT doc_id, CASE lower(trim(string_split(trim(coalesce({_pick_sql(*TYPES)}, '')), ',')[1])) WHEN 'int' THEN 'integer' WHEN 'dict' THEN 'object' WHEN 'list' THEN 'array' WHEN 'float' THEN 'number' ELSE 'string' END AS kind FROM documents",
    "merge_chunks": "SELECT doc_id, trim(' see <img>' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END) AS content FROM documents",
    "drop_null_kwargs": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a,' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'b,' ELSE '' END || 'c' AS keys FROM documents",
    "human_answers": "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 < 2",
    "reference_contained": "SELECT doc_id FROM documents WHERE contains(text, 'the')",
    "source_whitelist": "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')",
    "qa_shape": f"WITH x AS (SELECT doc_id, lower(trim(regexp_replace({_pick_sql(*QUESTIONS)}, '\\s+', ' ', 'g'))) AS q, trim(lower({_pick_sql(*ANSWERS)}), ' .!?') AS a FROM documents) SELECT doc_id, q <> '' AND a <> '' AND NOT (regexp_matches(q, '^(what|which|who|where|when|why|how) ') AND a IN ('yes', 'no')) AND NOT (regexp_matches(q, '^(how many|what number) ') AND NOT regexp_matches(a, '[0-9]') AND a <> 'three') AS fits FROM x",
    "assembly_reason": "SELECT doc_id, CASE WHEN 3 + doc_id % 4 <> 5 THEN 'not_five_views' WHEN doc_id % 3 <> 1 THEN 'bad_image_marker' WHEN doc_id % 4 > 1 THEN 'bad_split' END AS reason FROM documents",
    "valid_choice_index": "SELECT doc_id FROM documents WHERE doc_id % 6 < 4",
    "label_image_pick": "SELECT 'f' || doc_id AS stem, 'f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.jpg' WHEN 2 THEN '.jpeg' ELSE '.png' END AS file FROM documents",
    "view_lookup": "SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN (doc_id % 7 + 1) * 10 END AS x FROM documents",
    "verifier_missing": "SELECT 'unknown' AS name, count(*) AS n FROM documents WHERE doc_id % 7 = 5",
    "verify_constraints": f"WITH {_CHECK} SELECT * FROM k",
    "pass_rate_by_constraint": f"WITH {_CHECK} SELECT name, round(avg(ok::INT), 9) AS rate, count(*) AS n FROM k GROUP BY 1",
    "block_provenance": f"WITH t AS (SELECT doc_id, {_COUNT} AS n FROM documents), s AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS a FROM t), b AS (SELECT unnest(range(0, CAST((SELECT sum(n) FROM t) // 16 AS BIGINT))) AS block) SELECT block, max_by(doc_id, (a, doc_id)) AS source, CAST(block * 16 - max(a) AS BIGINT) AS offset FROM b JOIN s ON a <= block * 16 AND a % 16 = 0 GROUP BY block",
    "route_mix": "WITH u AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS u FROM documents) SELECT u, 'student' AS route, 10 AS n FROM u UNION ALL SELECT u, 'teacher', 3 FROM u UNION ALL SELECT u, 'chinese', 2 - u % 2 FROM u UNION ALL SELECT u, 'english', 1 + u % 2 FROM u",
    "replay_buffer": f"WITH {_CANDIDATES}, {_REWARD}, g AS (SELECT prompt, min(cand) AS cand FROM r WHERE correct AND reward >= 1.1 AND cand <= 2 GROUP BY prompt) SELECT prompt, cand FROM g ORDER BY prompt DESC LIMIT 256",
    "tile_to_thumb": "WITH x AS (SELECT doc_id, (((doc_id % 448) - 24) / 0.8::DOUBLE + 100) * 0.5::DOUBLE + 10 AS p FROM documents), y AS (SELECT doc_id, p / 28.0::DOUBLE AS p, greatest(0, least(15, floor(p / 28.0::DOUBLE))) AS c FROM x) SELECT doc_id, CAST(c AS INTEGER) AS cell, round(greatest(-0.5, least(0.5, p - c - 0.5)), 9) AS off FROM y",
    "train_first_order": f"SELECT doc_id, CASE WHEN {_h('tf', 'doc_id')} % 10 = 0 THEN 'eval' ELSE 'train' END AS split, {_h('ord', 'doc_id')} AS score FROM documents",
    "kept_ratio": "SELECT round(count(*) FILTER (len(text) < 3000) / greatest(1, count(*)), 9) AS ratio, round(sum(octet_length(encode(text))) / 1048576.0::DOUBLE, 6) AS mib FROM documents",
}
