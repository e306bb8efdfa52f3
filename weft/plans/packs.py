"""Packed token streams: spans, masks, audits and gates of training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import chat, records, stream
from weft.functions.hashing import hash32
from weft.operators.sampling import top_k_per_group
from weft.plans.clean import _h
from weft.plans.common import on

C, D = "conversations", "documents"


def packed(t):
    """conv_id, text: rendered chats, some of them damaged by their id: an end mark lost, text in front, a tag, a mark."""
    g = chat.gather(t).select("conv_id", chat.render(chat.with_image_marker(F.col("msgs"))).alias("x"))
    k = F.col("conv_id") % 11
    cut = F.substring("x", F.lit(1), F.length("x") - 11)
    return g.select(
        "conv_id",
        F.when(k == 1, cut).when(k == 2, F.concat(F.lit("stray "), "x")).when(k == 3, F.concat("x", F.lit("<|tool|>"))).when(k == 4, F.replace("x", F.lit("<img>"), F.lit("<image>")))
        .when(k == 5, F.replace("x", F.lit("<|im_start|>assistant\n"), F.lit("<|im_start|>assistant "))).when(k == 6, F.concat("x", F.lit("�"))).otherwise(F.col("x")).alias("text"),
    )


def _audit(t):
    p = packed(t).withColumn("toks", stream.stream(F.col("text")))
    mask = F.when(F.col("conv_id") % 11 == 7, F.transform("toks", lambda x: F.lit(1))).when(F.col("conv_id") % 11 == 8, F.slice(stream.target_mask(F.col("toks")), 2, 1 << 30)).otherwise(stream.target_mask(F.col("toks")))
    views = F.transform(F.sequence(F.lit(1), F.when(F.col("conv_id") % 13 == 1, 4).otherwise(5)), lambda i: F.concat(F.col("conv_id").cast("string"), F.lit("-"), i.cast("string"), F.lit(".jpg")))
    meta = F.when(F.col("conv_id") % 13 == 2, "{broken").when(F.col("conv_id") % 13 == 3, '{"views": [1]}').otherwise('{"views": [1, 2, 3, 4, 5]}')
    rows = p.select("conv_id", "text", "toks", mask.alias("mask"), views.alias("images"), meta.alias("meta"))
    # Files that are there: a listing joined to the exploded names.
    files = t.select("conv_id").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.col("conv_id").cast("string"), F.lit("-"), i.cast("string"), F.lit(".jpg")))).alias("file")).filter(F.pmod(hash32("file", F.col("file")), F.lit(50)) != 0)
    lost = rows.select("conv_id", F.explode("images").alias("file")).join(files, "file", "left_anti").groupBy("conv_id").agg(F.count("*").alias("missing"))
    return rows.join(lost, "conv_id", "left").select("conv_id", F.array_join(stream.audit(F.col("text"), F.col("toks"), F.col("mask"), F.col("images"), F.col("missing"), F.col("meta")), ",").alias("errors"))


def _spans(t):
    s = packed(t).select("conv_id", F.posexplode(stream.role_spans(stream.stream(F.col("text")))).alias("place", "s"))
    return s.select("conv_id", "place", "s.*")


def _mask(t):
    return packed(t).select("conv_id", stream.target_mask(stream.stream(F.col("text"))).alias("m")).select("conv_id", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0), lambda a, x: a + x).cast("long").alias("n_target"), F.array_join("m", "").alias("mask"))


def _strict(t):
    toks = packed(t).select("conv_id", stream.stream(F.col("text")).alias("toks")).withColumn("reason", stream.strict_reason(F.col("toks"), 1500, 4))
    return toks.select("conv_id", "reason", F.when(F.col("reason").isNull(), F.md5(F.array_join(stream.target_mask(F.col("toks")), ""))).alias("digest"))


def _known(d):
    """Streams with an unknown token or beyond the length limit become empty."""
    toks = d.select("doc_id", stream.stream(F.col("text"), eos=True).alias("toks"))
    bad = (F.size("toks") > 2048) | F.exists("toks", lambda x: x.isin("�", "$"))
    return toks.select("doc_id", bad.alias("rejected"), F.when(bad, 0).otherwise(F.size("toks")).cast("long").alias("n"))


def _pack_filter(t):
    rows = packed(t).select("conv_id", stream.stream(F.col("text")).alias("toks"))
    ok = rows.select("conv_id", F.size("toks").cast("long").alias("input_len"), F.exists(stream.target_mask(F.col("toks")), lambda v: v == 1).alias("ok"))
    return ok.filter(F.col("ok") & (F.col("input_len") <= 600)).select("conv_id", "input_len")


def _missing_files(d):
    """Names of a table without a file in the listing, with how many rows name them."""
    named = d.select(F.concat(F.lit("v"), F.col("doc_id") % 300, F.lit(".jpg")).alias("file"))
    listing = d.select(F.concat(F.lit("v"), F.col("doc_id"), F.lit(".jpg")).alias("file")).filter(F.col("file").rlike("[0-8][.]jpg$"))
    return named.groupBy("file").agg(F.count("*").alias("n")).join(listing.distinct(), "file", "left_anti")


def _positions(e):
    """The 16 greatest values of each vector with their places, the earlier place first among equals."""
    ranked = F.slice(F.array_sort(F.transform("embedding", lambda v, i: F.struct((-v.cast("double")).alias("n"), i.alias("i")))), 1, 16)
    return e.select("vec_id", F.array_join(F.transform(ranked, lambda x: x["i"].cast("string")), ",").alias("places"))


def _views_ok(t):
    """Rows of a validating scan: index at hand, five views, known extensions, meta that parses."""
    rows = t.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat(F.col("conv_id").cast("string"), F.lit("-"), i.cast("string"), F.when(F.col("conv_id") % 4 == 0, ".gif").otherwise(".JPG"))).alias("image_file"), F.when(F.col("conv_id") % 3 == 0, "{}").otherwise('{"views": []}').alias("vision_meta"))
    return rows.filter(records.valid_views(F.col("conv_id"), F.col("image_file"), F.col("vision_meta"), 5)).select("conv_id")


def _prompt_topk(t):
    """The ten prompts of least hash in each parity of ids, each prompt once."""
    keys = chat.gather(t).select("conv_id", (F.col("conv_id") % 2).alias("part"), chat.prompt_key(F.col("msgs")).alias("key")).filter("key <> ''").groupBy("part", "key").agg(F.min("conv_id").alias("conv_id"))
    return top_k_per_group(keys.select("part", "conv_id", F.md5("key").alias("k")), "part", "k", "prompts", 10).select("part", "conv_id", "rank")


QUERIES = {
    "stream_tokens": on(D, lambda d: d.select("doc_id", stream.stream(F.col("text"), eos=True).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))),
    "stream_role_spans": on(C, _spans),
    "stream_target_mask": on(C, _mask),
    "strict_target_mask": on(C, _strict),
    "packed_row_audit": on(C, _audit),
    "unknown_token_reject": on(D, _known),
    "pack_filter": on(C, _pack_filter),
    "missing_files": on(D, _missing_files),
    "topk_positions": on("embeddings", _positions),
    "validating_scan": on(C, _views_ok),
    "distinct_prompt_topk": on(C, _prompt_topk),
}

_TOK = r"<\|[^<>\r\n|]+\|>|<img>|\n|\p{L}+|\p{N}|[^\s\p{L}\p{N}]"
SQL = {
    "stream_tokens": f"WITH t AS (SELECT doc_id, list_append(regexp_extract_all(text, '{_TOK}'), '<|endoftext|>') AS t FROM documents) SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM t",
    "unknown_token_reject": f"WITH t AS (SELECT doc_id, list_append(regexp_extract_all(text, '{_TOK}'), '<|endoftext|>') AS t FROM documents) SELECT doc_id, len(t) > 2048 OR list_has_any(t, [chr(65533), '$']) AS rejected, CASE WHEN len(t) > 2048 OR list_has_any(t, [chr(65533), '$']) THEN 0 ELSE len(t) END AS n FROM t",
    "missing_files": "WITH n AS (SELECT 'v' || doc_id % 300 || '.jpg' AS file, count(*) AS n FROM documents GROUP BY 1) SELECT file, n FROM n WHERE file NOT IN (SELECT 'v' || doc_id || '.jpg' FROM documents WHERE doc_id % 10 < 9)",
    "topk_positions": "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM x) SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY r) AS places FROM r WHERE r <= 16 GROUP BY vec_id",
    "validating_scan": "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) = 5 AND conv_id % 4 <> 0",
    "distinct_prompt_topk": "WITH k AS (SELECT conv_id, lower(regexp_replace(regexp_replace(string_agg(coalesce(text, ''), chr(10) ORDER BY turn), '[\\s\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')) AS k FROM conversations WHERE role = 'user' GROUP BY conv_id), u AS (SELECT conv_id % 2 AS part, min(conv_id) AS conv_id, k FROM k WHERE k <> '' GROUP BY conv_id % 2, k), r AS (SELECT part, conv_id, row_number() OVER (PARTITION BY part ORDER BY " + _h("prompts", "md5(k)") + ", md5(k)) AS rank FROM u) SELECT * FROM r WHERE rank <= 10",
}
