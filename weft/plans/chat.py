"""Conversation, token and packing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import chat, tokens
from weft.functions.hashing import hash32
from weft.operators import dedup, packing
from weft.plans.clean import _h
from weft.plans.common import on

C = "conversations"
_TOK = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]"


def _n(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_TOK}'))"


_LINE = "'<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)"
_MSGS = f"c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, {_LINE} AS line, {_n(_LINE)} AS k FROM conversations)"
_STRIPPED = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def m(body):
    return on(C, lambda t: body(chat.gather(t)))


def _counts(g):
    kept = chat.trim_ends(F.col("msgs"))
    return g.select("conv_id", kept.alias("msgs")).select("conv_id", F.size("msgs").cast("long").alias("n_turns"), chat.render(F.col("msgs")).alias("txt"))


def _fanout(g):
    widths = g.withColumn("ctx", F.explode(F.array(F.lit(200), F.lit(400), F.lit(800))))
    fitted = widths.select("conv_id", "ctx", chat.fit_prefix(F.col("msgs"), F.col("ctx")).alias("msgs")).filter(F.size("msgs") > 0)
    total = F.aggregate(chat.turn_tokens(F.col("msgs")), F.lit(0).cast("long"), lambda a, x: a + x)
    return fitted.select("conv_id", "ctx", F.size("msgs").cast("long").alias("n_turns"), total.alias("n_tokens"))


def _first_last(g):
    user, answer = chat.first_user_last_assistant(F.col("msgs"))
    return g.select("conv_id", user.alias("first_user"), answer.alias("last_assistant"))


def _prompt_dedup(g):
    keyed = g.select("conv_id", chat.prompt_key(F.col("msgs")).alias("key")).filter("key <> ''")
    return dedup.keep_first(keyed, F.col("key"), ["conv_id"]).select("conv_id")


def _mask(g):
    mask = chat.assistant_mask(F.col("msgs"))
    return g.select("conv_id", mask.alias("x")).select("conv_id", F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("n_target"), F.md5(F.array_join("x", "")).alias("digest"))


def _packed(d):
    return packing.fixed_blocks(d.select("doc_id", tokens.tokens(F.col("text")).alias("ids")), "doc_id", "ids", 512).select("block", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", " ")).alias("digest"), "source", "offset")


_FLAT = f"t AS (SELECT doc_id, regexp_extract_all(text, '{_TOK}') AS w FROM documents), f AS (SELECT doc_id, w, sum(len(w)) OVER (ORDER BY doc_id) - len(w) AS a FROM t), p AS (SELECT doc_id, a, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM f)"


def _windows(d):
    counted = d.select("doc_id", tokens.token_count(F.col("text")).alias("n"))
    return packing.long_windows(counted, "doc_id", "n", 512, 64).select("doc_id", "start")


def _labels(d):
    ids = d.select("doc_id", F.transform(tokens.tokens(F.col("text")), lambda t: F.length(t)).alias("ids"))
    masked = ids.select("doc_id", "ids", F.transform("ids", lambda x, i: (i % 3 != 0).cast("int")).alias("mask"))
    return masked.select("doc_id", F.md5(F.array_join(tokens.next_labels(F.col("ids"), F.col("mask")), ",")).alias("digest"))


def _weights(d):
    w = tokens.token_weights(tokens.tokens(F.col("text")))
    return d.select("doc_id", F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), 6).alias("weight"))


def _subsequence(d):
    toks = d.select("doc_id", tokens.tokens(F.col("text")).alias("w")).select("doc_id", "w", F.slice("w", 5, 3).alias("needle"))
    return toks.select("doc_id", tokens.find_subsequence(F.col("w"), F.col("needle")).cast("long").alias("at"))


def _pad(d):
    """Batches of eight ids, each padded to its longest."""
    rows = d.select("doc_id", F.transform(tokens.tokens(F.col("text")), lambda t: F.length(t)).alias("x"))
    width = F.max(F.size("x")).over(Window.partitionBy(F.floor(F.col("doc_id") / 8)))
    return rows.select("doc_id", tokens.pad_right(F.col("x"), width).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", ",")).alias("digest"))


def _fim(d):
    ids = d.select("doc_id", F.transform(tokens.tokens(F.col("text")), lambda t: F.length(t)).alias("ids"), F.pmod(hash32("fim", F.col("doc_id")), F.lit(10)).cast("int").alias("start"))
    return ids.select("doc_id", F.md5(F.array_join(tokens.fill_in_middle(F.col("ids"), F.col("start"), F.lit(5), -1), ",")).alias("digest"))


def _audit(g):
    """Seven kinds of errors in the turns of a conversation, comma-joined; it sees no packed ids or masks (README, Limits)."""
    x = F.col("msgs")
    checks = [
        F.when(F.size(x) == 0, "empty"),
        F.when(~chat.has_both_roles(x), "missing_role"),
        F.when(~chat.alternates(x), "non_alternating"),
        F.when(F.get(x, 0)["role"] == "system", "system_turn"),
        F.when(F.coalesce(F.get(x, F.size(x) - 1)["role"], F.lit("")) != "assistant", "open_end"),
        F.when(F.exists(x, lambda t: t["content"].contains("<img>")), "image_marker"),
        F.when(F.exists(x, lambda t: t["content"].contains("<|im_")), "control_tag"),
    ]
    return g.select("conv_id", F.array_join(F.array_compact(F.array(*checks)), ",").alias("errors"))


QUERIES = {
    "render_chatml": m(lambda g: g.select("conv_id", chat.render(F.col("msgs")).alias("txt"))),
    "unify_roles": m(lambda g: g.select("conv_id", chat.render(chat.unify(F.col("msgs"))).alias("txt"))),
    "trim_ends": m(_counts),
    "alternation_check": m(lambda g: g.select("conv_id", chat.alternates(F.col("msgs")).alias("alternating"))),
    "both_roles": m(lambda g: g.filter(chat.has_both_roles(F.col("msgs"))).select("conv_id")),
    "turn_cap": m(lambda g: g.filter(~F.exists("msgs", lambda t: (t["role"] == "assistant") & (tokens.token_count(t["content"]) > 60))).select("conv_id")),
    "prefix_fit": m(lambda g: g.select("conv_id", chat.fit_prefix(F.col("msgs"), F.lit(300)).alias("x")).select("conv_id", F.size("x").cast("long").alias("n_turns"), chat.render(F.col("x")).alias("txt"))),
    "fanout_ctx": m(_fanout),
    "turn_counts": m(lambda g: g.select("conv_id", F.array_join(F.transform(F.filter("msgs", lambda t: t["role"] == "assistant"), lambda t: tokens.token_count(t["content"])), ",").alias("counts"))),
    "first_user_last_assistant": m(_first_last),
    "normalize_reason": m(lambda g: g.select("conv_id", chat.normalise(F.col("msgs"), "Please answer.").alias("n")).select("conv_id", "n.reason", chat.render(F.col("n.msgs")).alias("txt"))),
    "replay_strict": m(lambda g: g.select("conv_id", chat.replay_ok(F.col("msgs")).alias("ok"))),
    "history_trim": m(lambda g: g.select("conv_id", chat.trim_history(F.col("msgs"), F.lit(300)).alias("x")).select("conv_id", F.size("x").cast("long").alias("n_turns"), chat.render(F.col("x")).alias("txt"))),
    "prompt_key_dedup": m(_prompt_dedup),
    "chat_quality": m(lambda g: g.select("conv_id", chat.quality(F.col("msgs")).alias("q")).select("conv_id", "q.*")),
    "drop_system": m(lambda g: g.select("conv_id", chat.render(chat.drop_system(F.col("msgs"))).alias("txt"))),
    "image_marker": m(lambda g: g.select("conv_id", chat.render(chat.with_image_marker(F.col("msgs"))).alias("txt"))),
    "turn_explode": on(C, lambda t: t.select("conv_id", "turn", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")).alias("txt"))),
    "thinking_turn": on("benchmark", lambda b: b.select("item_id", chat.thinking_turn(F.col("text"), F.lit("t"), F.lit("a")).alias("txt"))),
    "build_messages": on("benchmark", lambda b: b.select("item_id", chat.render(chat.build_messages(F.col("text"), F.when(F.col("item_id") % 2 == 0, "why"), F.lit("a"), "Think.")).alias("txt"))),
    "qa_messages": on("benchmark", lambda b: b.select("item_id", chat.render(chat.qa_messages(F.transform(F.sequence(F.lit(1), (F.col("item_id") % 6 + 1).cast("int")), lambda i: F.struct(i.cast("string").alias("q"), (i * 2).cast("string").alias("a"))))).alias("txt"))),
    "token_count": on("documents", lambda d: d.select("doc_id", tokens.token_count(F.col("text")).alias("n"))),
    "packed_blocks": on("documents", _packed),
    "long_windows": on("documents", _windows),
    "assistant_mask": m(_mask),
    "label_shift": on("documents", _labels),
    "token_class_weights": on("documents", _weights),
    "subsequence_search": on("documents", _subsequence),
    "pad_right": on("documents", _pad),
    "fill_in_middle": on("documents", _fim),
    "pack_audit": m(_audit),
}

_PREV = "lag(role) OVER (PARTITION BY conv_id ORDER BY turn)"
_ALT = f"a AS (SELECT conv_id, bool_and(p IS NULL OR p <> role) AS alternating, count(*) AS n, min_by(role, turn) AS first_role, max_by(role, turn) AS last_role FROM (SELECT conv_id, turn, role, {_PREV} AS p FROM c) GROUP BY conv_id)"
_ENDS = "e AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS u, max(turn) FILTER (role = 'assistant') AS v FROM c GROUP BY conv_id)"

SQL = {
    "render_chatml": f"WITH {_MSGS} SELECT conv_id, string_agg(line, '' ORDER BY turn) AS txt FROM c GROUP BY conv_id",
    "unify_roles": "WITH s AS (SELECT conv_id, turn, role, " + _STRIPPED.format(x="coalesce(text, '')") + " AS t FROM conversations) SELECT conv_id, coalesce(string_agg('<|im_start|>' || role || chr(10) || t || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (role IN ('user', 'assistant') AND t <> ''), '') AS txt FROM s GROUP BY conv_id",
    "trim_ends": f"WITH {_MSGS}, {_ENDS} SELECT e.conv_id, count(line) AS n_turns, coalesce(string_agg(line, '' ORDER BY turn), '') AS txt FROM e LEFT JOIN c ON e.conv_id = c.conv_id AND u < v AND turn BETWEEN u AND v GROUP BY e.conv_id",
    "alternation_check": f"WITH {_MSGS}, {_ALT} SELECT conv_id, alternating FROM a",
    "both_roles": "SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')",
    "turn_cap": "SELECT conv_id FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'assistant' AND " + _n("coalesce(text, '')") + " > 60)",
    "prefix_fit": f"WITH {_MSGS}, r AS (SELECT conv_id, role, line, row_number() OVER w AS i, sum(k) OVER w AS s FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, coalesce(max(i) FILTER (i <= e), 0) AS n_turns, coalesce(string_agg(line, '' ORDER BY i) FILTER (i <= e), '') AS txt FROM (SELECT *, max(i) FILTER (role = 'assistant' AND s <= 300) OVER (PARTITION BY conv_id) AS e FROM r) GROUP BY conv_id",
    "fanout_ctx": f"WITH {_MSGS}, r AS (SELECT conv_id, role, row_number() OVER w AS i, sum(k) OVER w AS s FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), x AS (SELECT unnest([200, 400, 800]) AS ctx) SELECT conv_id, ctx, max(i) AS n_turns, max(s) AS n_tokens FROM r, x WHERE role = 'assistant' AND s <= ctx GROUP BY conv_id, ctx",
    "turn_counts": "SELECT conv_id, coalesce(string_agg(CAST(" + _n("coalesce(text, '')") + " AS VARCHAR), ',' ORDER BY turn) FILTER (role = 'assistant'), '') AS counts FROM conversations GROUP BY conv_id",
    "first_user_last_assistant": "SELECT conv_id, min_by(text, turn) FILTER (role = 'user' AND " + _STRIPPED.format(x="text") + " <> '') AS first_user, max_by(text, turn) FILTER (role = 'assistant' AND " + _STRIPPED.format(x="text") + " <> '') AS last_assistant FROM conversations GROUP BY conv_id",
    "replay_strict": f"""WITH {_MSGS}, p AS (SELECT * FROM c WHERE role <> 'system'), w AS (SELECT conv_id, bool_or({_STRIPPED.format(x='text')} = '' OR contains(text, chr(65533)) OR contains(text, chr(0)) OR regexp_matches(text, '<.(im|thought)_(start|end).>')) AS bad, min(turn) FILTER (role = 'user') AS u, max(turn) FILTER (role = 'assistant') AS v FROM p GROUP BY conv_id),
e AS (SELECT p.conv_id, p.turn, p.role, lag(p.role) OVER (PARTITION BY p.conv_id ORDER BY p.turn) AS q FROM p JOIN w ON p.conv_id = w.conv_id AND u < v AND p.turn BETWEEN u AND v), s AS (SELECT conv_id, count(*) AS n, bool_and(q IS NULL OR q <> role) AS alt FROM e GROUP BY conv_id)
SELECT i.conv_id, coalesce(NOT bad AND n >= 2 AND n % 2 = 0 AND alt, false) AS ok FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN w ON i.conv_id = w.conv_id LEFT JOIN s ON i.conv_id = s.conv_id""",
    "history_trim": f"WITH {_MSGS}, r AS (SELECT conv_id, role, line, row_number() OVER w AS i, sum(k) OVER w AS s FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, coalesce(max(i) FILTER (i <= e), 0) AS n_turns, coalesce(string_agg(line, '' ORDER BY i DESC) FILTER (i <= e), '') AS txt FROM (SELECT *, max(i) FILTER (role = 'user' AND s <= 300) OVER (PARTITION BY conv_id) AS e FROM r) GROUP BY conv_id",
    "prompt_key_dedup": "WITH k AS (SELECT conv_id, lower(" + _STRIPPED.format(x="regexp_replace(string_agg(coalesce(text, ''), chr(10) ORDER BY turn), '[\\s\\p{Z}]+', ' ', 'g')") + ") AS k FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT min(conv_id) AS conv_id FROM k WHERE k <> '' GROUP BY k",
    "chat_quality": f"WITH {_MSGS}, {_ALT} SELECT a.conv_id, count(*) FILTER (role = 'assistant') AS turns, coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) + greatest(count(*) FILTER (role = 'assistant') - 1, 0) AS assistant_chars, any_value(alternating) AS alternating, sum(len(regexp_extract_all(text, '<image>|<img>'))) AS image_markers, coalesce(bool_or(regexp_matches(text, '{chat.SPECULATIVE}')) FILTER (role = 'assistant'), false) AS speculative, coalesce(bool_or(regexp_matches(text, '{chat.OCR}')) FILTER (role = 'assistant'), false) AS ocr_doc, coalesce(bool_or(regexp_matches(text, '{chat.BAD_GENERATION}')) FILTER (role = 'assistant'), false) AS bad_generation FROM a JOIN c ON a.conv_id = c.conv_id GROUP BY a.conv_id",
    "drop_system": f"WITH {_MSGS} SELECT conv_id, coalesce(string_agg(line, '' ORDER BY turn) FILTER (role <> 'system'), '') AS txt FROM c GROUP BY conv_id",
    "image_marker": "WITH x AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<img>', '') AS t, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS u FROM conversations) SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN turn = u THEN '<img>' || chr(10) ELSE '' END || t || '<|im_end|>' || chr(10), '' ORDER BY turn) AS txt FROM x GROUP BY conv_id",
    "turn_explode": f"WITH {_MSGS} SELECT conv_id, turn, line AS txt FROM c",
    "thinking_turn": "SELECT item_id, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<|thought_start|>' || chr(10) || 't' || chr(10) || '<|thought_end|>' || chr(10) || 'a<|im_end|>' || chr(10) AS txt FROM benchmark",
    "build_messages": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '<|im_start|>system' || chr(10) || 'Think.<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || CASE WHEN item_id % 2 = 0 THEN '<|thought_start|>' || chr(10) || 'why' || chr(10) || '<|thought_end|>' || chr(10) ELSE '' END || 'a<|im_end|>' || chr(10) AS txt FROM benchmark",
    "qa_messages": "SELECT item_id, array_to_string(list_transform(range(1, CAST(least(item_id % 6 + 1, 4) + 1 AS BIGINT)), lambda i: '<|im_start|>user' || chr(10) || CAST(i AS VARCHAR) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || CAST(i * 2 AS VARCHAR) || '<|im_end|>' || chr(10)), '') AS txt FROM benchmark",
    "token_count": "SELECT doc_id, " + _n("text") + " AS n FROM documents",
    "packed_blocks": f"WITH {_FLAT}, z AS (SELECT sum(len(w)) // 512 AS n FROM t) SELECT CAST((a + i) // 512 AS BIGINT) AS block, count(*) AS n, md5(string_agg(x, ' ' ORDER BY a + i)) AS digest, min_by(doc_id, a + i) AS source, min_by(i, a + i) AS offset FROM p, z WHERE (a + i) // 512 < z.n GROUP BY 1",
    "long_windows": f"WITH n AS (SELECT doc_id, {_n('text')} AS n FROM documents), m AS (SELECT doc_id, n, n - 512 AS top FROM n WHERE n >= 512), s AS (SELECT doc_id, k, top, n, CASE WHEN n < 576 THEN {_h('win', 'doc_id')} % (least(64, top) + 1) ELSE greatest(0, least(top, (top * k) // 2 + CAST(concat('0x', substr(md5(concat('win', k, ':', doc_id)), 1, 8)) AS BIGINT) % (2 * (least(64, top) // 2) + 1) - least(64, top) // 2)) END AS start FROM m, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 576 OR k = 0) SELECT DISTINCT doc_id, CAST(start AS BIGINT) AS start FROM s",
    "assistant_mask": f"WITH {_MSGS} SELECT conv_id, CAST(sum(k) AS BIGINT) AS n, CAST(coalesce(sum({_n('text')} + 7) FILTER (role = 'assistant'), 0) AS BIGINT) AS n_target, md5(string_agg(repeat('0', CAST(k - {_n('text')} - 7 AS BIGINT)) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, CAST({_n('text')} + 7 AS BIGINT)), '' ORDER BY turn)) AS digest FROM c GROUP BY conv_id",
    "label_shift": f"WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_TOK}'), lambda x: len(x)) AS w FROM documents) SELECT doc_id, md5(coalesce(string_agg(CASE WHEN i < n AND i % 3 <> 0 THEN x ELSE -100 END, ',' ORDER BY i), '')) AS digest FROM (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(list_concat(w[2:], [0])) AS x, len(w) AS n FROM t WHERE len(w) > 0) GROUP BY doc_id UNION ALL SELECT doc_id, md5('') FROM t WHERE len(w) = 0",
    "token_class_weights": f"SELECT doc_id, round(coalesce(list_sum(list_transform(regexp_extract_all(text, '{_TOK}'), lambda t: CASE WHEN regexp_matches(t, '^\\p{{Nd}}$') THEN 1.2::DOUBLE WHEN regexp_matches(t, '^[+\\-*/=^%＋－×÷＝％]$') THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END)), 0), 6) AS weight FROM documents",
    "subsequence_search": f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_TOK}') AS w FROM documents), p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x, unnest(list_concat(w[2:], [NULL])) AS y, unnest(list_concat(w[3:], [NULL, NULL])[:len(w)]) AS z, w[5] AS a, w[6] AS b, w[7] AS c FROM t WHERE len(w) >= 5) SELECT t.doc_id, coalesce(min(i) FILTER (x = a AND (b IS NULL OR y = b) AND (c IS NULL OR z = c)) - 1, -1) AS at FROM t LEFT JOIN p ON t.doc_id = p.doc_id GROUP BY t.doc_id",
    "pad_right": f"WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_TOK}'), lambda x: len(x)) AS w FROM documents), m AS (SELECT *, max(len(w)) OVER (PARTITION BY doc_id // 8) AS n FROM t) SELECT doc_id, n, md5(array_to_string(list_concat(w, list_transform(range(0, n - len(w)), lambda i: 0)), ',')) AS digest FROM m",
    "fill_in_middle": f"WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_TOK}'), lambda x: len(x)) AS w, CAST({_h('fim', 'doc_id')} % 10 AS INTEGER) AS s FROM documents) SELECT doc_id, md5(array_to_string(list_concat(list_concat(w[1:s], [-1]), list_concat(w[s + 6:], list_concat([-1], w[s + 1:s + 5]))), ',')) AS digest FROM t",
    "pack_audit": f"""WITH {_MSGS}, {_ALT}, b AS (SELECT conv_id, bool_or(role = 'user') AND bool_or(role = 'assistant') AS two, bool_or(contains(text, '<img>')) AS img, bool_or(contains(text, '<|im_')) AS tag FROM c GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter([CASE WHEN NOT two THEN 'missing_role' END, CASE WHEN NOT alternating THEN 'non_alternating' END, CASE WHEN first_role = 'system' THEN 'system_turn' END, CASE WHEN last_role <> 'assistant' THEN 'open_end' END, CASE WHEN img THEN 'image_marker' END, CASE WHEN tag THEN 'control_tag' END], lambda x: x IS NOT NULL), ',') AS errors FROM a JOIN b USING (conv_id)""",
}
