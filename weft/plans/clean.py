"""Cleaning and filtering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import lang, text
from weft.functions.hashing import uniform
from weft.plans.common import on

# Keyword classes of the curated replay pool.
MATH = r"(?i)(?:\\boxed|\b(?:solve|calculate|equation|algebra|geometry|derivative|integral|proof)\b|(?:求解|计算|方程|几何|导数|积分|证明|概率|因式分解)|\d\s*[+*/=]\s*\d)"
CURRENT = r"(?i)\b(?:latest|currently|today|this year|real-time|current price|recent games?|as of 20(?:2[4-9]|3\d))\b"
NOISE = r"(?i)\b(?:follow my|like and subscribe|discount code|buy now|giveaway|as an ai|language model|cannot answer)\b"
HIGH_RISK = r"(?i)\b(?:diagnos|treat(?:ment)?|medication|disease|symptom|doctor|hospital|legal advice|lawsuit|contract dispute|stock|fund|securities|investment advice|loan|insurance|election|president|government policy|military|war)\w*\b"
SPECULATIVE = r"可能|也许|似乎|或许|大概|推测|看起来像"

D = "documents"
STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}\x1C-\x1F\x{{85}}]+|[\s\p{{Z}}\x1C-\x1F\x{{85}}]+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


CLEAN_SQL = _strip(r"replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{200B}-\x{200F}\x{FEFF}]', '', 'g'), '[\x{1F300}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]', '', 'g'), chr(0), '')")
LIGHT_SQL = _strip(rf"regexp_replace(regexp_replace({CLEAN_SQL}, '[ \t\r\f\x0B]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g')")
_LINES = "string_split(regexp_replace({x}, '\\r\\n|[\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10))"
_MARKUP = "replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{0}', ' ', 'g'), '{1}', ' ', 'g'), '{2}', ' ', 'g'), '{3}', ' ', 'g'), chr(0), ' ')".format(text.CHAT_TAG, text.IMAGE_TAG, text.HTML_TAG, text.PSEUDO_TAG)


def _sanitize_sql(x: str) -> str:
    for pattern, by in text.SANITIZE:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')" if "\n" not in by else f"regexp_replace({x}, '{pattern}', {'||'.join(['chr(10)'] * len(by))}, 'g')"
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+', '')"


def _h(seed, key: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat('{seed}:', {key})), 1, 8)) AS BIGINT)"


FLAGS = {"math_like": MATH, "high_risk": HIGH_RISK, "time_sensitive": CURRENT, "ad_or_boilerplate": NOISE}


def reasons(x):
    """All reasons that hold, as an array; a row is accepted when it is empty."""
    checks = [F.when(~x.rlike(r"\S"), "empty"), F.when(x.contains("�") | x.contains("\0"), "encoding_noise"), F.when(lang.cjk_ratio(x) > 0.10, "not_english_dominant")]
    checks += [F.when(x.rlike(p), name) for name, p in FLAGS.items()]
    checks.append(F.when(x.contains("```") | F.lower(x).contains("<html") | x.contains("http://") | x.contains("https://"), "code_or_link"))
    return F.array_compact(F.array(*checks))


_REASONS_SQL = "list_filter([CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty' END, CASE WHEN contains(text, chr(65533)) OR contains(text, chr(0)) THEN 'encoding_noise' END, CASE WHEN len(regexp_extract_all(text, '[\\x{3400}-\\x{9FFF}]')) / greatest(len(regexp_extract_all(text, '[A-Za-z\\x{3400}-\\x{9FFF}]')), 1) > 0.10 THEN 'not_english_dominant' END, " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in FLAGS.items()) + ", CASE WHEN contains(text, '```') OR contains(lower(text), '<html') OR contains(text, 'http://') OR contains(text, 'https://') THEN 'code_or_link' END], lambda x: x IS NOT NULL)"
_LINE_COUNT = "len(text) - len(replace(text, chr(10), '')) + 1"
def _t():
    return F.col("text")



def _tristate(n, u, soft: int, hard: int, keep: float):
    return F.when(n > hard, "drop_long").when((n > soft) & (u >= keep), "drop_sampled").when(n > soft, "keep_sampled").otherwise("keep")


QUERIES = {
    "clean_text": on(D, lambda d: d.select("doc_id", text.clean_text(_t()).alias("txt"))),
    "normalize_sig": on(D, lambda d: d.select("doc_id", text.signature(_t()).alias("sig"))),
    "collapse_newlines": on(D, lambda d: d.select("doc_id", text.clean_chat_text(_t()).alias("txt"))),
    "normalize_breaks": on(D, lambda d: d.select("doc_id", text.normalize_breaks(_t()).alias("txt"))),
    "canonical_prompt": on("benchmark", lambda d: d.select("item_id", text.canonical_prompt(_t()).alias("prompt"))),
    "byte_length": on(D, lambda d: d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_points"))),
    "strip_markup": on("pages", lambda d: d.select("page_id", text.strip_markup(F.col("html")).alias("txt"))),
    "sanitize_generated": on("pages", lambda d: d.select("page_id", text.sanitize_generated(F.col("html"), F.lit("chat")).alias("txt"))),
    "image_token": on(D, lambda d: d.select("doc_id", text.normalize_image_token(F.concat(F.lit("<image> [img] "), "text")).alias("txt"))),
    "url_source_label": on("pages", lambda d: d.select("page_id", text.url_source("web", F.col("url")).alias("src"))),
    "field_fallback": on(D, lambda d: d.select("doc_id", text.first_filled(F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 1, F.col("lang")), F.col("source")).alias("picked"))),
    "tagged_section": on(D, lambda d: d.select("doc_id", text.tagged_section(F.concat(F.lit("<SUMMARY> "), "text", F.lit(" </SUMMARY> rest")), "SUMMARY").alias("section"))),
    "chat_block_extract": on(D, lambda d: d.select("doc_id", F.array_join(text.chat_blocks(F.concat(F.lit("<|im_start|>user\n"), "text", F.lit("<|im_end|><|im_start|>  <|im_end|>"))), "#").alias("blocks"))),
    "path_parts": on("pages", lambda d: d.select("page_id", text.basename(F.col("url")).alias("base"), text.extension(F.col("url")).alias("ext"))),
    "decode_data_url": on(D, lambda d: d.select("doc_id", F.octet_length(text.decode_data_url(F.concat(F.lit("data:text/plain;base64,"), F.base64(F.col("text").cast("binary"))))).cast("long").alias("n_bytes"))),
    "char_range": on(D, lambda d: d.filter(F.length("text").between(1, 8000)).select("doc_id", F.length("text").cast("long").alias("n"))),
    "two_phase_min_length": on(D, lambda d: d.filter(F.length("text") >= 3000).filter(F.length(text.clean_text(_t())) >= 3000).select("doc_id")),
    "line_quality": on(D, lambda d: d.filter((F.octet_length("text") <= 120000) & (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).between(2, 400)).select("doc_id")),
    "lang_whitelist": on(D, lambda d: d.filter(F.lower(F.trim("lang")).isin("en", "de")).select("doc_id", "lang")),
    "lang_others": on(D, lambda d: d.filter((F.trim("lang") != "") & ~F.lower(F.trim("lang")).isin("en", "de")).select("doc_id", "lang")),
    "english_prefix_score": on(D, lambda d: d.filter(lang.english_score_ok(F.col("lang"), (F.col("doc_id") % 100) / 100.0)).select("doc_id")),
    "exact_score": on(D, lambda d: d.filter(F.abs((F.col("doc_id") % 10) / 9.0 - 1) <= 1e-9).select("doc_id")),
    "lenient_int": on(D, lambda d: d.select("doc_id", lang.lenient_int(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("1,"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))).when(F.col("doc_id") % 4 == 1, "x1").when(F.col("doc_id") % 4 == 2, F.concat((F.col("doc_id") % 50).cast("string"), F.lit(".7"))).otherwise(" 12 ")).alias("n"))),
    "foreign_script": on(D, lambda d: d.select("doc_id", lang.has_foreign_script(_t()).alias("is_foreign"))),
    "allowlist_script": on(D, lambda d: d.select("doc_id", lang.outside_allowed(_t()).alias("is_foreign"))),
    "category_script": on(D, lambda d: d.select("doc_id", lang.has_foreign_letter(_t()).alias("is_foreign"))),
    "cjk_ratio": on(D, lambda d: d.select("doc_id", lang.cjk_ratio(F.concat(F.col("text"), F.lit("汉字"))).alias("ratio"))),
    "keyword_flags": on(D, lambda d: d.select("doc_id", *[_t().rlike(p).alias(n) for n, p in FLAGS.items()], _t().rlike(SPECULATIVE).alias("speculative"))),
    "length_tristate": on(D, lambda d: d.select("doc_id", _tristate(F.length("text"), uniform("tri", F.col("doc_id")), 2000, 4000, 0.02).alias("decision"))),
    "length_strata": on(D, lambda d: d.filter((F.length("text") < 600) | ((F.length("text") < 2048) & (uniform("strata", F.col("doc_id")) < 0.05))).select("doc_id")),
    "reason_array": on(D, lambda d: d.select("doc_id", reasons(_t()).alias("r")).select("doc_id", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("accepted"))),
    "random_separator_join": on(D, lambda d: d.select("doc_id", F.concat(F.col("source"), F.when(uniform("sep", F.col("doc_id")) < 0.5, "\n").otherwise(" "), F.col("lang")).alias("txt"))),
    "quality_tag": on(D, lambda d: d.select("doc_id", F.when(F.length("text") > 4000, 3.0).when(F.length("text") > 1000, 2.0).otherwise(1.0).alias("unik"), (F.length("text") > 4000).alias("strict"))),
}

SQL = {
    "clean_text": f"SELECT doc_id, {CLEAN_SQL} AS txt FROM documents",
    "normalize_sig": f"SELECT doc_id, md5({LIGHT_SQL}) AS sig FROM documents",
    "collapse_newlines": "SELECT doc_id, regexp_replace(" + _strip(r"replace(regexp_replace(coalesce(text, ''), '[\x{200B}-\x{200F}\x{FEFF}]', '', 'g'), chr(0), '')") + r", '\n{3,}', chr(10) || chr(10), 'g') AS txt FROM documents",
    "normalize_breaks": "SELECT doc_id, " + _strip(r"regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g')") + " AS txt FROM documents",
    "canonical_prompt": "SELECT item_id, lower(regexp_replace(" + _strip("coalesce(text, '')") + r", '[\s\p{Z}]+', ' ', 'g')) AS prompt FROM benchmark",
    "byte_length": "SELECT doc_id, octet_length(encode(text)) AS n_bytes, len(text) AS n_points FROM documents",
    "strip_markup": "SELECT page_id, array_to_string(list_filter(list_transform(" + _LINES.format(x=_MARKUP) + ", lambda x: " + _strip(r"regexp_replace(x, '[\s\p{Z}\x1F]+', ' ', 'g')") + "), lambda x: x <> ''), chr(10)) AS txt FROM pages",
    "sanitize_generated": f"SELECT page_id, {_sanitize_sql('html')} AS txt FROM pages",
    "image_token": "SELECT doc_id, regexp_replace('<image> [img] ' || text, '" + text.IMAGE_TAG + "', '<img>', 'g') AS txt FROM documents",
    "url_source_label": r"SELECT page_id, 'web|' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS src FROM pages",
    "field_fallback": "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN lang ELSE source END AS picked FROM documents",
    "tagged_section": "SELECT doc_id, " + _strip("text") + " AS section FROM documents",
    "chat_block_extract": "SELECT doc_id, " + CLEAN_SQL.replace("coalesce(text, '')", "'user' || chr(10) || text") + " AS blocks FROM documents",
    "path_parts": r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS base, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages",
    "decode_data_url": "SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents",
    "char_range": "SELECT doc_id, len(text) AS n FROM documents WHERE len(text) BETWEEN 1 AND 8000",
    "two_phase_min_length": f"SELECT doc_id FROM documents WHERE len({CLEAN_SQL}) >= 3000",
    "line_quality": f"SELECT doc_id FROM documents WHERE octet_length(encode(text)) <= 120000 AND {_LINE_COUNT} BETWEEN 2 AND 400",
    "lang_whitelist": "SELECT doc_id, lang FROM documents WHERE lower(trim(lang)) IN ('en', 'de')",
    "lang_others": "SELECT doc_id, lang FROM documents WHERE trim(lang) <> '' AND lower(trim(lang)) NOT IN ('en', 'de')",
    "english_prefix_score": "SELECT doc_id FROM documents WHERE lower(lang) LIKE 'en%' AND (doc_id % 100) / 100.0 >= 0.5",
    "exact_score": "SELECT doc_id FROM documents WHERE doc_id % 10 = 9",
    "lenient_int": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1000 + doc_id % 1000 WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 2 THEN doc_id % 50 ELSE 12 END AS n FROM documents",
    "foreign_script": f"SELECT doc_id, regexp_matches(text, '{lang.FOREIGN}') AS is_foreign FROM documents",
    "allowlist_script": f"SELECT doc_id, regexp_matches(text, '{lang.NOT_ALLOWED}') OR regexp_matches(text, '[{lang.BANNED}]') AS is_foreign FROM documents",
    "category_script": "SELECT doc_id, regexp_matches(regexp_replace(text, '[A-Za-z\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{370}-\\x{3FF}\\x{2100}-\\x{214F}\\x{1D400}-\\x{1D7FF}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}\\x{B5}]', '', 'g'), '\\p{L}') AS is_foreign FROM documents",
    "cjk_ratio": "SELECT doc_id, (len(regexp_extract_all(text, '[\\x{3400}-\\x{9FFF}]')) + 2) / (len(regexp_extract_all(text, '[A-Za-z\\x{3400}-\\x{9FFF}]')) + 2) AS ratio FROM documents",
    "keyword_flags": "SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in FLAGS.items()) + f", regexp_matches(text, '{SPECULATIVE}') AS speculative FROM documents",
    "length_tristate": f"SELECT doc_id, CASE WHEN len(text) > 4000 THEN 'drop_long' WHEN len(text) > 2000 AND {_h('tri', 'doc_id')} / 4294967296.0 >= 0.02 THEN 'drop_sampled' WHEN len(text) > 2000 THEN 'keep_sampled' ELSE 'keep' END AS decision FROM documents",
    "length_strata": f"SELECT doc_id FROM documents WHERE len(text) < 600 OR (len(text) < 2048 AND {_h('strata', 'doc_id')} / 4294967296.0 < 0.05)",
    "reason_array": f"SELECT doc_id, array_to_string({_REASONS_SQL}, ',') AS reasons, len({_REASONS_SQL}) = 0 AS accepted FROM documents",
    "random_separator_join": f"SELECT doc_id, source || CASE WHEN {_h('sep', 'doc_id')} / 4294967296.0 < 0.5 THEN chr(10) ELSE ' ' END || lang AS txt FROM documents",
    "quality_tag": "SELECT doc_id, CASE WHEN len(text) > 4000 THEN 3.0 WHEN len(text) > 1000 THEN 2.0 ELSE 1.0 END AS unik, len(text) > 4000 AS strict FROM documents",
}
