"""Profiles, degeneration, mixing, batching and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import degeneration as deg
from weft.functions import geometry as geo
from weft.functions import lang, text
from weft.functions.tokens import token_count, tokens
from weft.operators import mixing, profile
from weft.plans.clean import _REASONS_SQL, CLEAN_SQL, reasons
from weft.plans.common import on

_TOKENS = r"len(regexp_extract_all(text, '\p{L}+|\p{N}|[^\s\p{L}\p{N}]'))"


def _funnel(d):
    clean = text.clean_text(F.col("text"))
    checks = [("empty", clean == ""), ("foreign", lang.has_foreign_script(F.col("text"))), ("too_long", F.length(clean) > 3000), ("too_short", F.length(clean) < 200)]
    return profile.funnel(d, checks, ["source"])


def _mixture(d):
    out = profile.mixture(d.withColumn("k", token_count(F.col("text"))), ["lang"], "k")
    return out.select("lang", "n", F.col("weight").cast("long").alias("weight"), F.round("share", 9).alias("share"))


def _weighted(d, l):
    x = d.join(l, "doc_id").select("lang", "quality", F.length("text").alias("w"))
    return x.groupBy("lang").agg(F.round(F.sum(F.col("quality") * F.col("w")) / F.sum("w"), 9).alias("weighted"), F.round(F.avg("quality"), 9).alias("plain"))


def _hit_rates(d, l):
    g = d.join(l, "doc_id").groupBy("source").agg(F.sum("quality").alias("hit"), F.count("*").alias("tot"))
    return g.agg(F.round(F.sum("hit") / F.sum("tot"), 9).alias("micro"), F.round(F.avg(F.col("hit") / F.col("tot")), 9).alias("macro"))


def _ok_bad(d, l):
    return d.join(l, "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("ok"), F.count_if(F.col("quality") == 0).alias("bad"), F.round(F.count_if(F.col("quality") == 0) / F.greatest(F.lit(1), F.count("*")), 9).alias("bad_ratio"))


def _ema(d):
    """Exponential mean of lengths over all documents of each source, in order."""
    return profile.ema(d.select("source", "doc_id", F.length("text").alias("n")), "source", "doc_id", F.col("n"), 0.9).select("source", F.round("ema", 6).alias("ema"))


def _ratio_mix(d):
    vision = d.filter("lang = 'en'").agg(F.count("*").alias("n"))
    n = vision.select("n", mixing.mix_size(F.col("n"), 0.2).alias("n_text"))
    return n.select("n", "n_text", F.bround(F.col("n_text") * 2 / 3.0, 0).cast("long").alias("n_zh"))


def _interleave(d):
    a, b = d.filter("lang = 'en'").select("doc_id"), d.filter("lang = 'de'").select("doc_id")
    return mixing.interleave([(a, 5), (b, 1)], "doc_id").select("doc_id", "slot")


def _batches(d):
    x = d.select("doc_id", F.floor(F.col("doc_id") / 256).alias("shard"), token_count(F.col("text")).alias("n"))
    out = mixing.token_budget_batches(x, "shard", ["n", "doc_id"], "n", 8192)
    return out.groupBy("shard", "batch").agg(F.count("*").alias("rows"), F.max("n").alias("longest"))


def _tiles(d):
    w, h = geo.work_size(F.pmod(F.col("doc_id") * 37, F.lit(1500)) + 20, F.pmod(F.col("doc_id") * 53, F.lit(1100)) + 20)
    sized = d.select("doc_id", w.cast("long").alias("w"), h.cast("long").alias("h"))
    return sized.select("doc_id", F.inline(geo.tile_boxes(F.col("w"), F.col("h"))))


def _letterbox(d):
    return d.select("doc_id", F.inline(F.array(geo.letterbox(F.pmod(F.col("doc_id") * 37, F.lit(1500)) + 20, F.pmod(F.col("doc_id") * 53, F.lit(1100)) + 20))))


def _size(expr_w: str = "(doc_id * 37) % 1500 + 20", expr_h: str = "(doc_id * 53) % 1100 + 20") -> str:
    return f"s AS (SELECT doc_id, {expr_w} AS w, {expr_h} AS h FROM documents)"


QUERIES = {
    "source_bytes": on("documents", lambda d: d.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("n_bytes"))),
    "drop_funnel": on("documents", _funnel),
    "reason_counts": on("documents", lambda d: profile.reason_counts(d, reasons(F.col("text")))),
    "composite_counts": on("documents", lambda d: d.groupBy(F.concat_ws(":", "source", "lang").alias("key")).agg(F.count("*").alias("n"))),
    "nearest_rank_percentiles": on("documents", lambda d: profile.nearest_rank(d.withColumn("n", F.length("text").cast("long")), ["lang"], "n", (0.5, 0.75, 0.9, 0.95)).withColumn("mean", F.round("mean", 6))),
    "median_length": on("documents", lambda d: d.groupBy("lang").agg(F.median(F.length("text")).cast("long").alias("median"))),
    "mixture_ratio": on("documents", _mixture),
    "domain_histogram": on("pages", lambda p: p.groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))),
    "token_totals": on("documents", lambda d: d.agg(F.sum(token_count(F.col("text"))).alias("total"), F.max(token_count(F.col("text"))).alias("longest"), F.min(token_count(F.col("text"))).alias("shortest"), F.count("*").alias("n"))),
    "ok_bad_ratio": on("documents", "labels", _ok_bad),
    "weighted_mean": on("documents", "labels", _weighted),
    "hit_rates": on("documents", "labels", _hit_rates),
    "islands": on("documents", lambda d: profile.islands(d, "doc_id", "lang")),
    "ema": on("documents", _ema),
    "loop_backref": on("documents", lambda d: d.select("doc_id", deg.exact_loop(F.col("text")).alias("loop"))),
    "spaced_repeat": on("documents", lambda d: d.select("doc_id", deg.repeated(F.col("text")).alias("loop"))),
    "dup_lines": on("documents", lambda d: d.select("doc_id", deg.duplicate_lines(F.col("text")).alias("dup"))),
    "sentence_repeat": on("documents", lambda d: d.select("doc_id", deg.sentence_repeat(F.col("text")).alias("rep"))),
    "loop_flag": on("documents", lambda d: d.select("doc_id", deg.has_loop(F.col("text")).alias("loop"))),
    "low_info_tail": on("documents", lambda d: d.select("doc_id", deg.low_information_tail(F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("12.-%"), F.lit(20))).otherwise(""))).alias("t")).select("doc_id", "t.found", "t.keep")),
    "prose_loop": on("documents", lambda d: d.select("doc_id", deg.over_texts(F.col("text"), deg.prose_loop, "long").alias("keep"))),
    "stutter": on("documents", lambda d: d.select("doc_id", deg.over_texts(F.col("text"), deg.stutter, "long").alias("keep"))),
    "near_clauses": on("documents", lambda d: d.select("doc_id", deg.over_texts(F.col("text"), deg.near_duplicate_clauses, "boolean").alias("near"))),
    "token_cycle": on("documents", lambda d: d.select("doc_id", deg.cycle_period(tokens(F.col("text"))).alias("period"))),
    "ratio_mix": on("documents", _ratio_mix),
    "cycle_repeat": on("documents", lambda d: mixing.cycle_to(d.filter("lang = 'de'").select("doc_id"), ["doc_id"], 300, 3).select("doc_id", "round")),
    "cadence_interleave": on("documents", _interleave),
    "token_budget_batches": on("documents", _batches),
    "tile_boxes": on("documents", _tiles),
    "letterbox": on("documents", _letterbox),
    "patch_coverage": on("documents", lambda d: d.select("doc_id", geo.patch_coverage(F.lit(0), (F.col("doc_id") % 200), F.lit(448), 448 - (F.col("doc_id") % 200)).alias("share"))),
    "view_cache_key": on("documents", lambda d: d.select("doc_id", F.md5(F.concat_ws("||", "source", F.col("doc_id").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit("-1.jpg"))).cast("binary")).alias("key"))),
}

_STRIP = r"regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_WORK = """v AS (SELECT doc_id, CASE WHEN least(w, h) < 448 THEN greatest(2, CAST(round_even(w * (528.0::DOUBLE / least(w, h)), 0) AS BIGINT)) ELSE w END AS w, CASE WHEN least(w, h) < 448 THEN greatest(2, CAST(round_even(h * (528.0::DOUBLE / least(w, h)), 0) AS BIGINT)) ELSE h END AS h FROM s),
o AS (SELECT *, w // 2 AS mx, h // 2 AS my, greatest(0, least(CAST(round_even(CASE WHEN least(w, h) < 800 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END * least(w, h), 0) AS BIGINT), least(w // 2, h // 2) - 1)) AS ov FROM v)"""

SQL = {
    "source_bytes": "SELECT source, count(*) AS n, sum(octet_length(encode(text))) AS n_bytes FROM documents GROUP BY source",
    "drop_funnel": f"SELECT source, CASE WHEN {CLEAN_SQL} = '' THEN 'empty' WHEN regexp_matches(text, '{lang.FOREIGN}') THEN 'foreign' WHEN len({CLEAN_SQL}) > 3000 THEN 'too_long' WHEN len({CLEAN_SQL}) < 200 THEN 'too_short' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2",
    "reason_counts": f"SELECT reason, count(*) AS n FROM (SELECT unnest({_REASONS_SQL}) AS reason FROM documents) GROUP BY 1",
    "composite_counts": "SELECT source || ':' || lang AS key, count(*) AS n FROM documents GROUP BY 1",
    "nearest_rank_percentiles": "WITH g AS (SELECT lang, list_sort(list(len(text))) AS x, count(*) AS n FROM documents GROUP BY lang) SELECT lang, round(list_avg(x), 6) AS mean, " + ", ".join(f"x[CAST(least(floor(n * {p}) + 1, n) AS BIGINT)] AS p{int(p * 100)}" for p in (0.5, 0.75, 0.9, 0.95)) + ", x[n] AS max FROM g",
    "median_length": "SELECT lang, CAST(trunc(median(len(text))) AS BIGINT) AS median FROM documents GROUP BY lang",
    "mixture_ratio": f"WITH g AS (SELECT lang, count(*) AS n, sum({_TOKENS}) AS weight FROM documents GROUP BY lang) SELECT lang, n, CAST(weight AS BIGINT) AS weight, round(weight / sum(weight) OVER (), 9) AS share FROM g",
    "domain_histogram": r"SELECT regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1",
    "token_totals": f"SELECT sum({_TOKENS}) AS total, max({_TOKENS}) AS longest, min({_TOKENS}) AS shortest, count(*) AS n FROM documents",
    "ok_bad_ratio": "SELECT lang, count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality = 0) AS bad, round(count(*) FILTER (quality = 0) / greatest(1, count(*)), 9) AS bad_ratio FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "weighted_mean": "SELECT lang, round(sum(quality * len(text)) / sum(len(text)), 9) AS weighted, round(avg(quality), 9) AS plain FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "hit_rates": "WITH g AS (SELECT source, sum(quality) AS hit, count(*) AS tot FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT round(sum(hit) / sum(tot), 9) AS micro, round(avg(hit / tot), 9) AS macro FROM g",
    "islands": "WITH x AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS run FROM documents) SELECT lang, min(doc_id) AS first, count(*) AS n FROM x GROUP BY lang, run",
    "ema": "WITH x AS (SELECT source, doc_id, len(text)::DOUBLE AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), m AS (SELECT source, max(r) AS k FROM x GROUP BY source) SELECT source, round(sum(x * CASE WHEN r = 1 THEN pow(0.9, k - 1) ELSE 0.1 * pow(0.9, k - r) END), 6) AS ema FROM x JOIN m USING (source) GROUP BY source",
    "dup_lines": f"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP}), lambda x: len(x) >= 12) AS l FROM documents) SELECT doc_id, len(l) <> len(list_distinct(l)) AS dup FROM l",
    "sentence_repeat": f"WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[。！？!?；;\\n]+'), lambda x: {_STRIP}), lambda x: len(x) >= 6)) AS u FROM documents), c AS (SELECT doc_id, u, count(*) AS n FROM l GROUP BY 1, 2) SELECT d.doc_id, coalesce(max(n) >= 3, false) AS rep FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id",
    "low_info_tail": r"""WITH x AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN repeat('12.-%', 20) ELSE '' END AS t FROM documents),
y AS (SELECT doc_id, t, regexp_extract(right(t, 640), '([0-9０-９\s.,，。:;!?！？%％()\[\]{}+\-*/_=…·"“”''<>]{64,})$', 1) AS n FROM x),
z AS (SELECT *, regexp_replace(n, '\s+', '', 'g') AS c, left(t, len(t) - len(n)) AS k FROM y),
f AS (SELECT *, len(c) > 0 AND len(regexp_replace(c, '\p{Nd}', '', 'g')) >= 0.30 * len(c) AND len(list_distinct(string_split(c, ''))) <= 24 AS found, len(regexp_extract(right(k, 56), '(?s)^(.*[。！？!?\n])', 1)) AS m FROM z)
SELECT doc_id, found, CASE WHEN found THEN len(k) - CASE WHEN m > 0 THEN least(56, len(k)) - m ELSE 0 END END AS keep FROM f""",
    "loop_flag": f"WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[。！？!?；;\\n]+'), lambda x: {_STRIP}), lambda x: len(x) >= 6)) AS u FROM documents), c AS (SELECT doc_id FROM (SELECT doc_id, u, count(*) AS n FROM l GROUP BY 1, 2) WHERE n >= 3), w AS (SELECT doc_id, i, ch FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents)), e AS (SELECT doc_id, i, ch = lead(ch, 12) OVER (PARTITION BY doc_id ORDER BY i) AS same FROM w), r AS (SELECT doc_id, sum((same IS NOT TRUE)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run, same FROM e), s AS (SELECT doc_id FROM r WHERE same GROUP BY doc_id, run HAVING count(*) >= 24) SELECT doc_id, doc_id IN (SELECT doc_id FROM c) OR doc_id IN (SELECT doc_id FROM s) AS loop FROM documents",
    "ratio_mix": "WITH x AS (SELECT count(*) AS n FROM documents WHERE lang = 'en'), y AS (SELECT n, CAST(round_even(n * 0.2 / 0.8, 0) AS BIGINT) AS n_text FROM x) SELECT n, n_text, CAST(round_even(n_text * 2 / 3.0::DOUBLE, 0) AS BIGINT) AS n_zh FROM y",
    "cycle_repeat": "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents WHERE lang = 'de') SELECT doc_id, r AS round FROM x, (SELECT unnest([0, 1, 2]) AS r) WHERE r * n + i < 300",
    "cadence_interleave": "WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents WHERE lang IN ('en', 'de')) SELECT doc_id, CASE WHEN lang = 'en' THEN i // 5 * 6 + i % 5 ELSE i * 6 + 5 END AS slot FROM x",
    "token_budget_batches": f"""WITH RECURSIVE x AS (SELECT doc_id // 256 AS shard, {_TOKENS} AS n, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY {_TOKENS}, doc_id) AS r FROM documents),
f AS (SELECT shard, r, n, 0 AS batch, 1 AS k, n AS longest FROM x WHERE r = 1
UNION ALL SELECT x.shard, x.r, x.n, CASE WHEN (f.k + 1) * greatest(f.longest, x.n) > 8192 THEN f.batch + 1 ELSE f.batch END, CASE WHEN (f.k + 1) * greatest(f.longest, x.n) > 8192 THEN 1 ELSE f.k + 1 END,
  CASE WHEN (f.k + 1) * greatest(f.longest, x.n) > 8192 THEN x.n ELSE greatest(f.longest, x.n) END FROM f JOIN x ON x.shard = f.shard AND x.r = f.r + 1)
SELECT shard, batch, count(*) AS rows, max(n) AS longest FROM f GROUP BY 1, 2""",
    "tile_boxes": f"WITH {_size()}, {_WORK} SELECT doc_id, 0 AS x0, 0 AS y0, mx + ov AS x1, my + ov AS y1 FROM o UNION ALL SELECT doc_id, mx - ov, 0, w, my + ov FROM o UNION ALL SELECT doc_id, 0, my - ov, mx + ov, h FROM o UNION ALL SELECT doc_id, mx - ov, my - ov, w, h FROM o UNION ALL SELECT doc_id, 0, 0, w, h FROM o",
    "letterbox": f"WITH {_size()}, v AS (SELECT doc_id, greatest(1, CAST(round_even(w * least(448.0::DOUBLE / w, 448.0::DOUBLE / h), 0) AS BIGINT)) AS new_w, greatest(1, CAST(round_even(h * least(448.0::DOUBLE / w, 448.0::DOUBLE / h), 0) AS BIGINT)) AS new_h FROM s) SELECT doc_id, new_w, new_h, (448 - new_w) // 2 AS off_x, (448 - new_h) // 2 AS off_y FROM v",
    "patch_coverage": "WITH g AS (SELECT unnest(range(0, 16)) AS i), b AS (SELECT doc_id, doc_id % 200 AS y0, 448 - doc_id % 200 AS y1 FROM documents) SELECT doc_id, 16 * count(*) FILTER (greatest(0, least(y1, (i + 1) * 28) - greatest(y0, i * 28)) * 28 * 2 >= 784) / 256.0::DOUBLE AS share FROM b, g GROUP BY doc_id",
    "view_cache_key": "SELECT doc_id, md5(source || '||' || doc_id || '||' || doc_id || '-1.jpg') AS key FROM documents",
}
