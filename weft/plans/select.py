"""Deduplication, joins, budgets and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text
from weft.functions.hashing import hash32, mod_sample, uniform
from weft.operators import budget, dedup, prefix, sampling
from weft.plans.clean import CLEAN_SQL, LIGHT_SQL, _h
from weft.plans.common import on

def _t():
    return F.col("text")

def _bytes():
    return F.octet_length("text").cast("long")

_B = "octet_length(encode(text))"
_RUN = f"sum({_B}) OVER (ORDER BY doc_id)"


def _history(d, b):
    """Documents whose signature stands neither in the first tenth of the ids nor earlier."""
    sig = text.signature(_t())
    seen = d.filter("doc_id % 10 = 0").select(sig.alias("sig"))
    return dedup.keep_first(dedup.without_history(d.filter("doc_id % 10 <> 0"), sig, seen, "sig"), sig, ["doc_id"]).select("doc_id")


def _leak(keep):
    def body(d, b):
        both = b.select(F.col("item_id").alias("doc_id"), "text").unionByName(d.select("doc_id", "text"))
        key = text.canonical_prompt(_t())
        return dedup.leaked(both, key, b, text.canonical_prompt(F.col("text")), keep).groupBy().agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))

    return body


_LEAK_SQL = """WITH x AS (SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents),
k AS (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS k FROM x),
b AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS k FROM benchmark)
SELECT count(*) AS n, sum(doc_id) AS ids FROM k WHERE k {}IN (SELECT k FROM b)"""


def _delta(d, l):
    base = d.join(l, "doc_id").groupBy("lang").agg(F.avg("quality").alias("base"))
    cand = d.join(l, "doc_id").filter("toxic = 0").groupBy("lang").agg(F.avg("quality").alias("cand"))
    return base.join(cand, "lang").select("lang", "base", "cand", (F.col("cand") - F.col("base")).alias("delta"))


def _phase_fill(d):
    phased = d.withColumn("phase", F.when(F.col("lang") == "en", 0).otherwise(1)).withColumn("pos", F.col("phase") * F.lit(1 << 40) + F.col("doc_id"))
    return budget.stop_after(phased, ["pos"], _bytes(), 1_500_000).select("doc_id", "phase", F.col("cum_bytes").cast("long").alias("cum_bytes"))


def _stride(d):
    return prefix.row_numbers(d.select("doc_id"), ["doc_id"], "n").filter("n % 7 = 0").orderBy("doc_id").limit(50).select("doc_id", F.col("n").cast("long").alias("n"))


def _eval_clamp(d):
    n = d.agg(F.count("*").alias("rows")).select("rows", sampling.eval_size(F.col("rows"), 0.02, 16, 400).alias("n_eval"))
    ranked = prefix.row_numbers(d.withColumn("score", hash32("eval", F.col("doc_id"))).select("score", "doc_id"), ["score", "doc_id"], "n")
    return ranked.join(F.broadcast(n), F.col("n") < F.col("n_eval")).select("doc_id", "n_eval")


def _quota(d):
    return sampling.quota(d.filter("lang <> 'en'").select("doc_id"), "doc_id", "quota", 40, "other languages").select("doc_id", "score")


def _resume(d):
    return d.join(d.filter("doc_id % 3 = 0").select("doc_id"), "doc_id", "left_anti").select("doc_id")


def _ids(d, l):
    return l.join(d, "doc_id").select("doc_id", "quality", F.length("text").cast("long").alias("n"))


def _left(d, l):
    return d.join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


def _hash_join(d):
    """Blocks of one table find their entry by content hash in another; a miss has none."""
    cache = d.filter("doc_id % 2 = 0").select(F.md5("text").alias("h"), F.col("doc_id").alias("hit")).groupBy("h").agg(F.min("hit").alias("hit"))
    return d.select("doc_id", F.md5("text").alias("h")).join(cache, "h", "left").select("doc_id", "hit", F.col("hit").isNotNull().alias("found"))


def _shards(d):
    """The first shard that holds a key wins."""
    entries = d.select(F.md5("text").alias("h"), (F.col("doc_id") % 4).alias("shard"), "doc_id")
    return dedup.priority_pick(entries, "h", F.struct("shard", "doc_id")).select("h", "shard", "doc_id")



QUERIES = {
    "dedup_first": on("documents", lambda d: dedup.keep_first(d.select("doc_id", text.signature(_t()).alias("sig")), F.col("sig"), ["doc_id"]).select("doc_id")),
    "dedup_exact_hash": on("documents", lambda d: dedup.keep_first(d.select("doc_id", F.md5(text.clean_text(_t()).cast("binary")).alias("sig")), F.col("sig"), ["doc_id"]).select("doc_id")),
    "dedup_history": on("documents", "benchmark", _history),
    "leak_report": on("documents", "benchmark", _leak("left_semi")),
    "leak_clean": on("documents", "benchmark", _leak("left_anti")),
    "leak_word_runs": on("documents", "benchmark", lambda d, b: dedup.contains_any(d.select("doc_id", "text"), F.col("text"), b, "text", 13).select("doc_id").distinct()),
    "resume_anti": on("documents", _resume),
    "id_lookup": on("documents", "labels", _ids),
    "left_lookup": on("documents", "labels", _left),
    "content_hash_join": on("documents", _hash_join),
    "shard_precedence": on("documents", _shards),
    "baseline_delta": on("documents", "labels", _delta),
    "score_filter": on("documents", "labels", lambda d, l: d.join(l.filter("quality >= 1"), "doc_id").select("doc_id", "quality")),
    "budget_stop_after": on("documents", lambda d: budget.stop_after(d, ["doc_id"], _bytes(), 1_000_000).select("doc_id", F.col("cum_bytes").cast("long").alias("cum_bytes"))),
    "budget_resume": on("documents", lambda d: budget.stop_after(d, ["doc_id"], _bytes(), 1_000_000, already=400_000).select("doc_id")),
    "budget_break_before": on("documents", lambda d: budget.break_before(d, ["doc_id"], _bytes(), 1_000_000).select("doc_id", F.col("cum_bytes").cast("long").alias("cum_bytes"))),
    "budget_skip_fit": on("documents", lambda d: budget.skip_what_does_not_fit(d, ["doc_id"], _bytes(), 300_000).select("doc_id")),
    "phase_fill": on("documents", _phase_fill),
    "row_ids": on("documents", lambda d: prefix.row_numbers(d.select("doc_id"), ["doc_id"], "n").select("doc_id", F.col("n").cast("long").alias("n"))),
    "hash_mod_sample": on("documents", lambda d: d.filter(mod_sample("mod", F.col("doc_id"), 0.25)).select("doc_id")),
    "topk_hash": on("documents", lambda d: sampling.top_k_by_hash(d, "doc_id", "top", 25).select("doc_id", "score")),
    "topk_per_lang": on("documents", lambda d: sampling.top_k_per_group(d, "lang", "doc_id", "topl", 10).select("doc_id", "lang", "rank")),
    "stratified_dev": on("documents", lambda d: sampling.stratified_dev(d.select("doc_id", "source"), "source", "doc_id", "dev", 20).select("doc_id", "source", "split")),
    "eval_clamp": on("documents", _eval_clamp),
    "eval_split_mod": on("documents", lambda d: d.select("doc_id", F.when(F.pmod(hash32("es", F.col("doc_id")), F.lit(100)) < 5, "eval").otherwise("train").alias("split"))),
    "parity_partition": on("documents", lambda d: d.select("doc_id", sampling.hash_parity("par", F.col("source")).alias("side"))),
    "pick_by_hash": on("documents", lambda d: d.select("doc_id", sampling.pick_one(F.split("text", "\n"), "pick", F.col("doc_id")).alias("line"))),
    "stride_preview": on("documents", _stride),
    "reservoir_equiv": on("documents", lambda d: sampling.reservoir(d.select("doc_id"), ["doc_id"], "res", 64).select("slot", "doc_id")),
    "bucket_shuffle": on("documents", lambda d: sampling.shuffle_in_buckets(d.select("doc_id"), "doc_id", "shuf", 16)),
    "quota_fill": on("documents", _quota),
    "fraction_split": on("documents", lambda d: d.select("doc_id", F.when(uniform("frac", F.col("doc_id")) < 0.01, "test").otherwise("train").alias("split"))),
}

SQL = {
    "dedup_first": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {LIGHT_SQL}",
    "dedup_exact_hash": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {CLEAN_SQL}",
    "dedup_history": f"WITH s AS (SELECT doc_id, {LIGHT_SQL} AS k FROM documents) SELECT min(doc_id) AS doc_id FROM s WHERE doc_id % 10 <> 0 AND k NOT IN (SELECT k FROM s WHERE doc_id % 10 = 0) GROUP BY k",
    "leak_report": _LEAK_SQL.format("").replace("{{", "{").replace("}}", "}"),
    "leak_clean": _LEAK_SQL.format("NOT ").replace("{{", "{").replace("}}", "}"),
    "leak_word_runs": r"""WITH d AS (SELECT doc_id, regexp_split_to_array(text, '[\s]+') AS w FROM documents), b AS (SELECT regexp_split_to_array(text, '[\s]+') AS w FROM benchmark),
x AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
y AS (SELECT DISTINCT array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 11)) AS i FROM b))
SELECT DISTINCT doc_id FROM x WHERE g IN (SELECT g FROM y)""",
    "resume_anti": "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0",
    "id_lookup": "SELECT doc_id, quality, len(text) AS n FROM labels JOIN documents USING (doc_id)",
    "left_lookup": "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "content_hash_join": "SELECT doc_id, hit, hit IS NOT NULL AS found FROM (SELECT doc_id, min(CASE WHEN doc_id % 2 = 0 THEN doc_id END) OVER (PARTITION BY text) AS hit FROM documents)",
    "shard_precedence": "SELECT h, shard, doc_id FROM (SELECT md5(text) AS h, doc_id % 4 AS shard, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id % 4, doc_id) AS r FROM documents) WHERE r = 1",
    "baseline_delta": "SELECT lang, avg(quality) AS base, avg(quality) FILTER (toxic = 0) AS cand, avg(quality) FILTER (toxic = 0) - avg(quality) AS delta FROM documents JOIN labels USING (doc_id) GROUP BY lang HAVING count(*) FILTER (toxic = 0) > 0",
    "score_filter": "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality >= 1",
    "budget_stop_after": f"SELECT doc_id, c AS cum_bytes FROM (SELECT doc_id, {_RUN} AS c, {_B} AS b FROM documents) WHERE c - b < 1000000",
    "budget_resume": f"SELECT doc_id FROM (SELECT doc_id, {_RUN} AS c, {_B} AS b FROM documents) WHERE c - b + 400000 < 1000000",
    "budget_break_before": f"SELECT doc_id, c AS cum_bytes FROM (SELECT doc_id, {_RUN} AS c FROM documents) WHERE c <= 1000000",
    "budget_skip_fit": f"""WITH RECURSIVE o AS (SELECT doc_id, {_B} AS b, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
f AS (SELECT n, doc_id, CASE WHEN b <= 300000 THEN b ELSE 0 END AS total, b <= 300000 AS kept FROM o WHERE n = 1
UNION ALL SELECT o.n, o.doc_id, f.total + CASE WHEN f.total + o.b <= 300000 THEN o.b ELSE 0 END, f.total + o.b <= 300000 FROM f JOIN o ON o.n = f.n + 1)
SELECT doc_id FROM f WHERE kept""",
    "phase_fill": f"SELECT doc_id, phase, c AS cum_bytes FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS phase, sum({_B}) OVER (ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) AS c, {_B} AS b FROM documents) WHERE c - b < 1500000",
    "row_ids": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents",
    "hash_mod_sample": f"SELECT doc_id FROM documents WHERE {_h('mod', 'doc_id')} % 1000 < 250",
    "topk_hash": f"SELECT doc_id, {_h('top', 'doc_id')} AS score FROM documents ORDER BY 2, 1 LIMIT 25",
    "topk_per_lang": f"SELECT doc_id, lang, r AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_h('topl', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 10",
    "stratified_dev": f"SELECT doc_id, source, CASE WHEN r <= 20 AND n > 20 THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY {_h('dev', 'doc_id')}, doc_id) AS r FROM documents)",
    "eval_clamp": f"WITH n AS (SELECT CAST(greatest(0, least(greatest(16, floor(count(*) * 0.02)), 400, count(*) - 1)) AS BIGINT) AS n_eval FROM documents) SELECT doc_id, n_eval FROM (SELECT doc_id, row_number() OVER (ORDER BY {_h('eval', 'doc_id')}, doc_id) AS r FROM documents), n WHERE r <= n_eval",
    "eval_split_mod": f"SELECT doc_id, CASE WHEN {_h('es', 'doc_id')} % 100 < 5 THEN 'eval' ELSE 'train' END AS split FROM documents",
    "parity_partition": f"SELECT doc_id, {_h('par', 'source')} % 2 AS side FROM documents",
    "pick_by_hash": f"SELECT doc_id, string_split(text, chr(10))[CAST({_h('pick', 'doc_id')} % len(string_split(text, chr(10))) + 1 AS INTEGER)] AS line FROM documents",
    "stride_preview": "SELECT doc_id, n FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 7 = 0 ORDER BY doc_id LIMIT 50",
    "reservoir_equiv": f"WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), s AS (SELECT doc_id, i, CASE WHEN i < 64 THEN i ELSE {_h('res', 'doc_id')} % (i + 1) END AS slot FROM x) SELECT slot, max_by(doc_id, i) AS doc_id FROM s WHERE slot < 64 GROUP BY slot",
    "bucket_shuffle": "SELECT doc_id FROM documents",
    "quota_fill": f"SELECT doc_id, {_h('quota', 'doc_id')} AS score FROM documents WHERE lang <> 'en' ORDER BY 2, 1 LIMIT 40",
    "fraction_split": f"SELECT doc_id, CASE WHEN {_h('frac', 'doc_id')} / 4294967296.0 < 0.01 THEN 'test' ELSE 'train' END AS split FROM documents",
}
