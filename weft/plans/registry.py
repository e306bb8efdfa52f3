"""Query registry of the engine's general operators."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import lang, text
from weft.operators import budget, dedup
from weft.plans.clean import CLEAN_SQL, LIGHT_SQL
from weft.plans.common import Query, read

#: Where DuckDB's own result types differ from the query's: sums of whole numbers, literals, ranks.
CASTS = {
    "BIGINT": {
        "leak_report": ("ids",), "leak_clean": ("ids",), "budget_stop_after": ("cum_bytes",), "budget_break_before": ("cum_bytes",), "phase_fill": ("cum_bytes",), "fanout_ctx": ("n_tokens",),
        "subsequence_search": ("at",), "candidates": ("cand",), "extract_number": ("cand",), "gsm_reward": ("cand",), "group_advantage": ("cand",), "signal_gate": ("cand",), "temp_downweight": ("cand",),
        "replay_best": ("cand",), "replay_buffer": ("cand",), "first_valid_attempt": ("accepted",), "source_bytes": ("n_bytes",), "token_totals": ("total",), "cycle_repeat": ("round",), "token_budget_batches": ("batch",),
    },
    "INTEGER": {
        "topk_per_lang": ("rank",), "chat_quality": ("turns", "assistant_chars", "image_markers"), "window_frames": ("rn", "rk", "dr"), "date_parts": ("y", "m"), "distinct_prompt_topk": ("rank",), "top_per_group": ("r",), "vector_topk": ("rank",), "view_lookup": ("x",),
    },
    "DOUBLE": {"quality_tag": ("unik",), "temp_downweight": ("weight",)},
}

MODULES = ("clean", "select", "chat", "scoring", "report", "relational", "records", "packs", "gates", "files")


def _modules():
    return [importlib.import_module(f"weft.plans.{m}") for m in MODULES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus build: clean, filter, first of each signature, no benchmark prompts, byte budget."""
    docs, bench = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    clean = docs.select("doc_id", "lang", text.clean_text(F.col("text")).alias("text"))
    fit = clean.filter(F.length("text").between(1, 8000)).withColumn("is_foreign", lang.has_foreign_script(F.col("text")))
    first = dedup.keep_first(fit, text.signature(F.col("text")), ["doc_id"])
    safe = dedup.leaked(first, text.canonical_prompt(F.col("text")), bench, text.canonical_prompt(bench["text"]), "left_anti")
    kept = budget.stop_after(safe, ["doc_id"], F.octet_length("text").cast("long"), 2_000_000, cut_from=docs)
    return kept.select("doc_id", "lang", "is_foreign", F.md5("text").alias("unique_key"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("cum_bytes").cast("long").alias("cum_bytes"))


FLAGSHIP_SQL = rf"""
WITH c AS (SELECT doc_id, lang, {CLEAN_SQL} AS text FROM documents),
f AS (SELECT * FROM c WHERE len(text) BETWEEN 1 AND 8000),
k AS (SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, {LIGHT_SQL} AS s FROM f) GROUP BY s),
p AS (SELECT f.* FROM f JOIN k USING (doc_id) WHERE lower(regexp_replace(text, '[\s\p{{Z}}]+', ' ', 'g')) NOT IN (SELECT lower(regexp_replace(trim(text), '[\s\p{{Z}}]+', ' ', 'g')) FROM benchmark)),
r AS (SELECT *, octet_length(encode(text)) AS n_bytes, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS cum FROM p)
SELECT doc_id, lang, regexp_matches(text, '{lang.FOREIGN}') AS is_foreign, md5(text) AS unique_key, n_bytes, CAST(cum AS BIGINT) AS cum_bytes FROM r WHERE cum - n_bytes < 2000000
"""


def queries() -> dict[str, Query]:
    return {"flagship": flagship} | {k: q for m in _modules() for k, q in m.QUERIES.items()}


def _cast(name: str, sql: str) -> str:
    parts = [f'CAST("{c}" AS {kind}) AS "{c}"' for kind, of in CASTS.items() for c in of.get(name, ())]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})" if parts else sql


def oracle_sql() -> dict[str, str]:
    return {"flagship": FLAGSHIP_SQL} | {k: _cast(k, q) for m in _modules() for k, q in m.SQL.items()}
