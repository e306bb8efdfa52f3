"""A training corpus in five stages: documents in, token digests of the mixture out.

toxicity: documents that the clause grammar rejects go.
jaccard_join: one document of each group of near copies (0.8 of their five-word shingles) stays, that with the least id.
secret_scan: every span found is replaced by a mark; no document goes.
mix_sources: documents are taken as often as their source's target asks, up to twice.
byte_bpe: what is left is encoded and decoded; doc_id, n_tokens and both digests.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns
their columns, but for the last. Rows without an id or without words pass the
second stage. Rows that share an id are told apart by their texts there: those
with one set of shingles are copies of each other, of which the one with the
least text hash stays; different texts under one id are different documents. An
empty table passes through as an empty one. The stages that run Python bound the
session's Arrow batches (run() sets the bound back); results don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, jaccard_join, mixing, secret_scan, toxicity
from weft.llm.common import discard, materialise, scratch_scope, unused

#: Near copies of the second stage: words of a shingle and percent of shingles shared (op4 alone has its own limits).
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Up to this many ids to drop are broadcast (8 bytes each); beyond it, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Rows go to Python in batches of about so many bytes. Spark's own bound, 64 MB or 10 000 rows, is held by each task in a
#: buffer of the next power of two beside the half that it outgrew, and once more in Python.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's batches by BATCH_BYTES (and the row that crosses them); a smaller bound of its own stays."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return toxicity.with_score(docs, scorer, score).filter(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    groups = jaccard_join.join_sets(docs.select("doc_id", "text"), words=NEAR_WORDS, percent=NEAR_PERCENT).filter("doc_id IS NOT NULL AND node IS NOT NULL")
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("node") == F.col("component_node"))
    lost_id, lost_node, own = (unused(docs, x) for x in ("lost_id", "lost_node", "node"))
    gone = groups.filter(~stays).select(F.col("doc_id").alias(lost_id), F.col("node").alias(lost_node)).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    seed = groups.select("seed").first()
    marked = jaccard_join.with_node(docs, own, NEAR_WORDS, seed["seed"] if seed else 1)
    kept = marked.join(gone, (F.col("doc_id") == F.col(lost_id)) & (F.col(own) == F.col(lost_node)), "left_anti")
    twice = groups.filter(stays).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(lost_id))
    if twice.limit(1).count():
        # Rows of one id with equal sets. Combined before the shuffle, so that an id of very many rows is one row from each task.
        carried = (F.col("doc_id") == F.col(lost_id)) & F.col(own).isNotNull()
        again, alone = kept.join(twice, carried, "left_semi"), kept.join(twice, carried, "left_anti")
        order = F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))
        one = again.groupBy(F.col("doc_id").alias("__id"), F.col(own).alias("__set")).agg(F.min_by(F.struct(*again.columns), order).alias("__row")).select("__row.*")
        kept = one.unionByName(alone)
    return kept.drop(own)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = docs.select(F.struct(*docs.columns).alias("__weft_row"), "text")
    found = secret_scan.scan(row).select("__weft_row", secret_scan.redact(F.col("text"), F.col("spans")).alias("__weft_text"))
    own = {"text": F.col("__weft_text"), "n_chars": F.length("__weft_text").cast("long")}
    return found.select(*[own.get(c, F.col("__weft_row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can express neither the learned score nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables written on the way are deleted as soon as the next stage stands."""
    docs, bound = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(_BATCH)
    try:
        with scratch_scope():
            for i, (name, stage) in enumerate(STAGES):
                before = docs
                with scratch_scope():
                    docs = materialise(stage(spark, before, sf_dir), f"pipeline-{name}", outer=True)
                if i:
                    discard(before)
            return materialise(docs, "pipeline-result", outer=True)
    finally:
        spark.conf.set(_BATCH, bound)
