"""Mixing sources to target weights by weighted reservoir keys, in native expressions only.

Every document gets an exponential key -ln(u) / weight (the smaller, the
earlier). A source first takes all its documents once for each whole epoch in
its target; the fraction that remains is filled in key order until the prefix
sum of words comes nearest to it. The boundary is found by radix selection over
integer keys, so no source is ever sorted as a whole and a hot one costs no more
than its share of a scan.

Defined cases: null, empty and blank texts have size 0; they count as selected
by their key but take no words. Null sources form the last source. Repeated rows
share a key and are told apart by nothing but their order, which does not change
the result as a bag. Two runs agree, since keys come from id and text. An empty
table gives an empty result. Sources without words have target 0.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import materialise, word_array

SHARE_PERCENT = 150
MAX_EPOCHS = 2
WEIGHTS = (3, 1, 2)
SEED = "mix-1"
#: Keys are fixed-point: 2**KEY_BITS steps per unit.
KEY_BITS = 40
#: Boundary intervals up to this many rows in each source are sorted; larger ones are split again.
SORT_ROWS = 256
#: Up to this many sources the per-source table is broadcast; beyond it, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
RADIX = 4096


def quality_weight(size: Column, chars: Column) -> Column:
    """A document's default weight, from 0.5 to 1: longer texts of ordinary word length weigh more."""
    mean = chars / F.greatest(size, F.lit(1))
    return F.lit(0.5) + 0.25 * F.least(F.lit(1.0), size / 200.0) + F.when((mean > 2) & (mean < 12), 0.25).otherwise(0.0)


def _uniform(doc_id: Column, text: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _sized(docs: DataFrame, weight: Column | None, carry: bool = False) -> DataFrame:
    """doc_id, source, size and key of each row; with `carry` the whole row as `__row`."""
    size = F.size(word_array(F.col("text"))).cast("long")
    chars = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    base = docs.select("doc_id", "source", size.alias("size"), chars.alias("chars"), _uniform(F.col("doc_id"), F.col("text")).alias("u"), *([weight.cast("double").alias("w")] if weight is not None else []), *([F.struct(*docs.columns).alias("__row")] if carry else []))
    w = quality_weight(F.col("size"), F.col("chars")) if weight is None else F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.coalesce(F.col("w"), F.lit(0.05))))
    key = F.floor(-F.ln("u") / w * float(1 << KEY_BITS)).cast("long")
    return base.select("doc_id", "source", "size", key.alias("key"), *(["__row"] if carry else []))


def targets(sized: DataFrame, share_percent: int = SHARE_PERCENT, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target and row count: shares by weight, water-filled below the epoch limit."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", "source_rows", "rank", weight.alias("weight"), (F.col("source_size") * float(MAX_EPOCHS)).alias("cap"))
    everything = Window.partitionBy()
    upto = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * share_percent / 100.0).alias("total"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).alias("rest_weight"),
        F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("capped"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest_weight"))
    # From the first source that its level doesn't fill, all share that level.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"]
    return filled.select("source", "source_size", "source_rows", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap")).alias("target"))


def _join(left: DataFrame, small: DataFrame, few: bool) -> DataFrame:
    small = small.withColumnRenamed("source", "__source")
    return left.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("__source")), "left" if few else "inner").drop("__source")


def boundaries(sized: DataFrame, share_percent: int, weights: tuple) -> tuple[DataFrame, bool]:
    """One row for each source with its target, epochs and the keys between which selection ends; whether they are few."""
    plan = materialise(targets(sized, share_percent, weights).coalesce(1), "mix-targets")
    few = plan.count() <= BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    # Keys below lo are selected; those from lo to below hi are undecided.
    state = plan.select("source", "source_size", "target", whole.alias("epochs"), (F.col("target") - whole * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("lo"), F.lit(1 << 62).cast("long").alias("hi"), F.lit(0).cast("long").alias("before"), F.lit(1 << (KEY_BITS - 3)).cast("long").alias("step"), F.col("source_rows").alias("open"))
    while True:
        seen = materialise(state.coalesce(1), "mix-state")
        if not seen.filter((F.col("open") > SORT_ROWS) & (F.col("step") > 0) & (F.col("rest") > 0)).limit(1).count():
            break
        inside = _join(sized, seen.filter("rest > 0 AND step > 0"), few).filter("key >= lo AND key < hi")
        digit = F.least(F.lit(RADIX - 1).cast("long"), F.floor((F.col("key") - F.col("lo")) / F.col("step")))
        sums = inside.groupBy("source", "lo", "hi", "before", "step", "rest", digit.alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        order = Window.partitionBy("source").orderBy("digit")
        run = sums.withColumn("ahead", F.col("before") + F.sum("words").over(order) - F.col("words"))
        # The boundary digit is the last that begins at or below the rest.
        best = run.filter("ahead <= rest").groupBy("source").agg(F.max(F.struct("digit", "ahead", "rows", "lo", "hi", "step")).alias("b"))
        best = best.select(F.col("source").alias("__source"), "b.*")
        start = F.col("b.lo") + F.col("b.digit") * F.col("b.step")
        end = F.when(F.col("b.digit") == RADIX - 1, F.col("b.hi")).otherwise(start + F.col("b.step"))
        hit = F.col("b.digit").isNotNull()
        state = seen.alias("s").join(best.alias("b"), F.col("s.source").eqNullSafe(F.col("b.__source")), "left").select(
            "s.source", "s.source_size", "s.target", "s.epochs", "s.rest",
            F.when(hit, start).otherwise(F.col("s.lo")).alias("lo"), F.when(hit, end).otherwise(F.col("s.hi")).alias("hi"),
            F.when(hit, F.col("b.ahead")).otherwise(F.col("s.before")).alias("before"),
            F.when(hit & (end - start <= 1), F.lit(0)).otherwise(F.when(hit, F.ceil((end - start) / F.lit(RADIX))).otherwise(F.lit(0))).cast("long").alias("step"),
            F.when(hit, F.col("b.rows")).otherwise(F.lit(0)).cast("long").alias("open"),
        )
    return seen, few


def _numbered(near: DataFrame) -> DataFrame:
    """near with `run`: the words before each row in key order, where very many rows share a key.

    Rows that share key, id and size are counted for each task that holds them; the few
    counts are ordered, and each task numbers its own rows. The rows are written first, so
    that they stay where they are.
    """
    tie = ["source", "key", "doc_id", "size"]
    placed = materialise(near.withColumn("__part", F.spark_partition_id()), "mix-ties")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*tie, "__part").agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__start", F.coalesce(F.sum(F.col("__n") * F.col("size")).over(order), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"__{c}") for c in tie], F.col("__part").alias("__at"), "__start")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in tie]
    joined = placed.join(starts, reduce(and_, same) & (F.col("__part") == F.col("__at")))
    inside = Window.partitionBy(*tie, "__part").orderBy(F.lit(0))
    run = F.col("before") + F.col("__start") + (F.row_number().over(inside) - 1) * F.col("size")
    return joined.withColumn("run", run).drop("__part", "__at", "__start", *[f"__{c}" for c in tie])


def _assign(rows: DataFrame, seen: DataFrame, few: bool) -> DataFrame:
    """The rows with `copies` of each; only those between the boundary keys are sorted."""
    joined = _join(rows, seen, few)
    undecided = (F.col("rest") > 0) & (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    tied = seen.filter((F.col("open") > SORT_ROWS) & (F.col("rest") > 0)).limit(1).count()
    near = joined.filter(undecided)
    near = _numbered(near) if tied else near.withColumn("run", F.col("before") + F.sum("size").over(order) - F.col("size"))
    near = near.withColumn("copies", F.col("epochs") + (F.col("run") + F.col("size") / 2.0 <= F.col("rest")).cast("long")).drop("run")
    far = joined.filter(~undecided).withColumn("copies", F.col("epochs") + ((F.col("rest") > 0) & (F.col("key") < F.col("lo"))).cast("long"))
    return far.unionByName(near)


def mix(docs: DataFrame, weight: Column | None = None, share_percent: int = SHARE_PERCENT, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each row of docs.

    `weight` may name a column with a document's own quality weight (0.05 to 1).
    """
    sized = materialise(_sized(docs, weight), "mix-sized")
    rows = _assign(sized, *boundaries(sized, share_percent, weights))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weight: Column | None = None, share_percent: int = SHARE_PERCENT, weights: tuple = WEIGHTS) -> DataFrame:
    """The mixture itself: the columns of docs, each row as often as it is taken. Whole rows stay where they are."""
    sized = materialise(_sized(docs, weight), "mix-sized")
    rows = _assign(_sized(docs, weight, carry=True), *boundaries(sized, share_percent, weights))
    return rows.filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("__row.*")


def op5_mix_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, len(coalesce(text, '')) AS chars,
    (CAST(concat('0x', substr(md5(concat_ws(':', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 48)!r}::DOUBLE AS u
  FROM documents),
k AS (SELECT *, CAST(floor(-ln(u) / (0.5::DOUBLE + 0.25::DOUBLE * least(1.0::DOUBLE, size / 200.0::DOUBLE)
    + CASE WHEN chars::DOUBLE / greatest(size, 1) > 2 AND chars::DOUBLE / greatest(size, 1) < 12 THEN 0.25::DOUBLE ELSE 0::DOUBLE END) * {float(1 << KEY_BITS)!r}::DOUBLE) AS BIGINT) AS key FROM s),
t AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM k GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((rank - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 2 AS cap FROM t),
l AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
      WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, cap, weight, (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1) AS level FROM l),
p AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM p),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS run
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND run + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
