"""Packing token sequences into blocks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.hashing import hash32
from weft.operators.prefix import running_max, running_total


def fixed_blocks(df: DataFrame, key: str, ids: str, length: int) -> DataFrame:
    """block, ids, source, offset: all sequences end to end in blocks of `length`; the tail that fills none is dropped.

    A row is cut where blocks end, not into tokens; source and offset say where a
    block's first token stands. Only block numbers and cut rows are shuffled.
    """
    n = F.size(ids).cast("long")
    placed = running_total(df.withColumn("__n", n), [key], F.col("__n"), "__end").withColumn("__start", F.col("__end") - F.col("__n")).filter("__n > 0")
    total = placed.agg((F.coalesce(F.max("__end"), F.lit(0)) / length).cast("long").alias("__blocks"))
    first, last = F.floor(F.col("__start") / length), F.floor((F.col("__end") - 1) / length)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last))).join(F.broadcast(total), F.col("block") < F.col("__blocks"))
    low = F.greatest(F.col("block") * length - F.col("__start"), F.lit(0))
    high = F.least((F.col("block") + 1) * length - F.col("__start"), F.col("__n"))
    parts = cut.select("block", F.struct((F.col("__start") + low).alias("at"), F.col(key).alias("source"), low.alias("offset"), F.slice(ids, (low + 1).cast("int"), (high - low).cast("int")).alias("ids")).alias("part"))
    grouped = parts.groupBy("block").agg(F.array_sort(F.collect_list("part")).alias("p"))
    return grouped.select("block", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.get("p", 0)["source"].alias("source"), F.get("p", 0)["offset"].alias("offset"))


def long_windows(df: DataFrame, key: str, count: str, length: int, jitter: int, seed: str = "win") -> DataFrame:
    """key, start: one window of `length` for sequences just long enough, else three around the
    beginning, middle and end, moved by up to half of `jitter` and kept inside; equal starts once."""
    top = F.col(count) - length
    span = F.least(F.lit(jitter), top)
    half = F.floor(span / 2)
    single = F.pmod(hash32(seed, F.col(key)), span + 1)

    def anchor(k: int):
        move = F.pmod(hash32(f"{seed}{k}", F.col(key)), 2 * half + 1) - half
        return F.greatest(F.lit(0), F.least(top, F.floor(top * k / 2) + move)).cast("long")

    starts = F.when(F.col(count) < length + jitter, F.array(single.cast("long"))).otherwise(F.array_distinct(F.array(*[anchor(k) for k in range(3)])))
    return df.filter(F.col(count) >= length).select(key, F.explode(starts).alias("start"))


def block_provenance(df: DataFrame, key: str, count: str, length: int) -> DataFrame:
    """block, source, offset of each whole block, by the rule that a source starts only where a block does.

    The source is the last sequence that began on a block boundary, and the offset counts from there, so it may exceed that
    sequence. A running maximum carries those beginnings forward.
    """
    n = F.col(count).cast("long")
    placed = running_total(df.select(key, count), [key], n, "__end").withColumn("__start", F.col("__end") - n)
    whole = placed.agg(F.floor(F.coalesce(F.max("__end"), F.lit(0)) / length).alias("b")).first()["b"]
    starts = placed.filter(F.col("__start") % length == 0).groupBy("__start").agg(F.max(key).alias("source"))
    marks = starts.select(F.col("__start").alias("at"), F.lit(0).alias("kind"), F.col("__start").alias("from"))
    wanted = df.sparkSession.range(whole).select((F.col("id") * length).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("from"))
    carried = running_max(marks.unionByName(wanted), ["at", "kind"], F.col("from"), "begin").filter("kind = 1")
    found = carried.join(starts, F.col("begin") == F.col("__start"))
    return found.select((F.col("at") / length).cast("long").alias("block"), "source", (F.col("at") - F.col("begin")).alias("offset"))
