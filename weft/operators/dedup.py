"""Duplicates, history and leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to this many word runs (about 100 bytes each) are broadcast.
BROADCAST_RUNS = 200_000


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key by `order` (a unique one).

    One aggregate that Spark combines before its shuffle: a hot key sends one row from each task.
    """
    rows = df.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return rows.select("__row.*")


def without_history(df: DataFrame, key: Column, history: DataFrame, history_key: str) -> DataFrame:
    """Rows whose key is not among those of the history."""
    seen = history.select(F.col(history_key).alias("__seen")).distinct()
    return df.withColumn("__key", key).join(seen, F.col("__key") == F.col("__seen"), "left_anti").drop("__key")


def leaked(df: DataFrame, key: Column, held: DataFrame, held_key: Column, keep: str = "left_semi") -> DataFrame:
    """Rows that share a canonical key with the held-out table (left_semi), or the rest (left_anti)."""
    other = held.select(held_key.alias("__held")).distinct()
    return df.withColumn("__key", key).join(other, F.col("__key") == F.col("__held"), keep).drop("__key")


def contains_any(df: DataFrame, text: Column, phrases: DataFrame, phrase: str, words: int) -> DataFrame:
    """Rows of df whose text shares a run of `words` words with any phrase.

    Runs are joined by 64-bit hashes, and only those that meet carry their words, which decide.
    The phrases' runs are broadcast up to BROADCAST_RUNS of them.
    """
    runs = F.expr(f"transform(sequence(0, size(__w) - {words}), i -> array_join(slice(__w, i + 1, {words}), ' '))")
    split = lambda d, c: d.withColumn("__w", F.split(c, r"[\s]+")).filter(F.size("__w") >= words).withColumn("__run", F.explode(F.array_distinct(runs))).drop("__w").withColumn("__h", F.xxhash64("__run"))
    right = split(phrases.select(phrase), F.col(phrase)).select(F.col("__h").alias("__rh"), F.col("__run").alias("__rr")).distinct()
    few = F.broadcast(right) if right.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS else right
    return split(df, text).join(few, (F.col("__h") == F.col("__rh")) & (F.col("__run") == F.col("__rr")), "left_semi").drop("__run", "__h")


def distinct_by_components(parts: list[DataFrame], key: str, order: str) -> list[DataFrame]:
    """Each part without keys that an earlier part (or an earlier row of its own) holds; rows with an empty key go too."""
    whole = None
    for i, p in enumerate(parts):
        rows = p.filter(F.coalesce(F.col(key), F.lit("")) != "").withColumn("__part", F.lit(i))
        whole = rows if whole is None else whole.unionByName(rows)
    first = whole.groupBy(key).agg(F.min_by(F.struct(*whole.columns), F.struct("__part", order)).alias("__row")).select("__row.*")
    return [first.filter(F.col("__part") == i).drop("__part") for i in range(len(parts))]


def priority_pick(df: DataFrame, key: str, rank: Column) -> DataFrame:
    """The row of least rank of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(rank))).filter("__r = 1").drop("__r")
