"""Deterministic samples and splits by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.hashing import hash32
from weft.operators.prefix import row_numbers


def top_k_by_hash(df: DataFrame, key: str, seed: int | str, k: int) -> DataFrame:
    """The k rows of least hash, ties by key."""
    return df.withColumn("score", hash32(seed, F.col(key))).orderBy("score", key).limit(k)


def top_k_per_group(df: DataFrame, group: str, key: str, seed: int | str, k: int) -> DataFrame:
    """The k rows of least hash in each group; Spark trims each task's rows to k before the shuffle."""
    order = Window.partitionBy(group).orderBy("score", key)
    return df.withColumn("score", hash32(seed, F.col(key))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def stratified_dev(df: DataFrame, stratum: str, key: str, seed: int | str, dev: int) -> DataFrame:
    """`split`: the first `dev` rows of each stratum by hash are dev, the rest train; strata of `dev` rows or fewer are train."""
    narrow = df.select(F.col(stratum).alias("__s"), F.col(key).alias("__k"))
    large = narrow.groupBy("__s").agg(F.count("*").alias("__n")).filter(F.col("__n") > dev).select(F.col("__s").alias("__large"))
    # Each task trims a stratum to `dev` rows before the shuffle; the chosen ids are joined back.
    first = top_k_per_group(narrow, "__s", "__k", seed, dev)
    chosen = first.join(large, F.col("__s").eqNullSafe(F.col("__large")), "left_semi").select(F.col("__k").alias("__dev")).distinct()
    return df.join(chosen, F.col(key) == F.col("__dev"), "left").withColumn("split", F.when(F.col("__dev").isNotNull(), "dev").otherwise("train")).drop("__dev")


def require_rows(df: DataFrame, need: int, what: str) -> DataFrame:
    """df if it has `need` rows at least; fewer raise."""
    found = df.limit(need).count()
    if found < need:
        raise ValueError(f"{what}: {found} rows of {need}")
    return df


def quota(df: DataFrame, key: str, seed: int | str, need: int, what: str = "quota") -> DataFrame:
    """The `need` rows of least hash; too few rows raise."""
    return require_rows(top_k_by_hash(df, key, seed, need), need, what)


def strata_then_fill(df: DataFrame, stratum: str, key: str, seed: int | str, each: int, total: int) -> DataFrame:
    """`each` rows of every stratum by hash, then by hash until there are `total`; `place` gives the order."""
    ranked = df.select(stratum, key).withColumn("score", hash32(seed, F.col(key)))
    first = top_k_per_group(df.select(stratum, key), stratum, key, seed, each).select(stratum, key, "score", F.lit(0).alias("later"))
    fill = ranked.orderBy("score", key).limit(total).select(stratum, key, "score", F.lit(1).alias("later"))
    # A row of both parts counts once, as one of its stratum's; the fill holds enough rows even if all of them are in both.
    both = first.unionByName(fill).groupBy(stratum, key, "score").agg(F.min("later").alias("later"))
    return both.orderBy("later", "score", key).limit(total)


def holdout(df: DataFrame, order: list[str], share: int = 20, least: int = 32, most: int = 128) -> DataFrame:
    """`split`: the first rows are eval, n // share of them but between `least` and `most`."""
    n = df.agg(F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.count("*") / share))).alias("__n"))
    numbered = row_numbers(df, order, "__i").join(F.broadcast(n))
    return numbered.withColumn("split", F.when(F.col("__i") < F.col("__n"), "eval").otherwise("train")).drop("__i", "__n")


def paged(df: DataFrame, order: list[str], seed: int | str, page: int, most: int) -> DataFrame:
    """Rows by pages of `page` in the table's order, the pages in hash order, `most` rows at most."""
    pages = row_numbers(df, order, "__i").withColumn("page", F.floor(F.col("__i") / page))
    return pages.withColumn("__h", hash32(seed, F.col("page"))).orderBy("__h", "page", "__i").limit(most).drop("__h", "__i")


def buffer_shuffle(df: DataFrame, order: list[str], seed: int | str, buffer: int) -> DataFrame:
    """`place`: rows in order, shuffled by hash within each stretch of `buffer` rows."""
    placed = row_numbers(df, order, "__i").withColumn("__b", F.floor(F.col("__i") / buffer))
    inside = Window.partitionBy("__b").orderBy(hash32(seed, F.col(order[0])), *order)
    return placed.withColumn("place", F.col("__b") * buffer + F.row_number().over(inside) - 1).drop("__i", "__b")


def reservoir(df: DataFrame, order: list[str], seed: int | str, k: int) -> DataFrame:
    """k rows as Algorithm R leaves them when row i draws its slot by hash: the last row to land in a slot holds it."""
    drawn = row_numbers(df, order, "__i").withColumn("slot", F.when(F.col("__i") < k, F.col("__i")).otherwise(F.pmod(hash32(seed, F.col(order[0])), F.col("__i") + 1)))
    return drawn.filter(F.col("slot") < k).groupBy("slot").agg(F.max_by(F.struct(*df.columns), "__i").alias("__row")).select("slot", "__row.*")


def eval_size(rows: Column, fraction: float, least: int, most: int) -> Column:
    """min(max(least, fraction * rows), most, rows - 1), as whole rows."""
    return F.greatest(F.lit(0), F.least(F.greatest(F.lit(least), F.floor(rows * fraction)), F.lit(most), rows - 1)).cast("long")


def hash_parity(seed: int | str, key: Column) -> Column:
    return F.pmod(hash32(seed, key), F.lit(2))


def pick_one(values: Column, seed: int | str, key: Column) -> Column:
    """One element of an array by hash; null for an empty one."""
    return F.when(F.size(values) > 0, F.get(values, F.pmod(hash32(seed, key), F.greatest(F.size(values), F.lit(1))).cast("int")))


def shuffle_in_buckets(df: DataFrame, key: str, seed: int | str, buckets: int = 256) -> DataFrame:
    """External shuffle: rows dealt into buckets by hash, each in hash order."""
    return df.withColumn("__h", hash32(seed, F.col(key))).repartition(buckets, F.pmod("__h", F.lit(buckets))).sortWithinPartitions("__h", key).drop("__h")
