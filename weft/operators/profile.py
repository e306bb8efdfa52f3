"""Reports: funnels, percentiles, mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.prefix import range_bucket, running_max


def funnel(df: DataFrame, checks: list[tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """Rows by the first check that holds; `kept` where none does."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(checks):
        reason = F.when(test, name).otherwise(reason)
    return df.groupBy(*(by or []), F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def reason_counts(df: DataFrame, reasons: Column) -> DataFrame:
    """How many rows each reason holds for; a row counts once for each of its reasons."""
    return df.select(F.explode(F.array_distinct(reasons)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, group: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """Mean, maximum and sorted[min(floor(n * p), n - 1)] of each group.

    Values are counted first, so that a group is one row for each different value
    and not for each row; running counts then find the ranks.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("__k"))
    order = Window.partitionBy(*group).orderBy(value)
    whole = Window.partitionBy(*group)
    run = counts.select(*group, value, "__k", F.sum("__k").over(order).alias("__upto"), F.sum("__k").over(whole).alias("__n"))
    rank = lambda p: F.least(F.floor(F.col("__n") * p) + 1, F.col("__n"))
    picks = [F.min(F.when(F.col("__upto") >= rank(p), F.col(value))).alias(f"p{int(p * 100)}") for p in points]
    return run.groupBy(*group).agg((F.sum(F.col(value) * F.col("__k")) / F.sum("__k")).alias("mean"), *picks, F.max(value).alias("max"))


def mixture(df: DataFrame, group: list[str], weight: str) -> DataFrame:
    """Rows, weight and share of the weight for each group."""
    sums = df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    return sums.withColumn("share", F.col("weight") / F.greatest(F.sum("weight").over(Window.partitionBy()), F.lit(1)))


def islands(df: DataFrame, order: str, key: str, carry: str | None = None) -> DataFrame:
    """Runs of neighbouring rows with one key: key, first, n and, with `carry`, the values of that column in order.

    Changes are marked inside quantile ranges of the order; a run is named by the
    order value of its first row, carried forward over range cuts, so that no key is
    one task however often it occurs. `order` values are unique.
    """
    inside = Window.partitionBy("__range").orderBy(order)
    marked = df.select(order, key, *([carry] if carry else [])).withColumn("__range", range_bucket(df, order))
    before = F.lag(F.struct(F.col(key).alias("k"))).over(inside)
    found = marked.withColumn("__new", F.when(before.isNull() | ~before["k"].eqNullSafe(F.col(key)), F.col(order)))
    # The first row of each range is a change unless the last row of the range before has its key: at most one row for each range.
    ends = found.groupBy("__range").agg(F.max_by(F.struct(F.col(key).alias("k")), order).alias("last"))
    heads = ends.select((F.row_number().over(Window.orderBy("__range"))).alias("__rank"), "__range", F.lag("last").over(Window.orderBy("__range")).alias("__before")).select("__range", "__before")
    true = found.join(F.broadcast(heads), "__range").withColumn("__new", F.when(before.isNull() & F.col("__before").isNotNull() & F.col("__before.k").eqNullSafe(F.col(key)), None).otherwise(F.col("__new")))
    named = running_max(true.drop("__before", "__range"), [order], F.col("__new"), "__run")
    values = [F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(carry).alias("v")))), lambda x: x["v"]).alias("values")] if carry else []
    return named.groupBy(key, F.col("__run").alias("first")).agg(F.count("*").alias("n"), *values)


def ema(df: DataFrame, group: str, order: str, value: Column, keep: float, out: str = "ema") -> DataFrame:
    """The exponential mean of each group's values in order: the first as it is, then keep * mean + (1 - keep) * value.

    Each quantile range of the order gives a weight and a sum; a group's few ranges are then folded in order.
    """
    inside = Window.partitionBy(group, "__range").orderBy(F.desc(order))
    ranged = df.select(group, order, value.cast("double").alias("__x"), range_bucket(df, order).alias("__range"))
    placed = ranged.withColumn("__back", F.row_number().over(inside) - 1)
    first = F.struct("__range", order)
    weight = (1 - keep) * F.pow(F.lit(keep), F.col("__back"))
    parts = placed.groupBy(group, "__range").agg(F.count("*").alias("k"), F.sum(F.col("__x") * weight).alias("s"), F.min_by(F.struct(F.col("__x").alias("x"), F.col("__back").alias("b")), first).alias("f"))
    listed = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__range", "k", "s", "f"))).alias("p"))
    fold = F.aggregate(
        "p",
        F.lit(None).cast("double"),
        # The very first value counts whole and not by its share.
        lambda a, p: F.when(a.isNull(), p["s"] + p["f"]["x"] * keep * F.pow(F.lit(keep), p["f"]["b"])).otherwise(a * F.pow(F.lit(keep), p["k"]) + p["s"]),
    )
    return listed.select(group, fold.alias(out))
