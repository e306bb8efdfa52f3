"""Running totals over a whole table without one task sorting it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

#: Range buckets of a running total; each is sorted by itself.
BUCKETS = 256


def running_total(df: DataFrame, order: list[str], value: Column, out: str, buckets: int = BUCKETS, cut_from: DataFrame | None = None) -> DataFrame:
    """df with `out`: the sum of `value` over all rows up to this one, by `order` (the first is a number)."""
    return _running(df, order, value, out, buckets, cut_from, F.sum, lambda inside, before: inside + F.coalesce(before, F.lit(0)))


def running_max(df: DataFrame, order: list[str], value: Column, out: str, buckets: int = BUCKETS) -> DataFrame:
    """df with `out`: the greatest `value` of all rows up to this one; nulls don't count."""
    return _running(df, order, value, out, buckets, None, F.max, lambda inside, before: F.greatest(inside, before))


def range_bucket(df: DataFrame, column: str, buckets: int = BUCKETS, cut_from: DataFrame | None = None) -> Column:
    """Number of the quantile range that a row's `column` (a number or a time) falls into; -1 for null.

    The cuts are searched by halves, as nested comparisons in generated code.
    """
    kind = (cut_from or df).schema[column].dataType
    if not isinstance(kind, (NumericType, TimestampType, DateType)):
        raise TypeError(f"{column} is {kind.simpleString()}; ranges are cut on numbers and times")
    as_number = lambda c: c.cast("timestamp").cast("double") if isinstance(kind, (TimestampType, DateType)) else c.cast("double")
    key = as_number(F.col(column))
    cuts = sorted(set((cut_from or df).select(as_number(F.col(column)).alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key > cuts[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return F.when(key.isNull(), F.lit(-1)).otherwise(search(0, len(cuts)))


def _running(df: DataFrame, order: list[str], value: Column, out: str, buckets: int, cut_from: DataFrame | None, aggregate, join) -> DataFrame:
    """A running aggregate in two phases.

    Rows are cut into ranges of the first order column by approximate quantiles;
    ranges are summed, the sums of those before are added within each. At most
    `buckets` sums are broadcast, whatever the input. Null order values come first.
    The ranges may be cut on another table with the first order column (`cut_from`),
    such as the source of a costly df; any cuts give the same result.
    """
    marked = df.withColumn("__bucket", range_bucket(df, order[0], buckets, cut_from)).withColumn("__value", value)
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("__bucket").agg(aggregate("__value").alias("__sum")).withColumn("__before", aggregate("__sum").over(before)).drop("__sum")
    inside = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.join(F.broadcast(sums), "__bucket").withColumn(out, join(aggregate("__value").over(inside), F.col("__before")))
    return summed.drop("__bucket", "__value", "__before")


def row_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Consecutive numbers from 0 in the given order."""
    return running_total(df, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out) - 1)
