"""Byte budgets over ordered rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.prefix import running_total

#: Rows that one ordered pass may hold at the end of a first fit.
FOLD_ROWS = 100_000


def stop_after(df: DataFrame, order: list[str], size: Column, target: int, already: int = 0, out: str = "cum_bytes", cut_from: DataFrame | None = None) -> DataFrame:
    """Rows until the total reaches the target; the last may exceed it. `already` counts what is on disk."""
    total = running_total(df.withColumn("__size", size), order, F.col("__size"), out, cut_from=cut_from)
    return total.filter(F.col(out) - F.col("__size") + already < target).drop("__size")


def break_before(df: DataFrame, order: list[str], size: Column, target: int, out: str = "cum_bytes") -> DataFrame:
    """Rows until the first that would exceed the target."""
    return running_total(df, order, size, out).filter(F.col(out) <= target)


def cap_files(df: DataFrame, group: list[str], order: list[str], size: Column, cap: int) -> DataFrame:
    """Rows of each file until the first that would exceed its cap; all later ones are left out, even if they would fit."""
    files = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__end", F.sum(size).over(files)).filter(F.col("__end") <= cap).drop("__end")


def skip_what_does_not_fit(df: DataFrame, order: list[str], size: Column, target: int, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """First fit: a row that does not fit is left out and later ones may still fit.

    While many rows may still fit, the longest run of them that does is taken by
    running totals over ranges; the row that ends it is left out, and only later
    rows no larger than what is left stay candidates. At most `fold_rows` ids and
    sizes are left for the one ordered pass that decides the rest. Sizes are not negative.
    """
    keys = df.select(*order, size.alias("__size"))
    left, open_, taken = target, keys.filter(F.col("__size") <= target), None
    while left > 0 and open_.limit(fold_rows + 1).count() > fold_rows:
        run = running_total(open_, order, F.col("__size"), "__end")
        last = run.filter(F.col("__end") <= left).agg(F.max("__end").alias("sum"), F.max(F.struct(*order)).alias("at")).first()
        # Each candidate fits by itself, so the run has a row at least; what comes behind it did not fit.
        at = F.struct(*[F.lit(x).cast(keys.schema[c].dataType).alias(c) for c, x in zip(order, last["at"], strict=True)])
        fits, behind = open_.filter(F.struct(*order) <= at), open_.filter(F.struct(*order) > at)
        taken = fits if taken is None else taken.unionByName(fits)
        left -= last["sum"]
        open_ = behind.filter(F.col("__size") <= left)
    last_part = _fold(open_, order, left)
    kept = last_part if taken is None else taken.unionByName(last_part)
    return df.join(kept.drop("__size"), order, "left_semi")


def _fold(keys: DataFrame, order: list[str], target: int) -> DataFrame:
    def fill(batches):
        total = 0
        for batch in batches:
            keep = []
            for i, n in enumerate(batch["__size"]):
                if total + n <= target:
                    total += n
                    keep.append(i)
            yield batch.iloc[keep] if keep else pd.DataFrame(columns=batch.columns).astype(batch.dtypes)

    return keys.coalesce(1).sortWithinPartitions(*order).mapInPandas(fill, keys.schema)
