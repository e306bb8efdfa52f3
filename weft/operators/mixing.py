"""Ratio mixes, repetition, interleaving and token-budget batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.operators.prefix import row_numbers


def mix_size(vision: Column, ratio: float) -> Column:
    """Text rows for a share `ratio` of the whole, rounded half to even."""
    return F.bround(vision * ratio / (1 - ratio), 0).cast("long")


def split_of_mix(vision: int, ratio: float, parts: tuple[int, ...]) -> list[int]:
    """Rows of each part of the text that makes up `ratio` of the whole; the last part takes the rest."""
    n = round(vision * ratio / (1 - ratio))
    out = [round(n * p / sum(parts)) for p in parts[:-1]]
    return [*out, n - sum(out)]


def pool_draws(updates: DataFrame, number: str, pools: dict[str, DataFrame], order: str, counts: dict[str, tuple[int, ...]]) -> DataFrame:
    """update, pool, cursor and the row read: in update u a pool gives counts[pool][u % length] rows, from where the last update stopped, round and round."""
    out = None
    for name, rows in pools.items():
        cycle = counts[name]
        before = F.element_at(F.array(*[F.lit(sum(cycle[:i])) for i in range(len(cycle))]), (F.col(number) % len(cycle) + 1).cast("int"))
        now = F.element_at(F.array(*[F.lit(c) for c in cycle]), (F.col(number) % len(cycle) + 1).cast("int"))
        start = F.floor(F.col(number) / len(cycle)) * sum(cycle) + before
        drawn = updates.filter(now > 0).select(number, F.explode(F.sequence(start.cast("long"), (start + now - 1).cast("long"))).alias("cursor"))
        placed = row_numbers(rows, [order], "__i")
        # A pool's size is one row.
        size = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("__n"))
        read = drawn.join(F.broadcast(size)).withColumn("__i", F.col("cursor") % F.col("__n")).drop("__n").join(placed, "__i").drop("__i")
        part = read.select(number, F.lit(name).alias("pool"), "cursor", order)
        out = part if out is None else out.unionByName(part)
    return out


def pad_to_multiple(df: DataFrame, order: list[str], multiple: int) -> DataFrame:
    """All rows in order and the first ones again until their number is a multiple; `place` counts on."""
    numbered = row_numbers(df, order, "place")
    size = df.agg(F.count("*").alias("__n"))
    more = numbered.filter(F.col("place") < multiple).join(F.broadcast(size)).filter(F.col("place") < F.pmod(-F.col("__n"), F.lit(multiple))).withColumn("place", F.col("place") + F.col("__n")).drop("__n")
    return numbered.unionByName(more)


def union_of_one_schema(parts: list[DataFrame]) -> DataFrame:
    """All parts as one table; differing schemas raise."""
    first, out = [(f.name, f.dataType) for f in parts[0].schema], parts[0]
    for p in parts[1:]:
        if [(f.name, f.dataType) for f in p.schema] != first:
            raise ValueError(f"schemas differ: {p.schema.simpleString()} and {parts[0].schema.simpleString()}")
        out = out.unionByName(p)
    return out


def cycle_to(df: DataFrame, order: list[str], need: int, most: int) -> DataFrame:
    """`need` rows by going round the table in order, each row `most` times at most; `round` says which time."""
    numbered = row_numbers(df, order, "__n")
    size = df.agg(F.greatest(F.count("*"), F.lit(1)).alias("__size"))
    rounds = numbered.join(F.broadcast(size)).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    return rounds.filter(F.col("round") * F.col("__size") + F.col("__n") < need).drop("__n", "__size")


def interleave(parts: list[tuple[DataFrame, int]], order: str) -> DataFrame:
    """Rows of several tables in cadence: so many of the first, so many of the second, and again. Column `slot` gives the place."""
    period = sum(k for _, k in parts)
    out, start = None, 0
    for df, k in parts:
        n = F.col("__n")
        placed = row_numbers(df, [order], "__n").withColumn("slot", (F.floor(n / k) * period + start + n % k).cast("long")).drop("__n")
        out = placed if out is None else out.unionByName(placed)
        start += k
    return out


def token_budget_batches(df: DataFrame, group: str, order: list[str], length: str, budget: int) -> DataFrame:
    """`batch` numbers within each group: a row joins the batch while (rows + 1) * longest keeps to the budget.

    The fold depends on all rows before, so each group is one ordered pass;
    groups are shards of bounded size that the caller sets.
    """
    schema = StructType([*df.schema.fields, StructField("batch", LongType())])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        batch, n, longest, out = 0, 0, 0, []
        for x in rows[length]:
            most = max(longest, x)
            if n and (n + 1) * most > budget:
                batch, n, most = batch + 1, 0, x
            n, longest = n + 1, most
            out.append(batch)
        return rows.assign(batch=out)

    return df.groupBy(group).applyInPandas(fold, schema)
