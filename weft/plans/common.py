"""Helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(*names: str):
    """on("a", "b", body): a query that hands the named tables to body."""
    *tables, body = names
    return lambda spark, sf_dir: body(*[read(spark, sf_dir, t) for t in tables])
