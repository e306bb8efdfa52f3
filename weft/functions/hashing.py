"""Deterministic hashes that order and sample rows, equal in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(seed: int | str, key: Column) -> Column:
    """The first 32 bits of md5("seed:key") as a bigint."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, key: Column) -> Column:
    """A number in [0, 1) that only seed and key decide."""
    return hash32(seed, key) / F.lit(float(1 << 32))


def mod_sample(seed: int | str, key: Column, ratio: float) -> Column:
    """True for about `ratio` of the keys, in steps of a thousandth."""
    return F.pmod(hash32(seed, key), F.lit(1000)) < F.lit(int(1000 * ratio))
