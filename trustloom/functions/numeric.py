"""Numeric helpers: safe division, ratings, hashing to buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NEUTRAL_RATING = 3.0
TRUE_VALUES = (1.0, 5.0)


def divide(a: Column, b: Column, default: float = 0.0) -> Column:
    """``a / b``, or the default where the divisor is zero or either side is missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def rating_value(col: Column, default: float = 0.0) -> Column:
    """Rating as a number; anything unreadable becomes the default."""
    return F.coalesce(col.try_cast("double"), F.lit(default))


def is_extreme(col: Column) -> Column:
    return F.coalesce(col.try_cast("double").isin(*TRUE_VALUES), F.lit(False)).cast("int")


def hash_percent(key: Column) -> Column:
    """Stable bucket 0-99 of a key from its md5 digest, the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def hash_unit(*keys: Column) -> Column:
    """Repeatable pseudo-random number in [0, 1) from row keys and a seed."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def md5_order(key: Column, seed: int) -> Column:
    """Repeatable order of rows: 52 bits of the md5 digest of key and seed, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("bigint")
