"""First rows per key, best rows, repeatable samples.

``row_number() <= n`` becomes a group limit that runs before the shuffle as well as after it, so a hot key sends at most
``n`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trustloom.functions.numeric import md5_order


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key along an explicit order, with their ``position``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; null keys count as equal."""
    return first_rows(df, keys, order, 1).drop("position")


def top_by(df: DataFrame, value: str, name: str, n: int) -> DataFrame:
    """The ``n`` largest values; ties by name."""
    return df.orderBy(F.col(value).desc(), F.col(name)).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same on every run."""
    return df.orderBy(md5_order(F.col(key), seed), key).limit(n)


def best_by(df: DataFrame, score: str, name: str) -> DataFrame:
    """The row with the highest score; ties go to the first name."""
    return df.orderBy(F.col(score).desc(), F.col(name)).limit(1)
