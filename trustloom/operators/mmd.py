"""Distribution drift of feature vectors by maximum mean discrepancy.

A Gaussian kernel is expanded in random Fourier features, so the distance is the gap between two mean vectors: one pass over
the rows, no pairs. The probability comes from repeating the mean over hashed splits of the pooled rows in the same pass.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, functions as F

FREQUENCIES = 128
PERMUTATIONS = 99


class Reference(NamedTuple):
    """What later rows are held against: the waves, the mean of each over ``n`` rows, and the limit of the weighted distance."""

    frequencies: np.ndarray
    phase: np.ndarray
    means: np.ndarray
    n: int
    limit: float


def waves(rows: DataFrame, vector: str, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.random.Generator]:
    """Frequencies and phases; the kernel is as wide as the rows' spread (one number per dimension is read)."""
    shape = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s")).collect()
    bandwidth = float(np.sqrt(sum(r["s"] for r in shape))) or 1.0
    rng = np.random.default_rng(seed)
    return rng.normal(size=(len(shape), FREQUENCIES)) / bandwidth, rng.uniform(0, 2 * np.pi, FREQUENCIES), rng


def wave_values(vector: Column, freq: np.ndarray, phase: np.ndarray) -> Column:
    """The values of all waves at a vector of doubles."""
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.cos(np.stack(v.to_numpy()) @ freq + phase) * np.sqrt(2 / len(phase))) if len(v) else [])

    return run(vector)


def _sums(freq: np.ndarray, phase: np.ndarray, draws: np.ndarray, share: float):
    """Per task and draw (the first is the real one): sums of the waves and row counts of both sides."""
    def sums(batches):
        total = np.zeros((PERMUTATIONS + 1, 2, FREQUENCIES + 1))
        for pdf in batches:
            z = np.cos(np.stack(pdf["v"].to_numpy()) @ freq + phase) * np.sqrt(2 / FREQUENCIES)
            z = np.hstack([z, np.ones((len(z), 1))])
            cur = pdf["cur"].to_numpy()
            mixed = (pdf["h"].to_numpy(dtype=np.int64)[:, None] ^ draws[None, :]).astype(np.uint64)
            mixed ^= mixed >> np.uint64(32)  # from the second multiplication on every bit depends on every bit
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)
            side = np.hstack([cur[:, None], mixed < share * 2.0**53])
            ones = side.T @ z
            total[:, 1] += ones
            total[:, 0] += z.sum(axis=0) - ones
        yield pd.DataFrame({"draw": np.repeat(np.arange(PERMUTATIONS + 1), 2), "side": np.tile([0, 1], PERMUTATIONS + 1),
                            "sums": list(total.reshape(-1, FREQUENCIES + 1))})

    return sums


def mmd_drift(df: DataFrame, key: str, vector: str, is_current: Column, p_value: float = 0.05, preprocess=None,
              seed: int = 42) -> DataFrame:
    """Squared distance between reference and current rows, its permutation probability and the verdict (one row).

    A permutation gives every row to the current side with the share of the current rows, so its sides are about as large as
    the real ones; distances are compared times n0 * n1 / (n0 + n1), which takes out what is left of the difference in size.
    """
    rows = (preprocess(df) if preprocess else df).select(
        F.xxhash64(key).alias("h"), F.col(vector).cast("array<double>").alias("v"), is_current.cast("int").alias("cur"))
    freq, phase, rng = waves(rows, "v", seed)
    share = float(rows.agg(F.avg("cur")).first()[0] or 0.0)
    draws = rng.integers(1, 2**62, PERMUTATIONS, dtype=np.int64)

    parts = rows.mapInPandas(_sums(freq, phase, draws, share), "draw INT, side INT, sums ARRAY<DOUBLE>")
    added = parts.select("draw", "side", F.posexplode("sums").alias("i", "x")).groupBy("draw", "i").pivot("side", [0, 1]).agg(F.sum("x"))
    n = added.where(F.col("i") == FREQUENCIES).select("draw", F.col("0").alias("n0"), F.col("1").alias("n1"))
    filled = (F.col("n0") > 0) & (F.col("n1") > 0)  # a draw may leave one side empty: then there is no gap
    gap = F.when(filled, F.col("0") / F.col("n0") - F.col("1") / F.col("n1")).otherwise(F.lit(0.0))
    weight = F.max(F.when(filled, F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1"))).otherwise(F.lit(0.0)))
    stats = added.where(F.col("i") < FREQUENCIES).join(n, "draw").groupBy("draw").agg(
        F.sum(gap * gap).alias("d"), (F.sum(gap * gap) * weight).alias("w"))
    wide = stats.agg(
        F.max(F.when(F.col("draw") == 0, F.col("d"))).alias("distance"), F.max(F.when(F.col("draw") == 0, F.col("w"))).alias("seen"),
        F.collect_list(F.when(F.col("draw") > 0, F.col("w"))).alias("null"))
    p = (1 + F.size(F.filter("null", lambda x: x >= F.col("seen")))) / F.lit(float(PERMUTATIONS + 1))
    return wide.select("distance", p.alias("p_value")).withColumn("drift", F.col("p_value") < p_value)

def reference(df: DataFrame, key: str, vector: str, p_value: float = 0.05, seed: int = 42) -> Reference:
    """The reference of a set of rows. The limit is the distance, weighted as in :func:`mmd_drift`, that only a share of
    ``p_value`` of hashed halvings of the rows exceeds; so a slot of rows like these exceeds it about as often.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(vector).cast("array<double>").alias("v"),
                                                      F.lit(1).alias("cur"))
    freq, phase, rng = waves(rows, "v", seed)
    draws = rng.integers(1, 2**62, PERMUTATIONS, dtype=np.int64)
    parts = rows.mapInPandas(_sums(freq, phase, draws, 0.5), "draw INT, side INT, sums ARRAY<DOUBLE>")
    added = parts.select("draw", "side", F.posexplode("sums").alias("i", "x")).groupBy("draw", "side", "i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((PERMUTATIONS + 1, 2, FREQUENCIES + 1))  # draws times waves, whatever the rows
    for r in added:
        total[r["draw"], r["side"], r["i"]] = r["x"]
    n = total[..., FREQUENCIES]
    if not n[0, 1]:
        raise ValueError("no reference rows")
    mean = total[..., :FREQUENCIES] / np.maximum(n, 1)[..., None]
    weight = n[1:, 0] * n[1:, 1] / np.maximum(n[1:].sum(1), 1)
    null = ((mean[1:, 0] - mean[1:, 1]) ** 2).sum(1) * weight
    return Reference(freq, phase, mean[0, 1], int(n[0, 1]), float(np.quantile(null, 1 - p_value)))
