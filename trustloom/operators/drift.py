"""Feature quality and distribution drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trustloom.operators.ordered import quantiles, running_sums

BINS = 10
SMOOTHING = 1e-6
PSI_LIMIT = 0.25
SERIES_TERMS = 100


def long_features(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One row per (row, feature) with a double ``value``."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(ids, features, "feature", "value")


def feature_quality(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Missing and zero rates, distinct values, spread, shape, and correlation with the target per feature."""
    value = F.when(~F.isnan("value"), F.col("value"))
    long = long_features(df.withColumn("_y", F.col(target).cast("double")), ["_y"], features).withColumn("value", value)
    return long.groupBy("feature").agg(
        (F.count(F.when(F.col("value").isNull(), 1)) / F.count("*")).alias("missing_rate"),
        (F.count(F.when(F.col("value") == 0, 1)) / F.count("*")).alias("zero_rate"),
        F.count_distinct("value").alias("unique_values"), F.stddev_pop("value").alias("std"),
        F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"),
        F.corr("value", "_y").alias("target_correlation"))


def _bin(edges: Column, v: Column) -> Column:
    """Position of the bin, the last one closed; null outside the edges."""
    n = F.size(edges)
    at = F.size(F.filter(edges, lambda e: e <= v))
    return F.when((v < F.element_at(edges, 1)) | (v > F.element_at(edges, -1)), None).otherwise(F.least(at, n - 1))


def psi(long: DataFrame, is_current: Column, bins: int = BINS) -> DataFrame:
    """Population stability index per feature over quantile bins of the reference side."""
    sides = long.where(F.col("value").isNotNull()).withColumn("_cur", is_current.cast("int"))
    q = quantiles(sides.where("_cur = 0"), ["feature"], "value", [i / bins for i in range(bins + 1)])
    edges = q.select("feature", F.array_distinct(F.array(*[f"q{i}" for i in range(bins + 1)])).alias("edges"))
    # frequent values first: the join and the binning then see distinct values only
    counted = sides.groupBy("feature", "value").agg(
        F.sum(1 - F.col("_cur")).alias("ref"), F.sum("_cur").alias("cur")).join(edges, "feature")
    binned = counted.groupBy("feature", _bin(F.col("edges"), F.col("value")).alias("bin")).agg(
        F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    totals = sides.groupBy("feature").agg(F.sum(1 - F.col("_cur")).alias("all_ref"), F.sum("_cur").alias("all_cur"))
    e = F.col("ref") / F.col("all_ref") + SMOOTHING
    a = F.col("cur") / F.col("all_cur") + SMOOTHING
    return binned.where(F.col("bin").isNotNull()).join(totals, "feature").groupBy("feature").agg(
        F.sum((a - e) * F.log(a / e)).alias("psi"))


def _kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Two-sided asymptotic probability of the statistic."""
    en = F.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    sign = lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0)
    terms = F.transform(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), lambda j: sign(j) * F.exp(-2 * j * j * lam * lam))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def ks_test(long: DataFrame, is_current: Column) -> DataFrame:
    """Largest gap between the two distribution functions per feature, and its probability."""
    sides = long.where(F.col("value").isNotNull()).select(
        "feature", "value", F.when(is_current, 0).otherwise(1).alias("ref"), F.when(is_current, 1).otherwise(0).alias("cur"))
    runs = running_sums(sides, ["feature"], "value", ["ref", "cur"])
    totals = runs.groupBy("feature").agg(F.sum("ref").alias("all_ref"), F.sum("cur").alias("all_cur"))
    gap = F.abs(F.col("run_ref") / F.col("all_ref") - F.col("run_cur") / F.col("all_cur"))
    found = runs.join(totals, "feature").groupBy("feature").agg(
        F.max(gap).alias("ks_statistic"), F.max("all_ref").cast("double").alias("n"), F.max("all_cur").cast("double").alias("m"))
    return found.withColumn("ks_p_value", _kolmogorov_p(F.col("ks_statistic"), F.col("n"), F.col("m"))).drop("n", "m")


def feature_drift(long: DataFrame, is_current: Column, threshold: float = 0.05) -> DataFrame:
    """Both drift measures per feature and the verdict."""
    both = ks_test(long, is_current).join(psi(long, is_current), "feature")
    return both.withColumn("drift_detected", (F.col("ks_p_value") < threshold) | (F.col("psi") > PSI_LIMIT))


def last_rows(df: DataFrame, ts: str, row_id: str, n: int = 1000) -> DataFrame:
    """The refreshed reference window: the newest rows."""
    return df.orderBy(F.col(ts).desc(), F.col(row_id).desc()).limit(n)
