"""Rolling model performance, degradation, metric summaries, retraining rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trustloom.operators.ordered import rolling_rows, row_numbers

METRICS = ("precision", "recall", "accuracy", "f1_score")
WINDOW_ROWS = 1000
MIN_ROWS = 10
MIN_CHECK_ROWS = 50
EXAMPLE_BASELINE = {"precision": 0.9, "recall": 0.85, "accuracy": 0.87, "f1_score": 0.875}


def binary_metrics(tp, fp, fn, good, n, min_rows: int = MIN_ROWS) -> dict[str, Column]:
    """Precision, recall, accuracy and F1 from counts; 0 where undefined or with too few rows."""
    ready = n >= min_rows

    def ratio(a, b):
        return F.when(ready & (b > 0), a / b).otherwise(F.lit(0.0))

    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(good, n),
            "f1_score": ratio(2 * tp, 2 * tp + fp + fn)}


def outcome_flags(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    flag = lambda c: F.when(c, 1).otherwise(0)
    y, p = F.col(y), F.col(p)
    return df.withColumns({"_tp": flag((y == 1) & (p == 1)), "_fp": flag((y == 0) & (p == 1)),
                           "_fn": flag((y == 1) & (p == 0)), "_good": flag(y == p)})


def rolling_performance(df: DataFrame, group: list[str], ts: str, row_id: str, size: int = WINDOW_ROWS,
                        arrival: str | None = None) -> DataFrame:
    """Metrics over the last ``size`` predictions of each group, on every prediction.

    Predictions are in order of ``arrival`` (a number), if it is given, then of time and id.
    """
    first = [arrival] if arrival else []
    narrow = outcome_flags(df.select(row_id, *group, ts, *first, "y_true", "y_pred")).drop("y_true", "y_pred")
    numbered = row_numbers(narrow, group, [*first, ts, row_id])
    counts = {c: F.sum(c) for c in ("_tp", "_fp", "_fn", "_good")}
    rolled = rolling_rows(numbered, group, size, {"window_count": F.count("*"), **{
        f"w{c}": agg for c, agg in counts.items()}})
    parts = [F.col(f"w{c}") for c in counts]
    return rolled.select(row_id, *group, ts, "rn", "window_count", *[
        c.alias(name) for name, c in binary_metrics(*parts, F.col("window_count")).items()])


def periodic_snapshots(perf: DataFrame, group: list[str], ts: str, seconds: int) -> DataFrame:
    """The last state inside each slot of ``seconds``."""
    slot = F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).alias("slot")
    last = F.max(F.struct("rn", "window_count", *METRICS)).alias("s")
    return perf.groupBy(*group, slot).agg(last).select(*group, "slot", "s.window_count", *[f"s.{m}" for m in METRICS])


def baseline(spark, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(values.items()), "metric STRING, base DOUBLE")


def degradation(metrics: DataFrame, keys: list[str], base: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Which metrics fell by more than the threshold share of their baseline; needs enough rows in the window."""
    long = metrics.where(F.col("window_count") >= MIN_CHECK_ROWS).unpivot(
        [*keys, "window_count"], list(METRICS), "metric", "current")
    drop = F.when(F.col("base") > 0, (F.col("base") - F.col("current")) / F.col("base"))
    judged = long.join(F.broadcast(base), "metric").withColumn("_drop", drop)
    bad = F.coalesce(F.col("_drop") > threshold, F.lit(False))
    return judged.groupBy(*keys).agg(
        F.max("window_count").alias("window_count"), F.bool_or(bad).alias("degraded"),
        F.array_sort(F.collect_list(F.when(bad, F.col("metric")))).alias("degraded_metrics"))


def metric_summary(samples: DataFrame) -> DataFrame:
    """Counters are summed, gauges keep the last value, histograms give count, sum, mean, least and greatest.

    ``samples`` has ``ts, name, labels MAP, kind, value``; labels are compared by their sorted entries.
    """
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))).alias("labels")
    value = F.col("value")
    hist = lambda c: F.when(F.col("kind") == "histogram", c)
    return samples.select("ts", "name", "kind", key, "value").groupBy("name", "labels", "kind").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"),
        F.max("value").alias("greatest"), F.max_by("value", F.struct("ts", "value")).alias("last"),
    ).select("name", "labels", "kind", "n",
             F.when(F.col("kind") == "gauge", F.col("last")).otherwise(F.col("total")).alias("value"),
             hist(F.col("total") / F.col("n")).alias("mean"), hist(F.col("least")).alias("least"),
             hist(F.col("greatest")).alias("greatest"))


def retraining_reasons(metrics: DataFrame, drift: DataFrame, labels: DataFrame, model_age_days: Column,
                       min_f1: float = 0.90, max_age_days: int = 30, min_new_labels: int = 1000) -> DataFrame:
    """Which rules ask for retraining: low F1, drift, age, enough new labels.

    ``metrics(model, f1_score)``, ``drift(model, drift)`` and ``labels(model, new_labels)`` have one row per model.
    """
    rules = F.array_compact(F.array(
        F.when(F.col("f1_score") < min_f1, F.lit("performance")), F.when(F.col("drift"), F.lit("drift")),
        F.when(model_age_days >= max_age_days, F.lit("schedule")),
        F.when(F.col("new_labels") >= min_new_labels, F.lit("new_labels"))))
    return metrics.join(drift, "model", "left").join(labels, "model", "left").select(
        "model", F.explode(rules).alias("reason"))


def collection_stats(items: DataFrame) -> DataFrame:
    """Items by platform, by content type, by label (unlabelled items left out) and in all, from one pass."""
    label = F.when(F.col("is_fake") == 1, "fake").when(F.col("is_fake") == 0, "authentic")
    rows = items.select("platform", "content_type", label.alias("label"), "is_fake", "n")
    cube = rows.groupingSets([["platform"], ["content_type"], ["label"], []], "platform", "content_type", "label").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("items"), F.count("is_fake").alias("labelled"),
        F.avg("n").alias("mean_length"))
    cuts = {3: ("platform", F.col("platform")), 5: ("content_type", F.col("content_type")), 6: ("label", F.col("label"))}
    cut, value = F.lit("total"), F.lit("all")
    for gid, (name, col) in cuts.items():
        cut, value = F.when(F.col("gid") == gid, name).otherwise(cut), F.when(F.col("gid") == gid, col).otherwise(value)
    return cube.select(cut.alias("cut"), value.alias("value"), "items",
                       (F.col("labelled") * 100.0 / F.col("items")).alias("labelled_percent"), "mean_length"
                       ).where(F.col("value").isNotNull())
