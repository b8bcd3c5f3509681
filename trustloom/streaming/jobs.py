"""Streaming forms of the scoring and monitoring jobs.

Every job takes a streaming DataFrame (file source here, any source in production), uses event time with a watermark where it
keeps state, and writes through a checkpointed query. Batch outputs are stored per batch id, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trustloom.operators import mmd, moderation as P, monitoring as M, quality as Q, ranking as K
from trustloom.operators.drift import PSI_LIMIT, SMOOTHING
from trustloom.operators.ordered import group_key, row_numbers

DELAY = "10 minutes"


def source(spark: SparkSession, path: str, ddl: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ddl)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def run(stream: DataFrame, path: str, checkpoint: str, partition_by=()) -> None:
    """Append the stream to a table until the available input is used up."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def store(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def score(requests: DataFrame, results: str, errors: str, checkpoint: str, scorer=None) -> None:
    """Validate, score and analyse requests; rejected ones go to the error table with their reasons.

    ``scorer`` adds ``p_fake`` (for example ``lambda df: learning.predict(model, df)``).
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        judged = Q.judge(batch, Q.request_rules(True)).persist()
        good = judged.where(F.size("reasons") == 0).drop("reasons")
        store(P.analyse(scorer(good) if scorer else good), results, batch_id)
        bad = judged.where(F.size("reasons") > 0)
        store(bad.select("request_id", F.array_join("reasons", "|").alias("reasons")), errors, batch_id)
        judged.unpersist()

    run_batches(requests, handle, checkpoint)


def counters(events: DataFrame, ts: str, kind: str, width: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Events per kind and minute."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), kind, "n")


def trend(scored: DataFrame, ts: str, delay: str = DELAY) -> DataFrame:
    """Analyses and risky items per hour."""
    risky = F.count(F.when(F.col("risk_level").isin("high", "critical"), 1))
    return scored.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour")).agg(
        F.count("*").alias("analyses"), risky.alias("risky")).select(F.col("window.start").alias("start"), "analyses", "risky")


def performance_checks(scored: DataFrame, ts: str, group: str, base: dict[str, float], width: str = "10 minutes",
                       threshold: float = 0.05, delay: str = DELAY) -> DataFrame:
    """Metrics of each closed slot and which of them fell below the baseline."""
    flags = M.outcome_flags(scored.withWatermark(ts, delay))
    sums = [F.sum(c).alias(c) for c in ("_tp", "_fp", "_fn", "_good")]
    slots = flags.groupBy(F.window(ts, width), group).agg(F.count("*").alias("n"), *sums)
    metrics = M.binary_metrics(*map(F.col, ("_tp", "_fp", "_fn", "_good", "n")), min_rows=1)
    low = [F.when((base[m] - F.col(m)) / base[m] > threshold, F.lit(m)) for m in sorted(base)]
    return slots.withColumns(metrics).select(
        F.col("window.start").alias("start"), group, "n", *metrics, F.array_compact(F.array(*low)).alias("degraded_metrics"))


def drift_checks(events: DataFrame, ts: str, value: str, cuts: Sequence[float], shares: Sequence[float], width: str = "30 minutes",
                 limit: float = PSI_LIMIT, delay: str = DELAY) -> DataFrame:
    """Stability index of a value in each closed slot against stored reference shares of the bins between ``cuts``.

    A slot keeps one count per bin, so its state does not grow with the rows. Null values take no part.
    """
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value)))
    rows = events.where(F.col(value).isNotNull()).withWatermark(ts, delay)
    slots = rows.groupBy(F.window(ts, width)).agg(
        F.count("*").alias("n"), *[F.count_if(at == i).alias(f"_b{i}") for i in range(len(shares))])
    gaps = [(F.col(f"_b{i}") / F.col("n") + SMOOTHING, F.lit(s + SMOOTHING)) for i, s in enumerate(shares)]
    index = sum((a - e) * F.log(a / e) for a, e in gaps)
    return slots.select(F.col("window.start").alias("start"), "n", index.alias("psi"), (index > limit).alias("drift"))


def vector_drift_checks(events: DataFrame, ts: str, vector: str, ref: mmd.Reference, width: str = "30 minutes",
                        delay: str = DELAY) -> DataFrame:
    """Distance of the vectors of each closed slot from a stored reference, and whether it is beyond the reference's limit.

    A slot's state is one sum per wave and a count, added up in each task first, so it grows neither with the rows nor with the
    vectors' size. The distance is that of :func:`trustloom.operators.mmd.mmd_drift` between the reference and the slot's rows.
    """
    waves = mmd.wave_values(F.col(vector).cast("array<double>"), ref.frequencies, ref.phase)
    rows = events.where(F.col(vector).isNotNull()).withWatermark(ts, delay).withColumn("_z", waves)
    slots = rows.groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.array(*[
        F.sum(F.get("_z", F.lit(i))) for i in range(len(ref.means))]).alias("_sums"))
    means = F.array(*map(F.lit, ref.means.tolist()))
    gaps = F.zip_with("_sums", means, lambda s, m: (s / F.col("n") - m) * (s / F.col("n") - m))
    distance = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x)
    weight = F.col("n") * ref.n / (F.col("n") + ref.n)
    return slots.withColumn("distance", distance).select(
        F.col("window.start").alias("start"), "n", "distance", (F.col("distance") * weight > ref.limit).alias("drift"))


def drift_events(checks: DataFrame, min_rows: int) -> DataFrame:
    """Rows that ask for retraining because the data have moved."""
    return checks.where((F.col("n") >= min_rows) & F.col("drift")).select(
        "start", F.lit("data_drift").alias("reason"), F.to_json(F.struct("*")).alias("details"))


def retrain_events(checks: DataFrame, min_rows: int) -> DataFrame:
    """Rows that ask for retraining, with reason and details."""
    return checks.where((F.col("n") >= min_rows) & (F.size("degraded_metrics") > 0)).select(
        "start", F.lit("performance_degradation").alias("reason"), F.to_json(F.struct("*")).alias("details"))


def on_retrain(events: DataFrame, table: str, checkpoint: str, callback: Callable[[str, str], None] | None = None) -> None:
    """Append retraining events and call the hook once per event (a handful per batch)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        store(batch, table, batch_id)
        if callback:
            for row in batch.select("reason", "details").toLocalIterator():
                callback(row["reason"], row["details"])

    run_batches(events, handle, checkpoint)


def rolling_performance(scored: DataFrame, group: str, ts: str, row_id: str, results: str, tail: str, checkpoint: str,
                        size: int = M.WINDOW_ROWS) -> None:
    """Last-``size`` metrics per group over arriving batches.

    The newest ``size - 1`` rows of each group are kept between batches in a table, so each batch runs the same sharded
    job as the batch operator and no group's state sits in one task. Rows are taken in order of arrival batch, then time.
    """
    cols = [row_id, group, ts, "y_true", "y_pred"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*cols, F.lit(batch_id).cast("long").alias("arrived"))
        if batch_id:
            rows = rows.unionByName(spark.read.parquet(f"{tail}/batch={batch_id - 1}"))
        rows = rows.persist()
        metrics = M.rolling_performance(rows, [group], ts, row_id, size, "arrived")
        fresh = rows.where(F.col("arrived") == batch_id).select(row_id)
        store(metrics.drop("arrived").join(fresh, row_id, "left_semi").drop("rn"), results, batch_id)
        numbered = row_numbers(rows, [group], ["arrived", ts, row_id]).withColumn("_g", group_key([group]))
        last = numbered.groupBy("_g").agg(F.max("rn").alias("_last"))
        store(numbered.join(last, "_g").where(F.col("rn") > F.col("_last") - (size - 1)).select(*cols, "arrived"), tail, batch_id)
        rows.unpersist()

    run_batches(scored, handle, checkpoint)


def feedback_join(predictions: DataFrame, feedback: DataFrame, bound: str = "48 hours", delay: str = DELAY) -> DataFrame:
    """Predictions with the label that arrives within the bound."""
    p = predictions.withWatermark("ts", delay)
    f = feedback.withWatermark("label_ts", delay)
    late = (F.col("label_ts") >= F.col("ts")) & (F.col("label_ts") <= F.col("ts") + F.expr(f"INTERVAL {bound}"))
    return p.join(f, (p.prediction_id == f.feedback_id) & late)


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Activity sessions per user."""
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("reviews")).select(
        user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "reviews")


def dedupe(stream: DataFrame, key: str, ts: str, delay: str = DELAY) -> DataFrame:
    """Repeated submissions inside the watermark are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def severity(score: Column) -> Column:
    return F.when(score < 0.1, "high").when(score < 0.3, "medium").otherwise("low")


def alerts(scored: DataFrame) -> DataFrame:
    """Alert rows for risky results."""
    risky = scored.where(F.col("risk_level").isin("high", "critical"))
    return risky.withColumn("severity", severity(F.col("authenticity_score")))


def latest_alerts(table: DataFrame, n: int = 10) -> DataFrame:
    """The newest alerts per platform, from the stored table."""
    return K.first_rows(table, ["platform"], [F.col("ts").desc(), F.col("prediction_id").desc()], n)
