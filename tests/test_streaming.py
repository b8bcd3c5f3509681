import datetime as dt

import pytest

from pyspark.sql import functions as F

from trustloom.operators import monitoring as M
from trustloom.plans.views import Tables
from trustloom.session import scratch_path
from trustloom.streaming import jobs as J

DDL = "ts TIMESTAMP, kind STRING"


def feed(spark, path, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped_and_restart_continues(spark):
    path, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    run = lambda: J.run(J.counters(J.source(spark, path, DDL, "parquet"), "ts", "kind"), out, check)
    feed(spark, path, [(at(0), "a"), (at(0), "a"), (at(60), "a")])
    run()
    feed(spark, path, [(at(0), "a"), (at(200), "a")])  # the first one is behind the watermark
    run()
    got = sorted((r["start"], r["n"]) for r in spark.read.parquet(out).collect())
    assert got == [(at(0), 2), (at(60), 1)]


def test_rolling_performance_over_batches_equals_one_batch(spark, small):
    scored = Tables(spark, small).scored().select("prediction_id", "platform", "ts", "y_true", "y_pred")
    path = scratch_path(spark, "in")
    results, tail, check = (scratch_path(spark, n) for n in ("results", "tail", "check"))
    ddl = "prediction_id BIGINT, platform STRING, ts TIMESTAMP, y_true INT, y_pred INT"
    for lo, hi in ((0, 300), (300, 1000)):
        scored.where((F.col("prediction_id") >= lo) & (F.col("prediction_id") < hi)).coalesce(1).write.mode("append").parquet(path)
        J.rolling_performance(J.source(spark, path, ddl, "parquet"), "platform", "ts", "prediction_id", results, tail, check, 50)
    cols = ["prediction_id", "window_count", *M.METRICS]
    got = sorted(map(tuple, spark.read.parquet(results).select(cols).collect()))
    want = sorted(map(tuple, M.rolling_performance(scored, ["platform"], "ts", "prediction_id", 50).select(cols).collect()))
    assert got == want


def test_retrain_callback_runs_per_event(spark):
    path = scratch_path(spark, "in")
    spark.createDataFrame([("2024-01-01", "performance_degradation", "{}")], "start STRING, reason STRING, details STRING").write.parquet(path)
    seen = []
    stream = J.source(spark, path, "start STRING, reason STRING, details STRING", "parquet")
    J.on_retrain(stream, scratch_path(spark, "t"), scratch_path(spark, "c"), lambda reason, details: seen.append(reason))
    assert seen == ["performance_degradation"]


def test_late_row_joins_the_newest_window(spark):
    """Windows hold the last arrivals, so a row that is late by its time still sees the rows that came before it."""
    ddl = "prediction_id BIGINT, platform STRING, ts TIMESTAMP, y_true INT, y_pred INT"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    path = scratch_path(spark, "in")
    results, tail, check = (scratch_path(spark, n) for n in ("results", "tail", "check"))
    for rows in ([(i, "web", at(100 + i), 1, 1) for i in range(200)], [(500, "web", at(0), 1, 0)], [(501, None, at(5), 1, 1)]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
        J.rolling_performance(J.source(spark, path, ddl, "parquet"), "platform", "ts", "prediction_id", results, tail, check, 100)
    got = {r["prediction_id"]: (r["window_count"], r["accuracy"]) for r in spark.read.parquet(results).collect()}
    assert len(got) == 202 and got[500] == (100, 0.99) and got[501][0] == 1


def test_vector_drift_of_a_slot_is_the_batch_statistic(spark, tmp_path):
    """Slots like the reference, a moved slot, null vectors; the distance does not depend on how rows arrive."""
    import numpy as np

    from trustloom.operators import mmd

    rng = np.random.default_rng(3)
    ref_rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 3)))], "id long, v array<double>")
    ref = mmd.reference(ref_rows, "id", "v")
    assert ref.n == 400 and ref.limit > 0
    x = {0: rng.normal(size=(150, 3)), 1: rng.normal(size=(150, 3)) + [1.5, 0, 0]}
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=30 * s, seconds=i), v.tolist()) for s, vs in x.items() for i, v in enumerate(vs)]
    rows += [(start, None), (start + dt.timedelta(days=9), [0.0, 0.0, 0.0])]
    ddl = "ts timestamp, v array<double>"
    spark.createDataFrame(rows[:200], ddl).write.parquet(f"{tmp_path}/in")
    stream = J.source(spark, f"{tmp_path}/in", "`ts` timestamp, `v` array<double>", "parquet")
    out = J.vector_drift_checks(stream, "ts", "v", ref)
    J.run(out, f"{tmp_path}/out", f"{tmp_path}/check")
    spark.createDataFrame(rows[200:], ddl).write.mode("append").parquet(f"{tmp_path}/in")
    J.run(out, f"{tmp_path}/out", f"{tmp_path}/check")  # goes on where the first run stopped
    got = {r.start: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    for s, vs in x.items():
        z = np.cos(vs @ ref.frequencies + ref.phase) * np.sqrt(2 / len(ref.phase))
        row = got[start + dt.timedelta(minutes=30 * s)]
        assert row.n == 150 and row.distance == pytest.approx(((z.mean(0) - ref.means) ** 2).sum())
        assert row.drift == (s == 1)
