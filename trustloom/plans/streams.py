"""Streaming jobs run to the end of input landed from the tables; each result must equal its batch form.

The landed input ends with one row far in the future, which closes every real window; that row's own window stays open.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trustloom.operators import mmd, monitoring as M
from trustloom.functions import risk as R
from trustloom.plans.aggregates import LEVELS_SQL, RISKY, scored_levels
from trustloom.plans.quality import COMMON_RULES_SQL, FAULTY_SQL, faulty, quoted
from trustloom.plans.registry import query
from trustloom.plans.scalars import AUTH_SQL, level_sql
from trustloom.plans.views import r6, round6, with_views
from trustloom.plans.windows import ROLL_SQL
from trustloom.session import scratch_path
from trustloom.streaming import jobs as J

C = F.col
FAR = "2100-01-01 00:00:00"


def landed(t, df, close_with=None, ts="ts"):
    """Write ``df`` as the stream's input, with the closing row if the job has windows to close."""
    path = scratch_path(t.spark, "stream-in")
    if close_with:
        last = t.spark.range(1).select(*[
            (F.lit(FAR).cast("timestamp") if c == ts else F.lit(close_with.get(c)).cast(df.schema[c].dataType)).alias(c)
            for c in df.columns])
        df = df.unionByName(last)
    df.write.parquet(path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return J.source(t.spark, path, ddl, "parquet")


def finished(t, stream):
    path = scratch_path(t.spark, "stream-out")
    J.run(stream, path, scratch_path(t.spark, "stream-checkpoint"))
    return t.spark.read.schema(stream.schema).parquet(path)


@query("stream_source", "SELECT event_id, event_type, value FROM events")
def stream_source(t):
    path = scratch_path(t.spark, "stream-json")
    t.base("events").select("event_id", "event_type", "value").write.json(path)
    return finished(t, J.source(t.spark, path, "event_id BIGINT, event_type STRING, value DOUBLE"))


ENHANCED_SQL = f"""judged AS (SELECT *, concat_ws('|', {COMMON_RULES_SQL}, CASE WHEN platform NOT IN ({quoted(R.PLATFORMS)}) THEN
 'platform' END, CASE WHEN content_type NOT IN ({quoted(R.CONTENT_TYPES)}) THEN 'content_type' END,
 CASE WHEN account_age_days < 0 THEN 'account_age_days' END,
 CASE WHEN profile_completeness NOT BETWEEN 0 AND 1 THEN 'profile_completeness' END) AS reasons FROM faulty)"""


def scored_stream(t):
    results, errors = scratch_path(t.spark, "results"), scratch_path(t.spark, "errors")
    J.score(landed(t, faulty(t)), results, errors, scratch_path(t.spark, "stream-checkpoint"))
    return t.spark.read.parquet(results), t.spark.read.parquet(errors)


@query("stream_score", with_views(f"SELECT request_id, {r6(AUTH_SQL)} AS authenticity_score, {level_sql(AUTH_SQL)} AS risk_level "
                                  "FROM judged WHERE reasons = ''", scored=True, extra=f"{FAULTY_SQL}, {ENHANCED_SQL}"))
def stream_score(t):
    return scored_stream(t)[0].select("request_id", round6("authenticity_score").alias("authenticity_score"), "risk_level")


@query("stream_sink", with_views("SELECT 'result' AS event, request_id, '' AS reasons FROM judged WHERE reasons = '' UNION ALL "
                                 "SELECT 'error', request_id, reasons FROM judged WHERE reasons <> ''", scored=True,
                                 extra=f"{FAULTY_SQL}, {ENHANCED_SQL}"))
def stream_sink(t):
    good, bad = scored_stream(t)
    return good.select(F.lit("result").alias("event"), "request_id", F.lit("").alias("reasons")).unionByName(
        bad.select(F.lit("error").alias("event"), "request_id", "reasons"))


@query("stream_counters", """SELECT epoch_us(date_trunc('minute', ts)) // 1000000 AS start, event_type, count(*) AS n FROM events
GROUP BY 1, 2""")
def stream_counters(t):
    rows = landed(t, t.events().select("ts", "event_type"), {"event_type": "view"})
    out = finished(t, J.counters(rows, "ts", "event_type"))
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("stream_trend", with_views(f"""SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS start, count(*) AS analyses,
 count(*) FILTER (WHERE {RISKY}) AS risky FROM levels GROUP BY 1""", scored=True, extra=LEVELS_SQL))
def stream_trend(t):
    rows = landed(t, scored_levels(t).select("ts", "risk_level"), {"risk_level": "low"})
    return finished(t, J.trend(rows, "ts")).select(F.unix_seconds("start").alias("start"), "analyses", "risky")


@query("stream_sessions", """
WITH g AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap
 FROM events), s AS (SELECT *, sum(CASE WHEN gap < 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g)
SELECT user_id, min(us) AS start, max(us) + 1800000000 AS end_us, count(*) AS reviews FROM s GROUP BY user_id, k""")
def stream_sessions(t):
    rows = landed(t, t.events().select("ts", "user_id"), {"user_id": 0})
    out = finished(t, J.sessions(rows, "user_id", "ts"))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end_us"), "reviews")


CHECKS_SQL = """slots AS (SELECT platform, epoch_us(ts) // 600000000 * 600 AS start, count(*) AS n, CAST(sum(y_true * y_pred) AS DOUBLE)
 AS tp, CAST(sum((1 - y_true) * y_pred) AS DOUBLE) AS fp, CAST(sum(y_true * (1 - y_pred)) AS DOUBLE) AS fn,
 CAST(sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS DOUBLE) AS good FROM scored_v GROUP BY 1, 2),
checks AS (SELECT platform, start, n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN
 tp / (tp + fn) ELSE 0.0 END AS r, good / n AS a, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f
 FROM slots),
low AS (SELECT *, concat_ws('|', CASE WHEN (0.87 - a) / 0.87 > 0.05 THEN 'accuracy' END, CASE WHEN (0.875 - f) / 0.875 > 0.05 THEN
 'f1_score' END, CASE WHEN (0.9 - p) / 0.9 > 0.05 THEN 'precision' END, CASE WHEN (0.85 - r) / 0.85 > 0.05 THEN 'recall' END) AS
 degraded_metrics FROM checks)"""


def check_stream(t):
    rows = t.scored().select("ts", "platform", "y_true", "y_pred")
    return J.performance_checks(landed(t, rows, {"platform": "general", "y_true": 0, "y_pred": 0}), "ts", "platform",
                                M.EXAMPLE_BASELINE)


@query("stream_periodic_checks", with_views("SELECT platform, start, n, degraded_metrics FROM low", scored=True, extra=CHECKS_SQL))
def stream_periodic_checks(t):
    out = finished(t, check_stream(t))
    return out.select("platform", F.unix_seconds("start").alias("start"), "n",
                      F.array_join("degraded_metrics", "|").alias("degraded_metrics"))


@query("stream_retrain_events", with_views("""SELECT start, 'performance_degradation' AS reason, platform FROM low
WHERE n >= 2 AND degraded_metrics <> ''""", scored=True, extra=CHECKS_SQL))
def stream_retrain_events(t):
    table = scratch_path(t.spark, "retrain")
    J.on_retrain(J.retrain_events(check_stream(t), 2), table, scratch_path(t.spark, "stream-checkpoint"))
    out = t.spark.read.parquet(table)
    return out.select(F.unix_seconds("start").alias("start"), "reason",
                      F.get_json_object("details", "$.platform").alias("platform"))


# The stored reference of the drift check: five equal shares of a probability.
CUTS, SHARES = [0.2, 0.4, 0.6, 0.8], [0.2] * 5
DRIFT_SQL = """drift AS (SELECT epoch_us(ts) // 1800000000 * 1800 AS start, count(*) AS n, """ + " + ".join(
    f"((count(*) FILTER (WHERE p_fake >= {lo} AND p_fake < {hi})) / count(*) + 1e-6 - 0.200001) * ln(((count(*) FILTER (WHERE "
    f"p_fake >= {lo} AND p_fake < {hi})) / count(*) + 1e-6) / 0.200001)" for lo, hi in zip([-1, *CUTS], [*CUTS, 2])) + """ AS psi
FROM scored_v GROUP BY 1)"""


def drift_stream(t):
    rows = landed(t, t.scored().select("ts", "p_fake"), {"p_fake": 0.0})
    return J.drift_checks(rows, "ts", "p_fake", CUTS, SHARES)


@query("stream_drift_checks", with_views(f"SELECT start, n, {r6('psi')} AS psi, psi > 0.25 AS drift FROM drift", scored=True, extra=DRIFT_SQL))
def stream_drift_checks(t):
    return finished(t, drift_stream(t)).select(F.unix_seconds("start").alias("start"), "n", round6("psi").alias("psi"), "drift")


@query("stream_drift_events", with_views("SELECT start, 'data_drift' AS reason, n FROM drift WHERE psi > 0.25 AND n >= 5", scored=True,
                                         extra=DRIFT_SQL))
def stream_drift_events(t):
    table = scratch_path(t.spark, "retrain")
    J.on_retrain(J.drift_events(drift_stream(t), 5), table, scratch_path(t.spark, "stream-checkpoint"))
    return t.spark.read.parquet(table).select(
        F.unix_seconds("start").alias("start"), "reason", F.get_json_object("details", "$.n").cast("bigint").alias("n"))


VECTOR = ("value", "hour(ts)", "minute(ts)")


def vector_drift_sql():
    """The batch statistic of every slot, wave by wave; the waves are drawn as the operator draws them."""
    rng = np.random.default_rng(42)
    freq, phase = rng.normal(size=(len(VECTOR), mmd.FREQUENCIES)), rng.uniform(0, 2 * np.pi, mmd.FREQUENCIES)
    wave = lambda j: "avg(cos((" + " + ".join(f"x{i} * ({float(freq[i, j])!r})" for i in range(len(VECTOR))) + (
        f") / bandwidth + {float(phase[j])!r})) * {float(np.sqrt(2 / mmd.FREQUENCIES))!r} AS w{j}")
    waves = ", ".join(map(wave, range(mmd.FREQUENCIES)))
    gaps = " + ".join(f"(s.w{j} - r.w{j}) * (s.w{j} - r.w{j})" for j in range(mmd.FREQUENCIES))
    columns = ", ".join(f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(VECTOR))
    return f"""WITH v AS (SELECT event_id, epoch_us(ts) // 1800000000 * 1800 AS start, {columns} FROM events WHERE value IS NOT NULL),
ref AS (SELECT * FROM v WHERE event_id % 4 = 0),
b AS (SELECT sqrt({' + '.join(f'var_pop(x{i})' for i in range(len(VECTOR)))}) AS bandwidth FROM ref),
r AS (SELECT {waves} FROM ref, b), s AS (SELECT start, count(*) AS n, {waves} FROM v, b GROUP BY 1)
SELECT start, n, {r6(gaps)} AS distance FROM s, r"""


@query("stream_vector_drift", vector_drift_sql())
def stream_vector_drift(t):
    events = t.events().where("value IS NOT NULL").select("event_id", "ts", F.array(*[F.expr(e).cast("double") for e in VECTOR]).alias("v"))
    ref = mmd.reference(events.where("event_id % 4 = 0"), "event_id", "v")
    path = landed(t, events.select("ts", "v"), {"v": [0.0, 0.0, 0.0]})
    return finished(t, J.vector_drift_checks(path, "ts", "v", ref)).select(
        F.unix_seconds("start").alias("start"), "n", round6("distance").alias("distance"))


@query("stream_rolling_performance", with_views(f"""
SELECT prediction_id, platform, n AS window_count, {r6('precision')} AS precision, {r6('accuracy')} AS accuracy FROM perf""",
                                                scored=True, extra=ROLL_SQL))
def stream_rolling_performance(t):
    names = ("results", "tail", "stream-checkpoint")
    results, tail, check = (scratch_path(t.spark, n) for n in names)
    rows = landed(t, t.scored().select("prediction_id", "platform", "ts", "y_true", "y_pred"))
    J.rolling_performance(rows, "platform", "ts", "prediction_id", results, tail, check)
    return t.spark.read.parquet(results).select("prediction_id", "platform", "window_count",
                                                *[round6(c).alias(c) for c in ("precision", "accuracy")])


@query("stream_feedback_join", with_views("""
SELECT prediction_id, y_pred, y_true AS label FROM scored_v WHERE prediction_id % 3 = 0 AND prediction_id % 60 <= 48""", scored=True))
def stream_feedback_join(t):
    p = t.scored().select("prediction_id", "y_pred", "ts")
    late = t.scored().where(C("prediction_id") % 3 == 0).select(
        C("prediction_id").alias("feedback_id"), C("y_true").alias("label"),
        (C("ts") + F.expr("make_dt_interval(0, CAST(prediction_id % 60 AS INT))")).alias("label_ts"))
    out = finished(t, J.feedback_join(landed(t, p), landed(t, late)))
    return out.select("prediction_id", "y_pred", "label")


@query("stream_dedupe", "SELECT event_id FROM events")
def stream_dedupe(t):
    rows = t.events().select("event_id", "ts")
    again = rows.where(C("event_id") % 3 == 0).withColumn("ts", C("ts") + F.expr("INTERVAL 1 MINUTE"))
    return finished(t, J.dedupe(landed(t, rows.unionByName(again)), "event_id", "ts")).select("event_id")


@query("stream_alerts", with_views(f"""
SELECT platform, prediction_id, severity FROM (SELECT *, CASE WHEN score < 0.1 THEN 'high' WHEN score < 0.3 THEN 'medium' ELSE 'low'
 END AS severity, row_number() OVER (PARTITION BY platform ORDER BY ts DESC, prediction_id DESC) AS k FROM levels WHERE {RISKY})
WHERE k <= 10""", scored=True, extra=LEVELS_SQL))
def stream_alerts(t):
    rows = landed(t, scored_levels(t).select("prediction_id", "platform", "ts", "risk_level", "authenticity_score"))
    return J.latest_alerts(finished(t, J.alerts(rows))).select("platform", "prediction_id", "severity")
