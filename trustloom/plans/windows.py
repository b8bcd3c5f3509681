"""Measures that depend on order in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.operators import behaviour as B, monitoring as M, ordered as O, ranking as K
from trustloom.plans.registry import query
from trustloom.plans.views import NOW, r6, round6, with_views
from trustloom.functions import text as X

C = F.col

GAPS_SQL = """gaps AS (SELECT *, (epoch_us(date) - lag(epoch_us(date)) OVER
(PARTITION BY user_id ORDER BY date, review_id)) / 3600000000.0 AS gap_hours FROM reviews_v)"""


def narrow(t):
    return t.reviews().select("review_id", "user_id", "product_id", "rating", "date")


@query("gap_hours", with_views(f"SELECT review_id, {r6('coalesce(gap_hours, -1)')} AS gap_hours FROM gaps",
                               reviews=True, extra=GAPS_SQL))
def gap_hours(t):
    return B.with_gap_hours(narrow(t)).select(
        "review_id", round6(F.coalesce("gap_hours", F.lit(-1.0))).alias("gap_hours"))


ANOMALY_SQL = f"""flagged AS (SELECT *, CASE WHEN date > TIMESTAMP '{NOW}' THEN 'future_date'
WHEN gap_hours < 24 THEN 'too_frequent' END AS kind FROM gaps)"""


@query("temporal_anomalies", with_views(
    "SELECT review_id, kind IS NOT NULL AS temporal_anomaly, kind AS temporal_anomaly_type FROM flagged", reviews=True,
    extra=f"{GAPS_SQL}, {ANOMALY_SQL}"))
def temporal_anomalies(t):
    return B.with_temporal_anomaly(narrow(t), t.now()).select("review_id", "temporal_anomaly", "temporal_anomaly_type")


@query("suspicious_users", with_views(f"""
SELECT user_id, count(*) AS reviews, CAST(count(kind) AS BIGINT) AS anomalies,
       {r6('avg(CASE WHEN rating IN (1, 5) THEN 1 ELSE 0 END)')} AS extreme_share,
       {r6("avg(len(regexp_extract_all(review_text, '[A-Z]')) / (length(review_text) + 1))")} AS uppercase_ratio,
       {r6('avg(length(review_text))')} AS mean_length
FROM flagged GROUP BY user_id""", reviews=True, extra=f"{GAPS_SQL}, {ANOMALY_SQL}"))
def suspicious_users(t):
    out = B.suspicious_users(t.reviews(), t.now())
    return out.withColumns({c: round6(c) for c in ("extreme_share", "uppercase_ratio", "mean_length")})


@query("reviews_same_day", with_views("""
SELECT review_id, count(*) OVER (PARTITION BY user_id, CAST(date AS DATE)) AS reviews_same_day FROM reviews_v""",
                                      reviews=True))
def reviews_same_day(t):
    out = B.with_counts(narrow(t), ["user_id", F.to_date("date")], "reviews_same_day", "review_id")
    return out.select("review_id", "reviews_same_day")


@query("user_review_count", with_views("""
SELECT review_id, count(*) OVER (PARTITION BY user_id) AS user_review_count FROM reviews_v""", reviews=True))
def user_review_count(t):
    return B.with_counts(narrow(t), ["user_id"], "user_review_count", "review_id").select(
        "review_id", "user_review_count")


@query("rating_deviation", with_views(f"""
SELECT review_id, {r6('abs(rating - avg(rating) OVER (PARTITION BY product_id))')} AS rating_deviation
FROM reviews_v""", reviews=True))
def rating_deviation(t):
    return B.with_rating_deviation(narrow(t)).select("review_id", round6("rating_deviation").alias("rating_deviation"))


@query("days_since_first_review", with_views("""
SELECT review_id, CAST(floor((epoch_us(date) - min(epoch_us(date)) OVER (PARTITION BY product_id)) / 86400000000.0)
       AS BIGINT) AS days_since_first_review FROM reviews_v""", reviews=True))
def days_since_first_review(t):
    return B.with_days_since_first(narrow(t)).select("review_id", "days_since_first_review")


ROLLING_SQL = ", ".join(
    f"count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) AS {n}"
    for n, w in B.ROLLING_SECONDS.items())


@query("rolling_activity", f"""
SELECT event_id, {ROLLING_SQL} FROM (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events)""")
def rolling_activity(t):
    rows = t.events().select(C("event_id").alias("review_id"), "user_id", C("ts").alias("date"))
    return B.rolling_activity(rows).select(C("review_id").alias("event_id"), *B.ROLLING_SECONDS)


@query("review_bursts", """
WITH gaps AS (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER
              (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
runs AS (SELECT *, sum(CASE WHEN gap < 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run
         FROM gaps)
SELECT user_id, min(us) AS burst_start, max(us) AS burst_end, count(*) AS reviews FROM runs GROUP BY user_id, run
HAVING count(*) > 1""")
def review_bursts(t):
    rows = t.events().select(C("event_id").alias("review_id"), "user_id", C("ts").alias("date"))
    return B.review_bursts(rows).select("user_id", F.unix_micros("burst_start").alias("burst_start"),
                                        F.unix_micros("burst_end").alias("burst_end"), "reviews")


ROLL_SQL = """counted AS (SELECT *, count(*) OVER w AS n,
  CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tp,
  CAST(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) OVER w AS BIGINT) AS good
  FROM scored_v WINDOW w AS (PARTITION BY platform ORDER BY ts, prediction_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
perf AS (SELECT prediction_id, platform, ts, n,
  CASE WHEN n < 10 OR tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN n < 10 OR tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN n < 10 THEN 0.0 ELSE good / n END AS accuracy,
  CASE WHEN n < 10 OR 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1_score FROM counted)"""


@query("rolling_performance", with_views(f"""
SELECT prediction_id, platform, n AS window_count, {r6('precision')} AS precision, {r6('recall')} AS recall,
       {r6('accuracy')} AS accuracy, {r6('f1_score')} AS f1_score FROM perf""", scored=True, extra=ROLL_SQL))
def rolling_performance(t):
    out = M.rolling_performance(t.scored(), ["platform"], "ts", "prediction_id")
    return out.select("prediction_id", "platform", "window_count", *[round6(c).alias(c) for c in M.METRICS])


BASELINE_SQL = "baseline AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', CAST({v} AS DOUBLE))" for m, v in M.EXAMPLE_BASELINE.items()) + ") b(metric, base))"
LONG_SQL = """metrics AS (UNPIVOT (SELECT platform, slot, n, precision, recall, accuracy, f1_score FROM snap)
ON precision, recall, accuracy, f1_score INTO NAME metric VALUE cur)"""


@query("performance_alerts", with_views(f"""
SELECT platform, slot, max(n) AS window_count, bool_or(base > 0 AND (base - cur) / base > 0.05) AS degraded,
       coalesce(string_agg(metric, '|' ORDER BY metric) FILTER (WHERE base > 0 AND (base - cur) / base > 0.05), '')
       AS degraded_metrics
FROM metrics JOIN baseline USING (metric) WHERE n >= 50 GROUP BY platform, slot""", scored=True, extra=f"""{ROLL_SQL},
snap AS (SELECT * EXCLUDE (k) FROM (SELECT *, epoch_us(ts) // 600000000 AS slot, row_number() OVER (PARTITION BY platform,
  epoch_us(ts) // 600000000 ORDER BY ts DESC, prediction_id DESC) AS k FROM perf) WHERE k = 1), {LONG_SQL},
{BASELINE_SQL}"""))
def performance_alerts(t):
    perf = M.rolling_performance(t.scored(), ["platform"], "ts", "prediction_id")
    snaps = M.periodic_snapshots(perf, ["platform"], "ts", 600)
    out = M.degradation(snaps, ["platform", "slot"], M.baseline(t.spark, M.EXAMPLE_BASELINE), 0.05)
    return out.select("platform", "slot", "window_count", "degraded",
                      F.array_join("degraded_metrics", "|").alias("degraded_metrics"))


@query("last_n_feed", with_views("""
SELECT platform, prediction_id, k AS position FROM (SELECT platform, prediction_id,
  CAST(row_number() OVER (PARTITION BY platform ORDER BY ts DESC, prediction_id DESC) AS BIGINT) AS k FROM scored_v)
WHERE k <= 20""", scored=True))
def last_n_feed(t):
    out = K.first_rows(t.scored().select("platform", "prediction_id", "ts"), ["platform"],
                       [C("ts").desc(), C("prediction_id").desc()], 20)
    return out.select("platform", "prediction_id", C("position").cast("bigint").alias("position"))


@query("sort_user_date", with_views("""
SELECT review_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) AS position FROM reviews_v""",
                                    reviews=True))
def sort_user_date(t):
    out = O.row_numbers(narrow(t), ["user_id"], ["date", "review_id"])
    return out.select("review_id", "user_id", C("rn").cast("bigint").alias("position"))
