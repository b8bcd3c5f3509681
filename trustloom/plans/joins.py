"""Joins of reviews with statistics, scores, feedback and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import risk as R
from trustloom.operators import behaviour as B, features as X, moderation as P
from trustloom.plans.registry import query
from trustloom.plans.scalars import AUTH_SQL, level_sql
from trustloom.plans.views import NOW, r6, round6, with_views
from trustloom.plans.windows import GAPS_SQL

C = F.col


def stats_sql(key: str) -> str:
    return f"""SELECT {key}, count(*) AS rating_count, avg(rating) AS rating_mean,
 coalesce(stddev_samp(rating), 0.0) AS rating_std, avg(length(review_text)) AS length_mean,
 coalesce(stddev_samp(length(review_text)), 0.0) AS length_std FROM reviews_v GROUP BY {key}"""


def joined_stats_sql(key: str, prefix: str) -> str:
    cols = ", ".join(f"{r6('s.' + c)} AS {prefix}_{c}" for c in ("rating_mean", "rating_std", "length_mean", "length_std"))
    return with_views(f"""SELECT v.review_id, s.rating_count AS {prefix}_rating_count, {cols}
FROM reviews_v v LEFT JOIN s USING ({key})""", reviews=True, extra=f"s AS ({stats_sql(key)})")


def joined_stats(t, key, prefix):
    out = B.with_key_stats(t.reviews(), key, prefix)
    names = [f"{prefix}_{c}" for c in ("rating_mean", "rating_std", "length_mean", "length_std")]
    return out.select("review_id", f"{prefix}_rating_count", *[round6(n).alias(n) for n in names])


@query("join_user_stats", joined_stats_sql("user_id", "user"))
def join_user_stats(t):
    return joined_stats(t, "user_id", "user")


@query("join_product_stats", joined_stats_sql("product_id", "product"))
def join_product_stats(t):
    return joined_stats(t, "product_id", "product")


ITEM_SQL = f"""items AS (SELECT prediction_id, ts, CASE WHEN {AUTH_SQL} < 0.3 THEN 'held' ELSE 'published' END AS status
 FROM scored_v), scores AS (SELECT prediction_id, {level_sql(AUTH_SQL)} AS risk_level FROM scored_v WHERE prediction_id % 5 <> 0)"""
RECENT = f"ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"


def items(t):
    score = R.authenticity(C("p_fake"))
    return t.scored().select("prediction_id", "ts", F.when(score < R.HOLD_BELOW, "held").otherwise("published").alias("status"))


def scores(t):
    return t.scored().where(C("prediction_id") % 5 != 0).select(
        "prediction_id", R.risk_level(R.authenticity(C("p_fake"))).alias("risk_level"))


@query("recent_analysed", with_views(f"""
SELECT count(*) AS analyzed FROM scores WHERE prediction_id IN (SELECT prediction_id FROM items WHERE {RECENT})""",
                                     scored=True, extra=ITEM_SQL))
def recent_analysed(t):
    return P.recent_analysed(items(t), scores(t), "prediction_id", "ts", t.now()).agg(F.count("*").alias("analyzed"))


@query("recent_high_risk", with_views(f"""
SELECT prediction_id, risk_level FROM scores JOIN items USING (prediction_id) WHERE risk_level IN ('high', 'critical')
AND {RECENT}""", scored=True, extra=ITEM_SQL))
def recent_high_risk(t):
    return P.recent_high_risk(items(t), scores(t), "prediction_id", "ts", t.now()).select("prediction_id", "risk_level")


@query("recent_moderated", with_views(f"""
SELECT prediction_id FROM items WHERE status = 'held' AND {RECENT} AND prediction_id IN (SELECT prediction_id FROM scores)""",
                                      scored=True, extra=ITEM_SQL))
def recent_moderated(t):
    return P.recent_moderated(items(t), scores(t), "prediction_id", "ts", t.now()).select("prediction_id")


@query("site_stats", with_views(f"""
SELECT count(*) AS analyzed, count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high_risk,
 count(*) FILTER (WHERE status = 'held') AS moderated FROM items JOIN scores USING (prediction_id) WHERE {RECENT}""",
                               scored=True, extra=ITEM_SQL))
def site_stats(t):
    return P.site_stats(items(t), scores(t), "prediction_id", "ts", t.now())


@query("flagged_queue", with_views(f"""
SELECT v.prediction_id AS review_id, v.risk_level, c.c_name AS user_name, c.c_mktsegment AS user_segment,
 s.s_name AS business_name FROM (SELECT *, {level_sql(AUTH_SQL)} AS risk_level, prediction_id % 100 AS product_id FROM scored_v) v
LEFT JOIN customer c ON c.c_custkey = v.user_id LEFT JOIN supplier s ON s.s_suppkey = v.product_id
WHERE v.risk_level IN ('high', 'critical')""", scored=True))
def flagged_queue(t):
    level = R.risk_level(R.authenticity(C("p_fake")))
    rows = t.scored().select(
        C("prediction_id").alias("review_id"), "user_id", (C("prediction_id") % 100).alias("product_id"),
        C("ts").alias("date"), level.alias("risk_level"), R.review_status(level).alias("status"))
    people = t.base("customer").select(C("c_custkey").alias("user_id"), C("c_name").alias("user_name"),
                                       C("c_mktsegment").alias("user_segment"))
    shops = t.base("supplier").select(C("s_suppkey").alias("product_id"), C("s_name").alias("business_name"))
    return P.flagged_queue(rows, shops, people).select("review_id", "risk_level", "user_name", "user_segment",
                                                       "business_name")


@query("join_predictions_feedback", with_views("""
SELECT p.prediction_id, p.y_pred, f.label, epoch_us(f.ts) - epoch_us(p.ts) AS delay FROM scored_v p JOIN (SELECT prediction_id,
 y_true AS label, ts + INTERVAL 1 HOUR * (prediction_id % 48) AS ts FROM scored_v WHERE prediction_id % 3 = 0) f USING
 (prediction_id)""", scored=True))
def join_predictions_feedback(t):
    late = t.scored().where(C("prediction_id") % 3 == 0).select(
        "prediction_id", C("y_true").alias("label"),
        (C("ts") + F.expr("make_dt_interval(0, CAST(prediction_id % 48 AS INT))")).alias("label_ts"))
    out = P.join_feedback(t.scored().select("prediction_id", "y_pred", "ts"), late)
    return out.select("prediction_id", "y_pred", "label",
                      (F.unix_micros("label_ts") - F.unix_micros("ts")).alias("delay"))


@query("assemble_behaviour", with_views(f"""
SELECT v.review_id, u.n AS rating_count, floor(u.m * 1e4 + 0.5) / 1e4 AS rating_mean, {r6('coalesce(g.a, 0)')} AS avg_time_between_reviews,
 coalesce(g.c, 0) AS reviews_in_24_hours, d.degree AS neighbor_count
FROM reviews_v v LEFT JOIN u USING (user_id) LEFT JOIN g USING (user_id) LEFT JOIN d USING (user_id)""", reviews=True,
                                        extra=f"""{GAPS_SQL},
u AS (SELECT user_id, count(rating) AS n, avg(rating) AS m FROM reviews_v GROUP BY user_id),
g AS (SELECT user_id, avg(gap_hours) AS a, count(*) FILTER (WHERE gap_hours < 24) AS c FROM gaps GROUP BY user_id),
d AS (SELECT user_id, count(DISTINCT product_id) AS degree FROM reviews_v GROUP BY user_id)"""))
def assemble_behaviour(t):
    out = X.assemble_behaviour(t.reviews())
    return out.select("review_id", "rating_count", "rating_mean",
                      round6("avg_time_between_reviews").alias("avg_time_between_reviews"), "reviews_in_24_hours",
                      "neighbor_count")
