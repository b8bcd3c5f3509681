"""Filters and validation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import risk as R
from trustloom.operators import moderation as P, quality as Q, ranking as K
from trustloom.plans.registry import query
from trustloom.plans.scalars import AUTH_SQL, REQUESTS_SQL, level_sql, quoted, requests
from trustloom.plans.views import r6, round6, with_views

C = F.col

# raw reviews: some ids repeat, some ratings and texts are missing or out of range
RAW_SQL = """raw AS (SELECT review_id AS row_no, review_id - review_id % 3 % 2 AS review_id,
 CASE WHEN review_id % 17 = 0 THEN NULL WHEN review_id % 19 = 0 THEN 'short' ELSE review_text END AS review_text,
 CASE WHEN review_id % 23 = 0 THEN NULL WHEN review_id % 29 = 0 THEN CAST(9 AS DOUBLE) ELSE rating END AS rating, user_id,
 product_id FROM reviews_v)"""


def raw(t):
    rid = C("review_id")
    return t.reviews().select(
        rid.alias("row_no"), (rid - rid % 3 % 2).alias("review_id"),
        F.when(rid % 17 == 0, None).when(rid % 19 == 0, "short").otherwise(C("review_text")).alias("review_text"),
        F.when(rid % 23 == 0, None).when(rid % 29 == 0, 9.0).otherwise(C("rating")).alias("rating"), "user_id", "product_id")


PASS_SQL = "review_text IS NOT NULL AND length(review_text) BETWEEN 10 AND 5000 AND rating BETWEEN 1 AND 5"


@query("validate_reviews", with_views(f"""
SELECT review_id, row_no, rating FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY row_no) AS k FROM raw
WHERE {PASS_SQL}) WHERE k = 1""", reviews=True, extra=RAW_SQL))
def validate_reviews(t):
    return Q.validate_reviews(raw(t), "row_no").select("review_id", "row_no", "rating")


BUSINESS_SQL = """biz AS (SELECT p_partkey AS row_no, CASE WHEN p_partkey % 31 <> 0 THEN p_partkey // 2 END AS business_id,
CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name FROM part)"""


@query("validate_businesses", with_views("""
SELECT business_id, name FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY row_no) AS k FROM biz)
WHERE k = 1 AND business_id IS NOT NULL AND name IS NOT NULL""", extra=BUSINESS_SQL))
def validate_businesses(t):
    pk = C("p_partkey")
    biz = t.base("part").select(pk.alias("row_no"), F.when(pk % 31 != 0, F.expr("p_partkey div 2")).alias("business_id"),
                                F.when(pk % 5 != 0, C("p_name")).alias("name"))
    return Q.validate_businesses(biz, "row_no").select("business_id", "name")


@query("validate_users", """
SELECT user_id, name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_no) AS k FROM (SELECT c_custkey AS
row_no, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey // 3 END AS user_id, c_name AS name FROM customer))
WHERE k = 1 AND user_id IS NOT NULL""")
def validate_users(t):
    ck = C("c_custkey")
    users = t.base("customer").select(ck.alias("row_no"), F.when(ck % 7 != 0, F.expr("c_custkey div 3")).alias("user_id"),
                                      C("c_name").alias("name"))
    return Q.validate_users(users, "row_no").select("user_id", "name")


@query("validation_report", with_views(f"""
SELECT 'review' AS data_type, count(*) AS rows_before, count(DISTINCT CASE WHEN {PASS_SQL} THEN review_id END) AS rows_after,
 count(*) - count(DISTINCT CASE WHEN {PASS_SQL} THEN review_id END) AS removed,
 count(*) FILTER (WHERE review_text IS NULL) AS broken_text_missing,
 count(*) FILTER (WHERE NOT coalesce(length(review_text) BETWEEN 10 AND 5000, false)) AS broken_text_length,
 count(*) FILTER (WHERE rating IS NULL) AS broken_rating_missing,
 count(*) FILTER (WHERE NOT coalesce(rating BETWEEN 1 AND 5, false)) AS broken_rating_range FROM raw""", reviews=True,
                                       extra=RAW_SQL))
def validation_report(t):
    rows = raw(t)
    return Q.validation_report(rows, Q.review_rules(rows), "review", "review_id")


@query("handle_missing_text", with_views("""
SELECT 'drop' AS strategy, row_no, review_text FROM raw WHERE review_text IS NOT NULL
UNION ALL SELECT 'fill', row_no, coalesce(review_text, '') FROM raw
UNION ALL SELECT 'keep', row_no, review_text FROM raw""", reviews=True, extra=RAW_SQL))
def handle_missing_text(t):
    parts = [Q.handle_missing_text(raw(t), "review_text", s).select(F.lit(s).alias("strategy"), "row_no", "review_text")
             for s in ("drop", "fill", "keep")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# requests with planted faults
FAULTY_SQL = f"""{REQUESTS_SQL}, faulty AS (SELECT request_id,
 CASE WHEN request_id % 37 = 0 THEN '  ' WHEN request_id % 41 = 0 THEN repeat('x', 10001) ELSE text END AS text,
 CASE WHEN request_id % 43 = 0 THEN 'radio' ELSE platform END AS platform,
 CASE WHEN request_id % 47 = 0 THEN 'song' ELSE content_type END AS content_type, analysis_mode,
 CASE WHEN request_id % 53 = 0 THEN repeat('u', 101) ELSE user_id END AS user_id,
 CASE WHEN request_id % 59 = 0 THEN -1 ELSE account_age_days END AS account_age_days, total_reviews,
 CASE WHEN request_id % 61 = 0 THEN CAST(1.5 AS DOUBLE) ELSE profile_completeness END AS profile_completeness,
 CASE WHEN request_id % 67 = 0 THEN CAST(7 AS DOUBLE) ELSE rating END AS rating,
 CASE WHEN request_id % 71 = 0 THEN 'yesterday' WHEN request_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
      WHEN request_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp, p_fake FROM requests)"""


def faulty(t):
    r = C("request_id")
    return requests(t).select(
        "request_id", F.when(r % 37 == 0, "  ").when(r % 41 == 0, F.repeat(F.lit("x"), 10001)).otherwise(C("text")).alias("text"),
        F.when(r % 43 == 0, "radio").otherwise(C("platform")).alias("platform"),
        F.when(r % 47 == 0, "song").otherwise(C("content_type")).alias("content_type"), "analysis_mode",
        F.when(r % 53 == 0, F.repeat(F.lit("u"), 101)).otherwise(C("user_id")).alias("user_id"),
        F.when(r % 59 == 0, -1).otherwise(C("account_age_days")).alias("account_age_days"), "total_reviews",
        F.when(r % 61 == 0, 1.5).otherwise(C("profile_completeness")).alias("profile_completeness"),
        F.when(r % 67 == 0, 7.0).otherwise(C("rating")).alias("rating"),
        F.when(r % 71 == 0, "yesterday").when(r % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(r % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), "p_fake", "item_id")


COMMON_RULES_SQL = """CASE WHEN trim(text) = '' THEN 'text_empty' END, CASE WHEN length(text) > 10000 THEN 'text_too_long' END,
 CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating_range' END"""


@query("validate_requests", with_views(f"""
SELECT request_id, concat_ws('|', {COMMON_RULES_SQL}, CASE WHEN length(user_id) > 100 THEN 'user_id_too_long' END,
 CASE WHEN timestamp = 'yesterday' THEN 'timestamp_format' END) AS reasons FROM faulty""", scored=True, extra=FAULTY_SQL))
def validate_requests(t):
    return Q.judge(faulty(t), Q.request_rules()).select("request_id", F.array_join("reasons", "|").alias("reasons"))


@query("validate_enhanced_requests", with_views(f"""
SELECT request_id, concat_ws('|', {COMMON_RULES_SQL}, CASE WHEN platform NOT IN ({quoted(R.PLATFORMS)}) THEN 'platform' END,
 CASE WHEN content_type NOT IN ({quoted(R.CONTENT_TYPES)}) THEN 'content_type' END,
 CASE WHEN account_age_days < 0 THEN 'account_age_days' END,
 CASE WHEN profile_completeness NOT BETWEEN 0 AND 1 THEN 'profile_completeness' END) AS reasons FROM faulty""",
                                                scored=True, extra=FAULTY_SQL))
def validate_enhanced_requests(t):
    return Q.judge(faulty(t), Q.request_rules(True)).select("request_id", F.array_join("reasons", "|").alias("reasons"))


@query("validate_batch_size", """
SELECT conv_id, count(*) AS items, count(*) BETWEEN 1 AND 100 AS texts_ok, count(*) BETWEEN 1 AND 1000 AS items_ok
FROM conversations GROUP BY conv_id""")
def validate_batch_size(t):
    n = t.base("conversations").groupBy("conv_id").agg(F.count("*").alias("items"))
    return n.select("conv_id", "items", Q.batch_size_ok(C("items"), Q.MAX_TEXTS).alias("texts_ok"),
                    Q.batch_size_ok(C("items"), Q.MAX_ITEMS).alias("items_ok"))


@query("validate_schema", """
SELECT 'reviews' AS table_name, '' AS problems UNION ALL SELECT 'events', 'missing column review_text'""")
def validate_schema(t):
    rows = [("reviews", "|".join(Q.schema_problems(t.reviews(), ["review_text", "rating"], 10))),
            ("events", "|".join(Q.schema_problems(t.events(), ["user_id", "review_text"], 10)))]
    return t.spark.createDataFrame(rows, "table_name STRING, problems STRING")


@query("filter_by_score", with_views(f"SELECT prediction_id, {r6(AUTH_SQL)} AS score FROM scored_v WHERE {AUTH_SQL} >= 0.7",
                                     scored=True))
def filter_by_score(t):
    rows = t.scored().select("prediction_id", R.authenticity(C("p_fake")).alias("score"))
    return rows.where(C("score") >= 0.7).select("prediction_id", round6("score").alias("score"))


@query("moderation_hold", with_views(f"""
SELECT prediction_id, CASE WHEN {AUTH_SQL} < 0.3 THEN 'hold' WHEN {AUTH_SQL} < 0.7 THEN 'block' ELSE 'publish' END AS action
FROM scored_v""", scored=True))
def moderation_hold(t):
    return t.scored().select("prediction_id", R.moderation_action(R.authenticity(C("p_fake"))).alias("action"))


@query("suspicious_items", with_views(f"""
SELECT prediction_id, {level_sql(AUTH_SQL)} AS risk_level FROM scored_v WHERE {level_sql(AUTH_SQL)} IN ('high', 'critical')""",
                                      scored=True))
def suspicious_items(t):
    rows = t.scored().select("prediction_id", R.risk_level(R.authenticity(C("p_fake"))).alias("risk_level"))
    return P.suspicious(rows)


@query("unanalysed_backlog", with_views("""
SELECT event_id FROM events WHERE event_id NOT IN (SELECT prediction_id FROM scored_v WHERE prediction_id % 10 < 6)
ORDER BY event_id LIMIT 100""", scored=True))
def unanalysed_backlog(t):
    done = t.scored().where(C("prediction_id") % 10 < 6).select(C("prediction_id").alias("event_id"))
    return P.backlog(t.events().select("event_id"), done, "event_id", 100)


@query("review_status", with_views(f"""
SELECT prediction_id, CASE {level_sql(AUTH_SQL)} WHEN 'low' THEN 'approved' WHEN 'critical' THEN 'flagged' ELSE 'pending' END
       AS status FROM scored_v""", scored=True))
def review_status(t):
    return t.scored().select("prediction_id", R.review_status(R.risk_level(R.authenticity(C("p_fake")))).alias("status"))


@query("dedupe_first", with_views("""
SELECT review_text_key, review_id FROM (SELECT md5(review_text) AS review_text_key, review_id,
 row_number() OVER (PARTITION BY review_text ORDER BY review_id) AS k FROM reviews_v) WHERE k = 1""", reviews=True))
def dedupe_first(t):
    first = K.dedupe_first(t.reviews().select("review_text", "review_id"), ["review_text"], [C("review_id")])
    return first.select(F.md5("review_text").alias("review_text_key"), "review_id")
