"""Date parts, ratings, scoring policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import numeric as N, risk as R, temporal as D, text as X
from trustloom.operators import moderation as P
from trustloom.plans.registry import query
from trustloom.plans.views import NOW, r6, round6, with_views

C = F.col


def quoted(values):
    return ", ".join(f"'{v}'" for v in values)


@query("date_parts", with_views("""
SELECT review_id, coalesce(hour(date), 0) AS review_hour, coalesce(isodow(date) - 1, 0) AS review_day_of_week,
       coalesce(month(date), 0) AS review_month,
       CAST(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS review_is_weekend
FROM dated""", reviews=True, extra="""dated AS (SELECT review_id, CASE WHEN review_id % 7 <> 0 THEN date END AS date
FROM reviews_v)"""))
def date_parts(t):
    dated = t.reviews().select("review_id", F.when(C("review_id") % 7 != 0, C("date")).alias("date"))
    return dated.select("review_id", *[c.alias(n) for n, c in D.calendar_parts(C("date")).items()])


@query("date_parts_behaviour", with_views("""
SELECT review_id, coalesce(hour(date), 12) AS review_hour, coalesce(isodow(date) - 1, 0) AS review_day_of_week,
       CAST(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
       coalesce(CAST(floor((epoch_us(date) - epoch_us(TIMESTAMP '2000-01-01')) / 86400000000.0) AS BIGINT), 0)
         AS days_since_epoch
FROM dated""", reviews=True, extra="""dated AS (SELECT review_id, CASE WHEN review_id % 7 <> 0 THEN date END AS date
FROM reviews_v)"""))
def date_parts_behaviour(t):
    dated = t.reviews().select("review_id", F.when(C("review_id") % 7 != 0, C("date")).alias("date"))
    parts = D.calendar_parts(C("date"), null_hour=12)
    return dated.select(
        "review_id", parts["review_hour"].alias("review_hour"), parts["review_day_of_week"].alias("review_day_of_week"),
        parts["review_is_weekend"].alias("is_weekend"),
        F.coalesce(D.whole_days(C("date"), F.lit("2000-01-01").cast("timestamp")), F.lit(0)).alias("days_since_epoch"))


@query("parse_dates", """
WITH raw AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'bad ' || event_id ELSE strftime(ts, '%Y-%m-%d %H:%M:%S')
             END AS text, epoch_us(ts) // 1000000 AS seconds FROM events)
SELECT event_id, coalesce(epoch_us(try_cast(text AS TIMESTAMP)), -1) AS parsed_micros, seconds * 1000000 AS epoch_micros FROM raw""")
def parse_dates(t):
    raw = t.events().select(
        "event_id", F.when(C("event_id") % 5 == 0, F.concat(F.lit("bad "), C("event_id").cast("string")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("text"),
        F.unix_seconds("ts").cast("string").alias("seconds"))
    return raw.select("event_id", F.coalesce(F.unix_micros(D.parse(C("text"))), F.lit(-1)).alias("parsed_micros"),
                      F.unix_micros(D.from_epoch(C("seconds"))).alias("epoch_micros"))


@query("relative_age_label", f"""
WITH aged AS (SELECT event_id, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000.0) AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago'
       WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago'
       END AS age FROM aged""")
def relative_age_label(t):
    return t.events().select("event_id", D.age_label(C("ts"), t.now()).alias("age"))


RAW_RATING_SQL = """raw AS (SELECT review_id, CASE WHEN review_id % 11 = 0 THEN 'n/a' WHEN review_id % 13 = 0 THEN NULL
ELSE CAST(CAST(rating AS INTEGER) AS VARCHAR) END AS rating FROM reviews_v)"""


def raw_ratings(t):
    return t.reviews().select("review_id", F.when(C("review_id") % 11 == 0, "n/a").when(C("review_id") % 13 == 0, None)
                              .otherwise(C("rating").cast("int").cast("string")).alias("rating"))


@query("rating_features", with_views("""
SELECT review_id, coalesce(try_cast(rating AS DOUBLE), 0.0) AS rating_numerical,
       CAST(CASE WHEN try_cast(rating AS DOUBLE) IN (1, 5) THEN 1 ELSE 0 END AS BIGINT) AS rating_is_extreme FROM raw""",
                                     reviews=True, extra=RAW_RATING_SQL))
def rating_features(t):
    return raw_ratings(t).select("review_id", N.rating_value(C("rating")).alias("rating_numerical"),
                                 N.is_extreme(C("rating")).cast("bigint").alias("rating_is_extreme"))


@query("rating_features_behaviour", with_views("""
SELECT review_id, coalesce(try_cast(rating AS DOUBLE), 3.0) AS rating_value,
       CAST(CASE WHEN try_cast(rating AS DOUBLE) IN (1, 5) THEN 1 ELSE 0 END AS BIGINT) AS is_extreme_rating FROM raw""",
                                               reviews=True, extra=RAW_RATING_SQL))
def rating_features_behaviour(t):
    filled = raw_ratings(t).select("review_id", N.rating_value(C("rating"), N.NEUTRAL_RATING).alias("rating_value"))
    return filled.select("review_id", "rating_value",
                         N.is_extreme(C("rating_value")).cast("bigint").alias("is_extreme_rating"))


@query("safe_division", f"""
SELECT event_id, {r6("CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE value / (event_id % 10) END")} AS ratio FROM events""")
def safe_division(t):
    return t.events().select("event_id", round6(N.divide(C("value"), C("event_id") % 10)).alias("ratio"))


@query("prediction_label", with_views("""
SELECT prediction_id, CASE WHEN p_fake >= 0.5 THEN 'fake' ELSE 'legitimate' END AS label FROM scored_v""", scored=True))
def prediction_label(t):
    return t.scored().select("prediction_id", R.label(C("p_fake")).alias("label"))


@query("confidence_level", with_views("""
SELECT prediction_id, CASE WHEN p_fake < 0.3 OR p_fake > 0.7 THEN 'high' WHEN p_fake < 0.4 OR p_fake > 0.6 THEN 'medium'
       ELSE 'low' END AS confidence FROM scored_v""", scored=True))
def confidence_level(t):
    return t.scored().select("prediction_id", R.confidence_level(C("p_fake")).alias("confidence"))


def level_sql(score):
    return (f"CASE WHEN {score} >= 0.8 THEN 'low' WHEN {score} >= 0.6 THEN 'medium' WHEN {score} >= 0.3 THEN 'high' "
            "ELSE 'critical' END")


# 1 - p is inexact in binary, so both engines use CAST(1 AS DOUBLE) - p on doubles
AUTH_SQL = "(CAST(1 AS DOUBLE) - p_fake)"


@query("risk_level", with_views(f"SELECT prediction_id, {level_sql(AUTH_SQL)} AS risk_level FROM scored_v",
                                scored=True))
def risk_level(t):
    return t.scored().select("prediction_id", R.risk_level(R.authenticity(C("p_fake"))).alias("risk_level"))


@query("confidence_score", with_views(
    f"SELECT prediction_id, {r6('least(abs(p_fake - CAST(0.5 AS DOUBLE)) * 2, 1)')} AS confidence FROM scored_v",
    scored=True))
def confidence_score(t):
    return t.scored().select("prediction_id", round6(R.confidence_score(C("p_fake"))).alias("confidence"))


def mention_sql(words, text):
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{w}') AS INTEGER)" for w in words) + ")"


def consistency_sql(rating="rating", text="review_text"):
    good, bad = mention_sql(X.POSITIVE_WORDS, text), mention_sql(X.NEGATIVE_WORDS, text)
    return (f"CASE WHEN {rating} IS NULL THEN NULL WHEN ({rating} >= 4 AND {good} > {bad}) OR ({rating} <= 2 AND {bad} "
            f"> {good}) OR ({rating} = 3 AND abs({good} - {bad}) <= 1) THEN CAST(1 AS DOUBLE) "
            "ELSE CAST(0.5 AS DOUBLE) END")


@query("rating_text_consistency", with_views(
    f"SELECT review_id, {consistency_sql()} AS consistency FROM reviews_v", reviews=True))
def rating_text_consistency(t):
    return t.reviews().select("review_id", R.rating_text_consistency(C("rating"), C("review_text")).alias("consistency"))


@query("length_category", """
SELECT conv_id, turn, CASE WHEN length(text) < 50 THEN 'short' WHEN length(text) < 200 THEN 'medium' ELSE 'long' END
       AS category FROM conversations""")
def length_category(t):
    return t.base("conversations").select("conv_id", "turn", R.length_category(F.length("text")).alias("category"))


@query("specificity", with_views(
    f"SELECT review_id, {r6(mention_sql(X.TOPIC_WORDS, 'review_text') + ' / 7.0')} AS specificity FROM reviews_v",
    reviews=True))
def specificity(t):
    return t.reviews().select("review_id", round6(R.specificity(C("review_text"))).alias("specificity"))


# requests: every scored item with the text of its document, where one exists
REQUESTS_SQL = """requests AS (
SELECT s.prediction_id AS request_id, coalesce(d.text, s.class_label) AS text, s.platform,
       CASE WHEN s.platform = 'social_media' THEN 'comment' ELSE 'review' END AS content_type,
       CASE s.prediction_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'comprehensive' ELSE 'deep' END AS analysis_mode,
       CAST(s.user_id AS VARCHAR) AS user_id, 'item-' || (s.prediction_id % 50) AS item_id,
       CASE WHEN s.prediction_id % 4 > 0 THEN s.prediction_id % 90 END AS account_age_days,
       s.prediction_id % 150 AS total_reviews,
       CASE WHEN s.prediction_id % 6 > 0 THEN CAST(s.prediction_id % 11 AS DOUBLE) / 10 END AS profile_completeness,
       CASE WHEN s.prediction_id % 8 > 0 THEN CAST(1 + s.prediction_id % 5 AS DOUBLE) END AS rating,
       s.ts, s.p_fake
FROM scored_v s LEFT JOIN documents d ON d.doc_id = s.prediction_id)"""


def requests(t):
    s, d = t.scored(), t.texts("documents", "doc_id").select(C("doc_id"), C("text"))
    pid = C("prediction_id")
    return s.join(d, pid == C("doc_id"), "left").select(
        pid.alias("request_id"), F.coalesce("text", "class_label").alias("text"), "platform",
        F.when(C("platform") == "social_media", "comment").otherwise("review").alias("content_type"),
        F.when(pid % 3 == 0, "fast").when(pid % 3 == 1, "comprehensive").otherwise("deep").alias("analysis_mode"),
        C("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("item-"), (pid % 50).cast("string")).alias("item_id"),
        F.when(pid % 4 > 0, pid % 90).alias("account_age_days"), (pid % 150).alias("total_reviews"),
        F.when(pid % 6 > 0, (pid % 11).cast("double") / 10).alias("profile_completeness"),
        F.when(pid % 8 > 0, (1 + pid % 5).cast("double")).alias("rating"), "ts", "p_fake")


def insights_sql():
    return f"""CASE platform
 WHEN 'ecommerce' THEN item_id || '|' || CAST(rating IS NOT NULL AS VARCHAR) || '|' ||
      coalesce(CAST({consistency_sql(text='text')} AS VARCHAR), '')
 WHEN 'social_media' THEN item_id || '|' || length(text) || '|' || CAST(contains(text, '#') AS VARCHAR) || '|' ||
      CAST(contains(text, '@') AS VARCHAR)
 WHEN 'app_store' THEN item_id || '|' || CAST(rating IS NOT NULL AS VARCHAR) || '|' ||
      CASE WHEN length(text) < 50 THEN 'short' WHEN length(text) < 200 THEN 'medium' ELSE 'long' END
 WHEN 'review_site' THEN item_id || '|' || CAST(rating IS NOT NULL AS VARCHAR) || '|' ||
      CAST({mention_sql(X.TOPIC_WORDS, 'text')} AS VARCHAR)
 ELSE '' END"""


@query("platform_features", with_views(f"SELECT request_id, {insights_sql()} AS features FROM requests", scored=True,
                                       extra=REQUESTS_SQL))
def platform_features(t):
    js = R.platform_insights(C("platform"), C("item_id"), C("rating"), C("text"))
    rows = requests(t).select("request_id", "platform", js.alias("js"))
    get = lambda k: F.get_json_object("js", f"$.{k}")
    bar = F.lit("|")
    flat = (
        F.when(C("platform") == "ecommerce", F.concat(get("product_id"), bar, get("has_rating"), bar,
                                                      F.coalesce(get("rating_text_consistency"), F.lit(""))))
        .when(C("platform") == "social_media", F.concat(get("post_id"), bar, get("content_length"), bar,
                                                        get("has_hashtags"), bar, get("has_mentions")))
        .when(C("platform") == "app_store", F.concat(get("app_id"), bar, get("has_rating"), bar,
                                                     get("review_length_category")))
        .when(C("platform") == "review_site",
              F.concat(get("business_id"), bar, get("has_rating"), bar,
                       F.round(get("review_specificity").cast("double") * 7).cast("int").cast("string")))
        .otherwise(""))
    return rows.select("request_id", flat.alias("features"))


BEHAVIOUR_SQL = {
    "age_risk": "CASE WHEN account_age_days > 0 AND account_age_days < 30 THEN 'high' ELSE 'low' END",
    "volume_risk": "CASE WHEN total_reviews > 100 THEN 'high' ELSE 'low' END",
    "completeness": "CASE WHEN coalesce(profile_completeness, 0) = 0 THEN CAST(0.5 AS DOUBLE) "
                    "ELSE profile_completeness END",
}


@query("behaviour_risk", with_views(
    "SELECT request_id, " + ", ".join(f"CASE WHEN analysis_mode <> 'fast' THEN {e} END AS {n}"
                                      for n, e in BEHAVIOUR_SQL.items()) + " FROM requests",
    scored=True, extra=REQUESTS_SQL))
def behaviour_risk(t):
    b = P.behaviour_risk(requests(t))
    return b.select("request_id", "age_risk", "volume_risk", "completeness")


FACTORS_SQL = f"""concat_ws('|', CASE WHEN {consistency_sql(text='text')} <= 0.5 THEN 'Rating-text sentiment mismatch' END,
 CASE WHEN length(text) < 20 THEN 'Very short content' END,
 CASE WHEN analysis_mode <> 'fast' AND account_age_days > 0 AND account_age_days < 30 THEN 'New account' END)"""
INDICATORS_SQL = "CASE WHEN length(text) > 1000 THEN 'Detailed content' ELSE '' END"


@query("risk_factors", with_views(
    f"SELECT request_id, {FACTORS_SQL} AS risk_factors, {INDICATORS_SQL} AS key_indicators FROM requests",
    scored=True, extra=REQUESTS_SQL))
def risk_factors(t):
    out = P.analyse(requests(t))
    return out.select("request_id", F.array_join("risk_factors", "|").alias("risk_factors"),
                      F.array_join("key_indicators", "|").alias("key_indicators"))


def analyse_sql(source):
    return f"""SELECT request_id, platform, content_type, {r6(AUTH_SQL)} AS authenticity_score,
       {level_sql(AUTH_SQL)} AS risk_level, {r6('least(abs(p_fake - CAST(0.5 AS DOUBLE)) * 2, 1)')} AS confidence,
       CAST(length(text) AS BIGINT) AS text_length, {consistency_sql(text='text')} AS sentiment_consistency,
       CASE WHEN analysis_mode <> 'fast' THEN {BEHAVIOUR_SQL['age_risk']} END AS age_risk,
       {FACTORS_SQL} AS risk_factors, {INDICATORS_SQL} AS key_indicators FROM {source}"""


def flat_analysis(df):
    return P.analyse(df).select(
        "request_id", "platform", "content_type", round6("authenticity_score").alias("authenticity_score"),
        "risk_level", round6("confidence").alias("confidence"), C("text_length").cast("bigint").alias("text_length"),
        "sentiment_consistency", "age_risk", F.array_join("risk_factors", "|").alias("risk_factors"),
        F.array_join("key_indicators", "|").alias("key_indicators"))


@query("analyse_content", with_views(analyse_sql("requests"), scored=True, extra=REQUESTS_SQL))
def analyse_content(t):
    return flat_analysis(requests(t))


@query("platform_presets", with_views(
    analyse_sql("(SELECT * REPLACE ('ecommerce' AS platform, 'review' AS content_type, 'fast' AS analysis_mode) "
                "FROM requests)") + " UNION ALL " +
    analyse_sql("(SELECT * REPLACE ('social_media' AS platform, 'comment' AS content_type, 'fast' AS analysis_mode, "
                "NULL AS rating) FROM requests)"), scored=True, extra=REQUESTS_SQL))
def platform_presets(t):
    return flat_analysis(P.with_presets(requests(t), ("ecommerce", "social_media")))


@query("ab_bucket", """
SELECT DISTINCT user_id, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS bucket,
       CASE WHEN CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 10 THEN 'new' ELSE 'stable'
       END AS model_version FROM events""")
def ab_bucket(t):
    users = t.base("events").select("user_id").distinct().withColumn("bucket", N.hash_percent(C("user_id")))
    return users.withColumn("model_version", F.when(C("bucket") < 10, "new").otherwise("stable"))
