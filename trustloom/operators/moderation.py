"""Scoring rows under the risk policies, and the moderation queues built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trustloom.functions import risk as R

# Content type and mode each platform shortcut implies.
PRESETS = {
    "ecommerce": {"platform": "ecommerce", "content_type": "review", "analysis_mode": "fast"},
    "social_media": {"platform": "social_media", "content_type": "comment", "analysis_mode": "fast"},
}


def _deep() -> Column:
    return F.col("user_id").isNotNull() & F.col("analysis_mode").isin("comprehensive", "deep")


def behaviour_risk(df: DataFrame) -> DataFrame:
    """Account signals, only where the request asks for more than the fast mode."""
    full = F.when(F.coalesce("profile_completeness", F.lit(0.0)) == 0, 0.5).otherwise(F.col("profile_completeness"))
    return df.withColumns({
        "age_risk": F.when(_deep(), R.account_age_risk(F.col("account_age_days"))),
        "volume_risk": F.when(_deep(), R.volume_risk(F.col("total_reviews"))),
        "completeness": F.when(_deep(), full),
    })


def analyse(df: DataFrame) -> DataFrame:
    """Complete result row per scored request: one projection, no shuffle."""
    p, text, rating = F.col("p_fake"), F.col("text"), F.col("rating")
    score = R.authenticity(p)
    return behaviour_risk(df).withColumns({
        "authenticity_score": score,
        "risk_level": R.risk_level(score),
        "confidence": R.confidence_score(p),
        "label": R.label(p),
        "text_length": F.length(text),
        "sentiment_consistency": R.rating_text_consistency(rating, text),
        "platform_insights": R.platform_insights(F.col("platform"), F.col("item_id"), rating, text),
    }).withColumns({
        "risk_factors": R.present(
            (F.col("sentiment_consistency") <= 0.5, "Rating-text sentiment mismatch"),
            (F.col("text_length") < R.SHORT_TEXT, "Very short content"),
            (F.col("age_risk") == "high", "New account")),
        "key_indicators": R.present((F.col("text_length") > R.LONG_TEXT, "Detailed content")),
    })


def with_presets(df: DataFrame, names) -> DataFrame:
    """The same items as requests of each named platform shortcut; social posts carry no rating."""
    def one(name):
        out = df.withColumns({k: F.lit(v) for k, v in PRESETS[name].items()})
        return out.withColumn("rating", F.lit(None).cast("double")) if name == "social_media" else out

    return reduce(DataFrame.unionByName, [one(n) for n in names])


def suspicious(df: DataFrame) -> DataFrame:
    return df.where(F.col("risk_level").isin("high", "critical"))


def backlog(items: DataFrame, analysed: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` items without an analysis."""
    return items.join(analysed, key, "left_anti").orderBy(key).limit(n)


def since(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def recent_analysed(items: DataFrame, scores: DataFrame, key: str, ts: str, now: Column, days: int = 7) -> DataFrame:
    """Scores whose item is recent."""
    return scores.join(since(items, ts, now, days).select(key), key, "left_semi")


def recent_high_risk(items: DataFrame, scores: DataFrame, key: str, ts: str, now: Column, days: int = 7) -> DataFrame:
    return suspicious(scores).join(since(items, ts, now, days).select(key, ts), key)


def recent_moderated(items: DataFrame, scores: DataFrame, key: str, ts: str, now: Column, days: int = 7) -> DataFrame:
    """Recent held items that have a score."""
    held = since(items, ts, now, days).where(F.col("status") == "held")
    return held.join(scores.select(key), key, "left_semi")


def site_stats(items: DataFrame, scores: DataFrame, key: str, ts: str, now: Column, days: int = 7) -> DataFrame:
    """Analysed, high-risk and moderated counts in one row from one join."""
    both = since(items, ts, now, days).select(key, "status").join(scores.select(key, "risk_level"), key)
    return both.agg(
        F.count("*").alias("analyzed"), F.count(F.when(F.col("risk_level").isin("high", "critical"), 1)).alias("high_risk"),
        F.count_distinct(F.when(F.col("status") == "held", F.col(key))).alias("moderated"))


def flagged_queue(reviews: DataFrame, businesses: DataFrame, users: DataFrame) -> DataFrame:
    """Flagged or risky reviews with business and user attributes, newest first."""
    flagged = reviews.where((F.col("status") == "flagged") | F.col("risk_level").isin("high", "critical"))
    return flagged.join(businesses, "product_id", "left").join(users, "user_id", "left").orderBy(
        F.col("date").desc(), "review_id")


def join_feedback(predictions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Labels that arrived later, matched by prediction id."""
    return predictions.join(feedback, "prediction_id")


def analytics_summary(df: DataFrame) -> DataFrame:
    """Totals per platform, per risk level and overall from one pass, with the share of all analyses."""
    levels = df.select("platform", "risk_level", "authenticity_score")
    cube = levels.groupingSets(
        [["platform"], ["risk_level"], []], "platform", "risk_level"
    ).agg(F.grouping_id().alias("gid"), F.count("*").alias("analyses"),
          F.count(F.when(F.col("risk_level").isin("high", "critical"), 1)).alias("risky"),
          F.avg("authenticity_score").alias("avg_score"))
    total = F.max(F.when(F.col("gid") == 3, F.col("analyses"))).over(_everything())
    name = F.when(F.col("gid") == 1, F.col("platform")).when(F.col("gid") == 2, F.col("risk_level")).otherwise("all")
    kind = F.when(F.col("gid") == 1, "platform").when(F.col("gid") == 2, "risk_level").otherwise("total")
    return cube.select(kind.alias("cut"), name.alias("value"), "analyses", "risky", "avg_score",
                       (F.col("analyses") * 100 / total).alias("percent"))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def hourly_trend(df: DataFrame, ts: str, now: Column, hours: int = 24) -> DataFrame:
    """Analyses and risky items for each of the last hours, zero-filled."""
    hour = F.date_trunc("HOUR", F.col(ts))
    end = F.date_trunc("HOUR", now)
    start = end - F.expr(f"INTERVAL {hours - 1} HOURS")
    counts = df.where((F.col(ts) >= start) & (hour <= end)).groupBy(hour.alias("hour")).agg(
        F.count("*").alias("analyses"), F.count(F.when(F.col("risk_level").isin("high", "critical"), 1)).alias("risky"))
    slots = df.sparkSession.range(hours).select((start + F.expr("make_dt_interval(0, CAST(id AS INT))")).alias("hour"))
    return slots.join(counts, "hour", "left").fillna(0, ["analyses", "risky"])


def bulk_summary(df: DataFrame) -> DataFrame:
    """Outcome of one bulk run."""
    return df.agg(F.count("*").alias("total_items"), F.count("risk_level").alias("analyzed"),
                  F.count(F.when(F.col("risk_level") == "critical", 1)).alias("flagged"))
