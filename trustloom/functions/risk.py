"""Scoring policies: labels, risk levels, indicators and per-platform features.

``p_fake`` is the model's probability that content is not genuine; authenticity is ``1 - p_fake``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trustloom.functions.text import NEGATIVE_WORDS, POSITIVE_WORDS, TOPIC_WORDS, mentions

# Allowed request values and policy edges.
PLATFORMS = ("ecommerce", "social_media", "app_store", "review_site", "blog", "forum", "news", "general")
CONTENT_TYPES = ("review", "comment", "post", "description", "reply", "testimonial", "rating")
MODES = ("fast", "comprehensive", "deep")
DECISION = 0.5
HOLD_BELOW = 0.3
BLOCK_BELOW = 0.7
NEW_ACCOUNT_DAYS = 30
HEAVY_REVIEWER = 100
SHORT_TEXT, LONG_TEXT = 20, 1000


def authenticity(p_fake: Column) -> Column:
    return 1 - p_fake


def label(p_fake: Column) -> Column:
    return F.when(p_fake >= DECISION, "fake").otherwise("legitimate")


def confidence_level(p_fake: Column) -> Column:
    return (
        F.when((p_fake < 0.3) | (p_fake > 0.7), "high")
        .when((p_fake < 0.4) | (p_fake > 0.6), "medium").otherwise("low")
    )


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 0.8, "low").when(score >= 0.6, "medium").when(score >= 0.3, "high").otherwise("critical")
    )


def confidence_score(p_fake: Column) -> Column:
    return F.least(F.abs(p_fake - 0.5) * 2, F.lit(1.0))


def rating_text_consistency(rating: Column, text: Column) -> Column:
    """1.0 where the wording fits the rating, 0.5 where it does not, null without a rating."""
    good, bad = mentions(text, POSITIVE_WORDS), mentions(text, NEGATIVE_WORDS)
    fits = (
        ((rating >= 4) & (good > bad)) | ((rating <= 2) & (bad > good)) | ((rating == 3) & (F.abs(good - bad) <= 1))
    )
    return F.when(rating.isNull(), None).when(fits, 1.0).otherwise(0.5)


def length_category(n: Column) -> Column:
    return F.when(n < 50, "short").when(n < 200, "medium").otherwise("long")


def specificity(text: Column) -> Column:
    return mentions(text, TOPIC_WORDS) / F.lit(float(len(TOPIC_WORDS)))


def moderation_action(score: Column) -> Column:
    return F.when(score < HOLD_BELOW, "hold").when(score < BLOCK_BELOW, "block").otherwise("publish")


def review_status(level: Column) -> Column:
    return F.when(level == "low", "approved").when(level == "critical", "flagged").otherwise("pending")


def account_age_risk(days: Column) -> Column:
    return F.when((days > 0) & (days < NEW_ACCOUNT_DAYS), "high").otherwise("low")


def volume_risk(total: Column) -> Column:
    return F.when(total > HEAVY_REVIEWER, "high").otherwise("low")


def present(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def platform_insights(platform: Column, item_id: Column, rating: Column, text: Column) -> Column:
    """JSON object with the features each platform defines; other platforms give an empty object."""
    has_rating = rating.isNotNull().alias("has_rating")
    shapes = {
        "ecommerce": F.struct(item_id.alias("product_id"), has_rating,
                              rating_text_consistency(rating, text).alias("rating_text_consistency")),
        "social_media": F.struct(item_id.alias("post_id"), F.length(text).alias("content_length"),
                                 F.contains(text, F.lit("#")).alias("has_hashtags"),
                                 F.contains(text, F.lit("@")).alias("has_mentions")),
        "app_store": F.struct(item_id.alias("app_id"), has_rating,
                              length_category(F.length(text)).alias("review_length_category")),
        "review_site": F.struct(item_id.alias("business_id"), has_rating,
                                specificity(text).alias("review_specificity")),
    }
    out = F.lit("{}")
    for name, shape in shapes.items():
        out = F.when(platform == name, F.to_json(shape)).otherwise(out)
    return out
