"""Schemas of the landed sources and the canonical review table."""

from __future__ import annotations

from dataclasses import dataclass
REVIEW_DDL = (
    "review_id STRING, user_id STRING, business_id STRING, stars DOUBLE, text STRING, date STRING, "
    "useful INT, funny INT, cool INT"
)
BUSINESS_DDL = (
    "business_id STRING, name STRING, city STRING, state STRING, stars DOUBLE, review_count BIGINT, "
    "categories STRING, attributes MAP<STRING,STRING>"
)
USER_DDL = (
    "user_id STRING, name STRING, review_count BIGINT, yelping_since STRING, friends ARRAY<STRING>, "
    "useful INT, funny INT, cool INT, fans INT, average_stars DOUBLE"
)
CONTENT_ITEM_DDL = (
    "content_id STRING, platform STRING, content_type STRING, text STRING, user_id STRING, "
    "timestamp STRING, rating DOUBLE, is_fake BOOLEAN, confidence DOUBLE, label_source STRING, "
    "metadata MAP<STRING,STRING>"
)
REQUEST_DDL = (
    "request_id BIGINT, text STRING, platform STRING, content_type STRING, analysis_mode STRING, "
    "user_id STRING, account_age_days BIGINT, total_reviews BIGINT, profile_completeness DOUBLE, "
    "rating DOUBLE, timestamp STRING, p_fake DOUBLE"
)


@dataclass(frozen=True)
class ColumnSpec:
    """Names of the review columns; every operator takes one so that callers keep their own names."""

    review_id: str = "review_id"
    user_id: str = "user_id"
    product_id: str = "product_id"
    rating: str = "rating"
    text: str = "review_text"
    date: str = "date"
    target: str = "is_fake"


DEFAULT_COLUMNS = ColumnSpec()
