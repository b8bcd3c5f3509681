"""Quality rules: a rule is a name and a condition; rows either pass all rules or carry the names of those they break."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from trustloom.functions import risk as R
from trustloom.functions.text import SPACE_RUN
from trustloom.operators.ranking import dedupe_first

# Limits of the quality contract and of request fields.
TEXT_LENGTH = (10, 5000)
RATING = (1, 5)
MAX_REQUEST_TEXT = 10_000
MAX_USER_ID = 100
MAX_TEXTS, MAX_ITEMS = 100, 1000
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"

Rules = Mapping[str, Column]


def broken(rules: Rules) -> Column:
    """Names of the broken rules; a condition that is unknown counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))


def judge(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn("reasons", broken(rules))


def split(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their reasons."""
    judged = judge(df, rules)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def review_rules(df: DataFrame) -> dict[str, Column]:
    rules = {}
    if "review_text" in df.columns:
        rules["text_missing"] = F.col("review_text").isNotNull()
        rules["text_length"] = F.length("review_text").between(*TEXT_LENGTH)
    if "rating" in df.columns:
        rules["rating_missing"] = F.col("rating").isNotNull()
        rules["rating_range"] = F.col("rating").between(*RATING)
    return rules


def _first(df: DataFrame, key: str, order: str) -> DataFrame:
    return dedupe_first(df, [key], [F.col(order).asc_nulls_last()])


def validate_reviews(df: DataFrame, order: str) -> DataFrame:
    """Rows that keep the contract, first of each review id (else of each text) along ``order``."""
    kept = split(df, review_rules(df))[0]
    key = next((c for c in ("review_id", "review_text") if c in df.columns), None)
    return _first(kept, key, order) if key else kept


def validate_businesses(df: DataFrame, order: str) -> DataFrame:
    """First row of each id, then the required fields (the order matters)."""
    need = [c for c in ("business_id", "name") if c in df.columns]
    return _first(df, "business_id", order).dropna(subset=need)


def validate_users(df: DataFrame, order: str) -> DataFrame:
    return _first(df, "user_id", order).dropna(subset=["user_id"])


def validation_report(df: DataFrame, rules: Rules, kind: str, key: str) -> DataFrame:
    """Rows before, rows broken per rule and rows after (distinct keys among the passing rows).

    A distinct count next to conditional counts: Spark aggregates per key before it counts keys, so no task holds a key set.
    """
    judged = judge(df, rules)
    passed = F.size("reasons") == 0
    out = judged.agg(
        F.count("*").alias("rows_before"), F.count_distinct(F.when(passed, F.col(key))).alias("rows_after"),
        *[F.count(F.when(F.array_contains("reasons", n), 1)).alias(f"broken_{n}") for n in rules])
    return out.select(F.lit(kind).alias("data_type"), "rows_before", "rows_after",
                      (F.col("rows_before") - F.col("rows_after")).alias("removed"), *[f"broken_{n}" for n in rules])


def handle_missing_text(df: DataFrame, column: str, strategy: str, fill: str = "") -> DataFrame:
    if strategy == "drop":
        return df.dropna(subset=[column])
    if strategy == "fill":
        return df.fillna({column: fill})
    if strategy == "keep":
        return df
    raise ValueError(f"unknown strategy {strategy}")


def request_rules(enhanced: bool = False) -> dict[str, Column]:
    """Field bounds of a scoring request; the enhanced form adds closed sets and profile bounds."""
    optional = lambda c, ok: F.col(c).isNull() | ok
    text = F.regexp_replace("text", rf"^{SPACE_RUN}|{SPACE_RUN}$", "")
    rules = {
        "text_empty": F.length(text) > 0,
        "text_too_long": F.length("text") <= MAX_REQUEST_TEXT,
        "rating_range": optional("rating", F.col("rating").between(*RATING)),
    }
    if not enhanced:
        return rules | {
            "user_id_too_long": optional("user_id", F.length("user_id") <= MAX_USER_ID),
            "timestamp_format": optional("timestamp", F.col("timestamp").rlike(ISO_TIME)
                                         & F.try_to_timestamp("timestamp").isNotNull()),
        }
    return rules | {
        "platform": F.col("platform").isin(*R.PLATFORMS),
        "content_type": F.col("content_type").isin(*R.CONTENT_TYPES),
        "analysis_mode": F.col("analysis_mode").isin(*R.MODES),
        "account_age_days": optional("account_age_days", F.col("account_age_days") >= 0),
        "total_reviews": optional("total_reviews", F.col("total_reviews") >= 0),
        "profile_completeness": optional("profile_completeness", F.col("profile_completeness").between(0, 1)),
    }


def batch_size_ok(n: Column, limit: int) -> Column:
    return n.between(1, limit)


def schema_problems(df: DataFrame, required, min_rows: int = 1) -> list[str]:
    """Missing columns, and too few rows (reads at most ``min_rows`` rows)."""
    problems = [f"missing column {c}" for c in required if c not in df.columns]
    if df.limit(min_rows).count() < min_rows:
        problems.append(f"fewer than {min_rows} rows")
    return problems
