"""Calendar parts, interval arithmetic and age labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def parse(col: Column) -> Column:
    """Text to timestamp; unreadable text becomes null."""
    return F.try_to_timestamp(col)


def from_epoch(col: Column) -> Column:
    return F.timestamp_seconds(col.try_cast("bigint"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS_PER_HOUR))


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days of an interval (floor), not calendar days."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def calendar_parts(col: Column, null_hour: int = 0) -> dict[str, Column]:
    """Hour, weekday (Monday 0), month and weekend flag, with a fill for missing dates."""
    return {
        "review_hour": F.coalesce(F.hour(col), F.lit(null_hour)).cast("bigint"),
        "review_day_of_week": F.coalesce(F.weekday(col), F.lit(0)).cast("bigint"),
        "review_month": F.coalesce(F.month(col), F.lit(0)).cast("bigint"),
        "review_is_weekend": F.coalesce((F.weekday(col) >= 5).cast("int"), F.lit(0)).cast("bigint"),
    }


def age_label(col: Column, now: Column) -> Column:
    """'just now', '5m ago', '3h ago', '2d ago'."""
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(col)) / 1_000_000)
    units = ((60, 1, None), (3600, 60, "m ago"), (86400, 3600, "h ago"))
    label = F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago"))
    for limit, size, suffix in reversed(units):
        text = F.lit("just now") if suffix is None else F.concat(F.floor(seconds / size).cast("string"), F.lit(suffix))
        label = F.when(seconds < limit, text).otherwise(label)
    return label
