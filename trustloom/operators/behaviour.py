"""Per-user, per-product and time-based behaviour of reviewers.

Nothing here opens a window over a whole user or product. Order-dependent measures first count reviews per user and point
in time, then work inside one bucket of time per user and carry one summary row per bucket across (a user has at most one
per bucket of the calendar), so a user with a third of all reviews is spread over as many tasks as there are hours of data,
and many reviews at one instant are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trustloom.functions import temporal as D, text as X
from trustloom.functions.numeric import rating_value
from trustloom.operators.ordered import HOT_ROWS, attach
from trustloom.schema import DEFAULT_COLUMNS, ColumnSpec

BUCKET_SECONDS = 3600
ROLLING_SECONDS = {"reviews_1h": 3600, "reviews_24h": 86_400, "reviews_168h": 604_800, "reviews_30d": 2_592_000}


def _std(col) -> Column:
    """Sample deviation; one value gives 0."""
    return F.coalesce(F.stddev_samp(col), F.lit(0.0))


def key_stats(df: DataFrame, key: str, cols: ColumnSpec = DEFAULT_COLUMNS) -> DataFrame:
    """Review count, rating mean and deviation, text length mean and deviation per key."""
    narrow = df.where(F.col(key).isNotNull()).select(
        key, rating_value(F.col(cols.rating)).alias("r"), X.text_length(F.col(cols.text)).alias("len"))
    return narrow.groupBy(key).agg(
        F.count("*").alias("rating_count"), F.avg("r").alias("rating_mean"), _std("r").alias("rating_std"),
        F.avg("len").alias("length_mean"), _std("len").alias("length_std"))


def with_key_stats(df: DataFrame, key: str, prefix: str, cols: ColumnSpec = DEFAULT_COLUMNS,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    stats = key_stats(df, key, cols)
    renamed = stats.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in stats.columns if c != key])
    out = attach(df, renamed, key, cols.review_id, f"{prefix}_rating_count", hot_rows)
    filled = {c: F.coalesce(c, F.lit(0)) for c in renamed.columns if c != key}
    return out.withColumns(filled)


def behaviour_stats(df: DataFrame, key: str, distinct: str, out: str, cols: ColumnSpec = DEFAULT_COLUMNS) -> DataFrame:
    """Text count, raw rating mean and deviation and distinct values of another column per key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(cols.text).alias("text_count"), F.avg(cols.rating).alias("rating_mean"),
        _std(cols.rating).alias("rating_std"), F.count_distinct(distinct).alias(out))


def user_profile(df: DataFrame, cols: ColumnSpec = DEFAULT_COLUMNS) -> DataFrame:
    """Everything one pass over a user's reviews can tell; absent columns are left out."""
    date, rating = F.col(cols.date), F.col(cols.rating)
    measures = {
        "rating_count": F.count(rating), "rating_mean": F.avg(rating), "rating_std": _std(rating),
        "rating_min": F.min(rating), "rating_max": F.max(rating),
        "review_length_mean": F.avg(F.length(cols.text)), "review_length_std": _std(F.length(F.col(cols.text))),
        "first_review": F.min(date), "last_review": F.max(date),
    }
    if "verified_purchase" in df.columns:
        measures["verified_rate"] = F.avg(F.col("verified_purchase").cast("int"))
    if "helpful_votes" in df.columns:
        measures |= {"helpful_sum": F.sum("helpful_votes"), "helpful_mean": F.avg("helpful_votes")}
    base = df.groupBy(cols.user_id).agg(*[c.alias(n) for n, c in measures.items()])
    rounded = {n: F.floor(F.col(n) * 1e4 + 0.5) / 1e4 for n in measures
               if n.endswith(("_mean", "_std", "_rate")) and n in base.columns}
    return base.withColumns(rounded).withColumns({
        "rating_range": F.col("rating_max") - F.col("rating_min"),
        "account_age_days": D.whole_days(F.col("last_review"), F.col("first_review")),
    }).withColumn("reviews_per_day", F.col("rating_count") / (F.col("account_age_days") + 1))


def _carry(df: DataFrame, user: str, last: Column, out: str) -> DataFrame:
    """One row per (user, bucket): the last non-null summary of all earlier buckets."""
    per_bucket = df.groupBy(user, "_bucket").agg(last.alias("_last"))
    w = W.partitionBy(user).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return per_bucket.select(user, "_bucket", F.max("_last").over(w).alias(out))


def _instants(df: DataFrame, cols: ColumnSpec, width: int) -> DataFrame:
    """One row per user and point in time: number of reviews ``_n``, the first of them ``_first``, the hours since the user's
    previous point ``_gap`` and the time bucket. Counting comes first, so however many reviews a user has at one time, a
    window holds at most one row per point in time of one bucket."""
    user, date = cols.user_id, cols.date
    points = df.where(F.col(user).isNotNull() & F.col(date).isNotNull()).groupBy(user, date).agg(
        F.count("*").alias("_n"), F.min(cols.review_id).alias("_first"))
    points = points.withColumn("_bucket", F.floor(F.unix_seconds(date) / width))
    before = F.lag(date).over(W.partitionBy(user, "_bucket").orderBy(date))
    inside = points.withColumn("_prev", before).join(_carry(points, user, F.max(date), "_carry"), [user, "_bucket"])
    return inside.select(user, date, "_n", "_first", "_bucket", D.hours_between(F.col(date), F.coalesce("_prev", "_carry")).alias("_gap"))


def with_gap_hours(df: DataFrame, cols: ColumnSpec = DEFAULT_COLUMNS, width: int = BUCKET_SECONDS,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hours since the same user's previous review (``gap_hours``), null for the first one; reviews of one time follow each
    other in the order of their ids, at 0 hours."""
    points = _instants(df, cols, width).drop("_bucket")
    out = attach(df, points, [cols.user_id, cols.date], cols.review_id, "_n", hot_rows)
    gap = F.when(F.col(cols.review_id).eqNullSafe(F.col("_first")), F.col("_gap")).when(F.col("_n").isNotNull(), 0.0)
    return out.select(*df.columns, gap.alias("gap_hours"))


def with_temporal_anomaly(df: DataFrame, now: Column, threshold_days: float = 1.0,
                          cols: ColumnSpec = DEFAULT_COLUMNS) -> DataFrame:
    """Flag reviews that follow the user's previous one too soon; a date in the future overrides."""
    future, soon = F.col(cols.date) > now, F.col("gap_hours") < threshold_days * 24
    return with_gap_hours(df, cols).withColumns({
        "temporal_anomaly_type": F.when(future, "future_date").when(soon, "too_frequent"),
        "temporal_anomaly": F.coalesce(future | soon, F.lit(False)),
    })


def user_temporal(df: DataFrame, cols: ColumnSpec = DEFAULT_COLUMNS) -> DataFrame:
    """Gap statistics, short-gap counts, most active hour (earliest of the most frequent), distinct hours per user."""
    user, date = cols.user_id, cols.date
    narrow = df.where(F.col(user).isNotNull()).select(cols.review_id, user, date)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gap = F.col("gap_hours")
    gaps = with_gap_hours(narrow, cols).groupBy(user).agg(
        zero(F.avg(gap)).alias("avg_time_between_reviews"), _std(gap).alias("std_time_between_reviews"),
        zero(F.min(gap)).alias("min_time_between_reviews"), F.count(F.when(gap < 1, 1)).alias("reviews_in_1_hour"),
        F.count(F.when(gap < 24, 1)).alias("reviews_in_24_hours"))
    hours = narrow.groupBy(user, F.hour(date).alias("h")).agg(F.count("*").alias("n")).where(F.col("h").isNotNull())
    modal = hours.groupBy(user).agg(
        (-F.max(F.struct("n", (-F.col("h")).alias("h")))["h"]).alias("most_active_hour"),
        F.count("*").alias("hour_diversity"))
    return gaps.join(modal, user, "left").withColumns({
        c: F.coalesce(c, F.lit(0)) for c in ("most_active_hour", "hour_diversity")})


def with_counts(df: DataFrame, keys: list, out: str, row_id: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number of rows sharing the keys, on every row; rows without a key get none."""
    named = df.withColumns({f"_k{i}": k if isinstance(k, Column) else F.col(k) for i, k in enumerate(keys)})
    names = [f"_k{i}" for i in range(len(keys))]
    counts = named.groupBy(*names).agg(F.count("*").alias(out))
    return attach(named, counts, names, row_id, out, hot_rows).drop(*names)


def with_rating_deviation(df: DataFrame, cols: ColumnSpec = DEFAULT_COLUMNS, hot_rows: int = HOT_ROWS) -> DataFrame:
    stats = df.groupBy(cols.product_id).agg(F.avg(cols.rating).alias("_mean"), F.count("*").alias("_n"))
    out = attach(df, stats, cols.product_id, cols.review_id, "_n", hot_rows)
    return out.select(*df.columns, F.abs(F.col(cols.rating) - F.col("_mean")).alias("rating_deviation"))


def with_days_since_first(df: DataFrame, cols: ColumnSpec = DEFAULT_COLUMNS, hot_rows: int = HOT_ROWS) -> DataFrame:
    stats = df.groupBy(cols.product_id).agg(F.min(cols.date).alias("_first"), F.count("*").alias("_n"))
    out = attach(df, stats, cols.product_id, cols.review_id, "_n", hot_rows)
    return out.select(*df.columns, D.whole_days(F.col(cols.date), F.col("_first")).alias("days_since_first_review"))


def rolling_activity(df: DataFrame, windows: dict[str, int] = ROLLING_SECONDS,
                     cols: ColumnSpec = DEFAULT_COLUMNS) -> DataFrame:
    """Reviews of the same user in trailing windows of each length, on every row.

    Rows are first counted per user and second, so a group of two window lengths has a fixed largest size.
    """
    user, widest = cols.user_id, max(windows.values())
    second = F.unix_seconds(cols.date)
    per_second = df.where(F.col(user).isNotNull() & F.col(cols.date).isNotNull()).groupBy(
        user, second.alias("_sec")).agg(F.count("*").alias("_n"))
    block = F.floor(F.col("_sec") / (widest + 1))
    copies = per_second.withColumn("_block", F.explode(F.array(block, block + 1)))
    over = {name: F.sum("_n").over(W.partitionBy(user, "_block").orderBy("_sec").rangeBetween(-width, 0))
            for name, width in windows.items()}
    counted = copies.withColumns(over).where(F.col("_block") == block).select(user, "_sec", "_n", *windows)
    keyed = df.withColumn("_sec", second)
    return attach(keyed, counted, [user, "_sec"], cols.review_id, "_n").drop("_sec", "_n")


def review_bursts(df: DataFrame, max_gap_hours: float = 1.0, cols: ColumnSpec = DEFAULT_COLUMNS,
                  width: int = BUCKET_SECONDS) -> DataFrame:
    """Runs of at least two reviews of one user, each within the gap of the one before: start, end, length."""
    user, date = cols.user_id, cols.date
    starts = _instants(df, cols, width).withColumn(
        "_start", F.when(F.coalesce(F.col("_gap") >= max_gap_hours, F.lit(True)), F.col(date)))
    w = W.partitionBy(user, "_bucket").orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    carry = _carry(starts, user, F.max("_start"), "_carry")
    runs = starts.withColumn("_run", F.max("_start").over(w)).join(carry, [user, "_bucket"])
    return runs.groupBy(user, F.coalesce("_run", "_carry").alias("burst_start")).agg(
        F.max(date).alias("burst_end"), F.sum("_n").alias("reviews")).where(F.col("reviews") > 1)


def suspicious_users(df: DataFrame, now: Column, cols: ColumnSpec = DEFAULT_COLUMNS) -> DataFrame:
    """Activity, too-frequent reviews, extreme ratings and capital letters per user, from one set of narrow rows."""
    narrow = df.select(
        cols.review_id, cols.user_id, cols.date, F.col(cols.rating).isin(1.0, 5.0).cast("int").alias("extreme"),
        X.share_of(F.col(cols.text), X.UPPER).alias("upper"), X.text_length(F.col(cols.text)).alias("len"))
    flagged = with_temporal_anomaly(narrow, now, cols=cols)
    return flagged.where(F.col(cols.user_id).isNotNull()).groupBy(cols.user_id).agg(
        F.count("*").alias("reviews"), F.sum(F.col("temporal_anomaly").cast("int")).alias("anomalies"),
        F.avg("extreme").alias("extreme_share"), F.avg("upper").alias("uppercase_ratio"),
        F.avg("len").alias("mean_length"))
