"""Feature frames: preprocessing output, per-review behaviour, assembled user features, imputing and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trustloom.functions import numeric as N, temporal as D, text as X
from trustloom.operators import behaviour as B, graph as G
from trustloom.operators.ordered import HOT_ROWS, attach, quantiles
from trustloom.schema import DEFAULT_COLUMNS, ColumnSpec
from trustloom.session import written

TEXT_RATIOS = {"uppercase_ratio": X.UPPER, "digit_ratio": X.DIGIT, "punctuation_ratio": X.PUNCTUATION,
               "special_char_ratio": X.SPECIAL}


def text_measures(text: str, cleaned: str) -> dict[str, Column]:
    col, done = F.col(text), F.col(cleaned)
    ratios = {f"text_{n}": X.share_of(col, p) for n, p in TEXT_RATIOS.items()}
    return {
        "text_length": X.text_length(col), "text_word_count": X.word_count(col),
        "text_sentence_count": X.sentence_count(col), "text_avg_word_length": X.avg_word_length(col),
        "cleaned_text_length": X.text_length(done), "cleaned_word_count": X.word_count(done), **ratios,
        "text_repeated_chars": X.repeated_chars(col), "text_repeated_words": X.repeated_words(col),
    }


def preprocess(df: DataFrame, now: Column, missing: str = "fill", cols: ColumnSpec = DEFAULT_COLUMNS,
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cleaned text plus text, rating, time, user and product features per review.

    The statistics and windows run over a written table of ids, date, rating and length, so the texts are read twice in all:
    for their length, and for the result, which what was added joins once by review id. That id must be a review's own.
    """
    if missing == "drop":
        df = df.dropna(subset=[cols.text])
    elif missing == "fill":
        df = df.fillna({cols.text: ""})
    raw = F.col(cols.rating)
    measured = df.withColumn(f"{cols.text}_cleaned", X.clean(F.col(cols.text)))
    measured = measured.withColumns(text_measures(cols.text, f"{cols.text}_cleaned") | {
        "rating_is_extreme": N.is_extreme(raw), "rating_numerical": N.rating_value(raw),
    } | D.calendar_parts(F.col(cols.date)))
    needed = [cols.review_id, cols.user_id, cols.product_id, cols.date, "rating_numerical", "text_length"]
    narrow = written(measured.select(*needed), "narrow-reviews")
    out = B.with_temporal_anomaly(narrow, now, cols=cols)
    for key, prefix in ((cols.user_id, "user"), (cols.product_id, "product")):
        stats = narrow.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.count("*").alias(f"{prefix}_rating_count"), F.avg("rating_numerical").alias(f"{prefix}_rating_mean"),
            F.coalesce(F.stddev_samp("rating_numerical"), F.lit(0.0)).alias(f"{prefix}_rating_std"),
            F.avg("text_length").alias(f"{prefix}_length_mean"),
            F.coalesce(F.stddev_samp("text_length"), F.lit(0.0)).alias(f"{prefix}_length_std"))
        out = attach(out, stats, key, cols.review_id, f"{prefix}_rating_count", hot_rows)
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in stats.columns if c != key})
    added = [c for c in out.columns if c not in needed]
    return measured.join(out.select(cols.review_id, *added), cols.review_id, "left")


def review_behaviour(df: DataFrame, cols: ColumnSpec = DEFAULT_COLUMNS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All behaviour columns of a review in one frame."""
    text, date = F.col(cols.text), F.col(cols.date)
    parts = D.calendar_parts(date, null_hour=12)
    rating = N.rating_value(F.col(cols.rating), N.NEUTRAL_RATING)
    base = df.withColumns({
        "review_length": X.text_length(text), "word_count": X.word_count(text), "avg_word_length": X.avg_word_length(text),
        "uppercase_ratio": X.share_of(text, X.UPPER), "digit_ratio": X.share_of(text, X.DIGIT),
        "punctuation_ratio": X.share_of(text, X.PUNCTUATION), "exclamation_count": X.literal_count(text, "!"),
        "question_count": X.literal_count(text, "?"), "review_hour": parts["review_hour"],
        "review_day_of_week": parts["review_day_of_week"], "is_weekend": parts["review_is_weekend"],
        "days_since_epoch": F.coalesce(D.whole_days(date, F.lit("2000-01-01").cast("timestamp")), F.lit(0)),
        "rating_value": rating, "is_extreme_rating": N.is_extreme(rating),
        "_has_text": F.when(text.isNotNull(), 1),
    }).drop(cols.text)
    for key, other, prefix in ((cols.user_id, cols.date, "user"), (cols.product_id, cols.user_id, "product")):
        stats = base.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.count("_has_text").alias(f"{prefix}_text_count"), F.count("*").alias("_rows"), F.avg(cols.rating).alias(f"{prefix}_rating_mean"),
            F.stddev_samp(cols.rating).alias(f"{prefix}_rating_std"),
            F.count_distinct(other).alias(f"{prefix}_{'dates' if prefix == 'user' else 'reviewers'}"))
        base = attach(base, stats, key, cols.review_id, "_rows", hot_rows).drop("_rows")
        base = base.withColumns({c: F.coalesce(c, F.lit(0)) for c in stats.columns if c not in (key, "_rows")})
    return base.drop("_has_text")


def assemble_behaviour(df: DataFrame, cols: ColumnSpec = DEFAULT_COLUMNS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Reviews with their user's profile, timing and graph features; missing values become 0.

    The three user tables share the user key, so they are joined with each other first and meet the reviews once.
    """
    user = cols.user_id
    profile = B.user_profile(df, cols).drop("first_review", "last_review")
    timing = B.user_temporal(df, cols)
    degree = df.groupBy(user).agg(F.count_distinct(cols.product_id).alias("neighbor_count"), F.count("*").alias("_rows"))
    table = profile.join(timing, user, "left").join(degree, user, "left").where(F.col(user).isNotNull())
    out = attach(df, table, user, cols.review_id, "_rows", hot_rows).drop("_rows")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in table.columns if c not in (user, "_rows")})


def impute(df: DataFrame, columns: list[str], strategy: str) -> DataFrame:
    """Fill nulls of each column by its mean, its exact median or zero."""
    if strategy == "zero":
        return df.fillna(0, columns)
    if strategy == "mean":
        fills = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        return df.fillna({c: fills[c] for c in columns if fills[c] is not None})
    if strategy == "median":
        long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "feature", "value")
        fills = {r["feature"]: r["q0"] for r in quantiles(long, ["feature"], "value", [0.5]).collect()}
        return df.fillna({c: fills[c] for c in columns if c in fills})
    raise ValueError(f"unknown strategy {strategy}")


def scale(df: DataFrame, columns: list[str], method: str) -> DataFrame:
    """Standard scaling with the population deviation (a constant column keeps scale 1), or scaling to [0, 1]."""
    if method == "none":
        return df
    if method == "standard":
        aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("shift", F.avg), ("size", F.stddev_pop))]
    elif method == "minmax":
        aggs = [a for c in columns for a in (F.min(c).alias(f"shift_{c}"), (F.max(c) - F.min(c)).alias(f"size_{c}"))]
    else:
        raise ValueError(f"unknown method {method}")
    row = df.agg(*aggs).first()
    size = lambda c: row[f"size_{c}"] or 1.0
    return df.withColumns({c: (F.col(c) - (row[f"shift_{c}"] or 0.0)) / size(c) for c in columns})


def graph_block(df: DataFrame, cols: ColumnSpec = DEFAULT_COLUMNS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Degrees of the review's user and product in the user-product graph."""
    return G.with_degrees(df, cols, hot_rows)
