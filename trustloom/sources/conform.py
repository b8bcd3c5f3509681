"""Bringing each landed source to the canonical columns. Absent columns are skipped when the plan is built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trustloom.functions import temporal as D

# Source column names and their canonical names.
REVIEW_COLUMNS = {
    "review_id": "review_id", "user_id": "user_id", "business_id": "product_id", "stars": "rating",
    "text": "review_text", "date": "date", "useful": "useful_votes", "funny": "funny_votes", "cool": "cool_votes",
}
BUSINESS_COLUMNS = ("business_id", "name", "city", "state", "stars", "review_count", "categories", "attributes")
USER_COLUMNS = ("user_id", "name", "review_count", "yelping_since", "friends", "useful", "funny", "cool", "fans",
                "average_stars", "compliment_hot", "compliment_more")
SHOP_ALIASES = {
    "review_id": ("Id",), "product_id": ("ProductId", "asin"), "user_id": ("UserId", "reviewerID"),
    "user_name": ("ProfileName",), "helpful_numerator": ("HelpfulnessNumerator",),
    "helpful_denominator": ("HelpfulnessDenominator",), "rating": ("Score", "overall"),
    "timestamp": ("Time", "unixReviewTime"), "summary": ("Summary", "summary"), "review_text": ("Text", "reviewText"),
    "review_date": ("reviewTime",),
}


def _or_now(when: Column | None) -> Column:
    return F.current_timestamp() if when is None else when


def _tag(df: DataFrame, source: str, collected_at: Column | None) -> DataFrame:
    return df.withColumns({"source": F.lit(source), "collected_at": _or_now(collected_at)})


def rename_available(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in mapping.items() if a in df.columns])


def reviews(df: DataFrame, collected_at: Column | None = None) -> DataFrame:
    return _tag(rename_available(df, REVIEW_COLUMNS), "yelp_open_dataset", collected_at)


def businesses(df: DataFrame, collected_at: Column | None = None) -> DataFrame:
    return _tag(rename_available(df, {c: c for c in BUSINESS_COLUMNS}), "yelp_open_dataset", collected_at)


def users(df: DataFrame, collected_at: Column | None = None) -> DataFrame:
    return _tag(rename_available(df, {c: c for c in USER_COLUMNS}), "yelp_open_dataset", collected_at)


def shop_reviews(df: DataFrame, collected_at: Column | None = None) -> DataFrame:
    """Either naming dialect, or both in one table, to one set of names; epoch seconds give ``date``."""
    exact = set(df.columns)
    picked = {name: [F.col(a) for a in aliases if a in exact] for name, aliases in SHOP_ALIASES.items()}
    out = df.select(*[F.coalesce(*found).alias(name) for name, found in picked.items() if found])
    if "timestamp" in out.columns:
        out = out.withColumn("date", D.from_epoch(F.col("timestamp")))
    return _tag(out, "amazon_kaggle", collected_at)


def content_id(platform: Column, text: Column, user: Column, ts: Column) -> Column:
    """``platform_`` plus 12 hex digits of the md5 of text, user and time; a missing part reads ``None``."""
    shown = [F.coalesce(c.cast("string"), F.lit("None")) for c in (text, user, ts)]
    return F.concat(platform, F.lit("_"), F.substring(F.md5(F.concat_ws("_", *shown)), 1, 12))


def content_items(df: DataFrame, collected_at: Column | None = None) -> DataFrame:
    """Rows of any platform as the shared item record; unknown fields are null."""
    have = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    base = df.select(
        have("text", "string"), have("platform", "string"), have("content_type", "string"), have("user_id", "string"),
        have("rating", "double"), have("timestamp", "timestamp"), have("product_id", "string"),
        have("business_id", "string"), have("is_fake", "boolean"), have("confidence", "double"),
        have("label_source", "string"),
        *([F.col("metadata")] if "metadata" in df.columns else [F.create_map().cast("map<string,string>").alias("metadata")]))
    extra = F.create_map(
        F.lit("content_id"), content_id(F.col("platform"), F.col("text"), F.col("user_id"), F.col("timestamp")),
        F.lit("collected_at"), _or_now(collected_at).cast("string"))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")),
                        lambda k, v: ~k.isin("content_id", "collected_at"))
    return base.withColumn("metadata", F.map_concat(kept, extra))


def flatten_nested(df: DataFrame, per_business: int, key: str = "business_id") -> DataFrame:
    """Nested API documents to flat reviews: the first ``per_business`` of each business in document order."""
    from trustloom.operators.ranking import first_rows

    order = [c for c in ("page",) if c in df.columns]
    flat = df.select(key, *order, F.posexplode("reviews").alias("pos", "r"))
    kept = first_rows(flat, [key], [*[F.col(c) for c in order], F.col("pos")], per_business)
    return kept.select(
        F.col(key).alias("product_id"), "position", F.col("r.id").alias("review_id"),
        F.col("r.user.id").alias("user_id"), F.col("r.user.name").alias("user_name"), F.col("r.rating").alias("rating"),
        F.col("r.text").alias("review_text"), F.col("r.time_created").alias("date"), F.col("r.url").alias("url"))


def union_sources(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Bag union of named tables with a ``source`` column; columns a table lacks are null."""
    return concat([df.withColumn("source", F.lit(name)) for name, df in frames.items()])


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def request_rows(df: DataFrame, received: Column | None = None) -> DataFrame:
    """Scoring rows: the text under both names, unreadable times replaced, extras never overriding base fields."""
    base = {"text", "review_text", "user_id", "date", "timestamp"}
    when = F.when(F.col("timestamp").isNotNull(),
                  F.coalesce(D.parse(F.col("timestamp")), _or_now(received)))
    extras = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*base))
    return df.select("request_id", "text", F.col("text").alias("review_text"), "user_id", when.alias("date"),
                     when.alias("timestamp"), extras.alias("extra"))


def zip_batches(df: DataFrame, key: str, arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays to rows by position; arrays shorter than the first give null."""
    zipped = df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "z"), F.size(arrays[0]).alias("n"))
    return zipped.where(F.col("pos") < F.col("n")).select(key, "pos", *[F.col(f"z.{a}").alias(a) for a in arrays])


def context_payload(fields: Mapping[str, Column]) -> Column:
    """JSON context object; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [f.name for f in df.schema if f.dataType.simpleString() in kinds]
