"""Token-level joins: base forms, unknown words, lexicon sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trustloom.functions import text as X
from trustloom.functions.stem import with_stems

COMPOUND_NORM = 15.0


def token_rows(df: DataFrame, key: str, tokens) -> DataFrame:
    """One row per token with its position."""
    return df.select(key, F.posexplode(tokens).alias("pos", "token"))


def token_counts(df: DataFrame, key: str, tokens) -> DataFrame:
    """One row per (text, distinct token): combined inside each task before any shuffle."""
    return df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def apply_base_forms(df: DataFrame, key: str, text: str, base_forms: DataFrame) -> DataFrame:
    """Replace each token by its base form from a ``(token, base)`` table and rebuild the text in order."""
    rows = token_rows(df, key, X.words(F.col(text))).join(base_forms, "token", "left")
    rebuilt = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("base", "token").alias("word")))).alias("words")
    ).select(key, F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("base_text"))
    return df.select(key).join(rebuilt, key, "left").select(key, F.coalesce("base_text", F.lit("")).alias("base_text"))


def stemmed_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the text of white-space separated tokens with every token replaced by its stem; null and empty texts give ''."""
    stems = with_stems(df.withColumn("_tokens", X.words(F.coalesce(F.col(text), F.lit("")))), "_tokens", "_stems")
    return stems.withColumn(out, F.array_join("_stems", " ")).drop("_tokens", "_stems")


def unknown_words(df: DataFrame, key: str, tokens, word_list: DataFrame) -> DataFrame:
    """Tokens per text that are missing from the ``(token)`` word list."""
    miss = (
        token_counts(df, key, tokens).join(word_list.select("token"), "token", "left_anti")
        .groupBy(key).agg(F.sum("n").alias("misspelling_count"))
    )
    return df.select(key).join(miss, key, "left").select(
        key, F.coalesce("misspelling_count", F.lit(0)).cast("bigint").alias("misspelling_count"))


def lexicon_sentiment(df: DataFrame, key: str, tokens, lexicon: DataFrame) -> DataFrame:
    """Positive, negative and neutral token shares and a bounded score from a ``(token, weight)`` lexicon."""
    hits = (
        token_counts(df, key, tokens).join(lexicon, "token", "left").groupBy(key).agg(
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("weight") > 0, F.col("n")).otherwise(0)).alias("positive_hits"),
            F.sum(F.when(F.col("weight") < 0, F.col("n")).otherwise(0)).alias("negative_hits"),
            F.sum(F.coalesce(F.col("weight") * F.col("n"), F.lit(0.0))).alias("score"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    pos, neg, n = zero("positive_hits"), zero("negative_hits"), zero("total")
    share = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    s = F.coalesce("score", F.lit(0.0))
    return df.select(key).join(hits, key, "left").select(
        key, pos.alias("positive_hits"), neg.alias("negative_hits"), share(pos).alias("positive"),
        share(neg).alias("negative"), F.when(n > 0, (n - pos - neg) / n).otherwise(F.lit(1.0)).alias("neutral"),
        (s / F.sqrt(s * s + COMPOUND_NORM)).alias("compound"),
    )


def default_lexicon(spark) -> DataFrame:
    rows = [(w, 1.0) for w in X.POSITIVE_WORDS] + [(w, -1.0) for w in X.NEGATIVE_WORDS]
    return spark.createDataFrame(rows, "token STRING, weight DOUBLE")
