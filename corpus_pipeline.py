"""From raw documents to packed training sequences, stage by stage.

Each stage gets what its predecessor kept, written as Parquet and read again, and all but the last return the columns of
``documents``. The last returns one row per piece of a document and its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trustloom.llm import exact, kneser, quality, simhash
from trustloom.llm.common import stored
from trustloom.llm.queries import packed
from trustloom.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rules' votes make good quality more probable than bad."""
    return quality.without_rejects(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the trusted ones among them finds ordinary for their language."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return kneser.without_rejects(docs, kneser.trusted_ids(labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints within two bits link: the one with the smallest id."""
    return simhash.without_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packed(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup),
          ("near_dedup", near_dedup), ("packing", packing)]

# Stages 1, 2, 4 and 5 are iterative or need a tokenizer, so SQL can't state the result; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table in the shared folder."""
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
