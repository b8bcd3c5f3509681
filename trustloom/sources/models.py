"""Stored models and monitor state."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

CARD_DDL = "name STRING, path STRING, params MAP<STRING,STRING>, scores MAP<STRING,DOUBLE>, rows BIGINT, saved_at TIMESTAMP"


def save_model(spark: SparkSession, model: PipelineModel, folder: str, name: str, params: dict, scores: dict, rows: int,
               saved_at: dt.datetime) -> str:
    """Store a fitted pipeline and one metadata row in the card table next to it."""
    path = f"{folder}/{name}-{saved_at:%Y%m%dT%H%M%S%f}"
    model.write().overwrite().save(path)
    card = [(name, path, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in scores.items()}, rows, saved_at)]
    spark.createDataFrame(card, CARD_DDL).coalesce(1).write.mode("append").parquet(f"{folder}/cards")
    return path


def cards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CARD_DDL).parquet(f"{folder}/cards")


def load_model(spark: SparkSession, folder: str, name: str | None = None) -> PipelineModel:
    """The latest stored model, of one name if given."""
    rows = cards(spark, folder)
    if name:
        rows = rows.where(F.col("name") == name)
    latest = rows.agg(F.max_by("path", F.struct("saved_at", "path")).alias("path")).first()["path"]
    if latest is None:
        raise FileNotFoundError(f"no stored model under {folder}")
    return PipelineModel.load(latest)


def append_state(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_state(spark: SparkSession, path: str, keys: list[str], ts: str) -> DataFrame:
    """The newest state row per key."""
    state = spark.read.parquet(path)
    rest = [c for c in state.columns if c not in (*keys, ts)]
    last = state.groupBy(*keys).agg(F.max(F.struct(ts, *rest)).alias("s"))
    return last.select(*keys, "s.*")
