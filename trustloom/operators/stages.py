"""Fit/transform stages for MLlib pipelines.

``KeyStats`` is fitted on the training rows only and keeps its table, so scoring joins stored statistics instead of computing them
from the rows being scored.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, functions as F

from trustloom.functions import text as X
from trustloom.operators.behaviour import key_stats
from trustloom.operators.features import text_measures
from trustloom.operators.ordered import attach
from trustloom.session import scratch_path


class _TextParams(Params):
    textCol = Param(Params._dummy(), "textCol", "column with the text", TypeConverters.toString)


class TextMeasures(Transformer, _TextParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the cleaned text and the text measures."""

    @keyword_only
    def __init__(self, textCol="review_text"):
        super().__init__()
        self._setDefault(textCol="review_text")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.getOrDefault(self.textCol)
        cleaned = df.withColumn(f"{name}_cleaned", X.clean(F.col(name)))
        return cleaned.withColumns(text_measures(name, f"{name}_cleaned"))


class _KeyParams(Params):
    keyCol = Param(Params._dummy(), "keyCol", "user or product column", TypeConverters.toString)
    prefix = Param(Params._dummy(), "prefix", "prefix of the added columns", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row id, to spread the rows of hot keys", TypeConverters.toString)
    table = Param(Params._dummy(), "table", "path of the stored statistics", TypeConverters.toString)


class _WithTable(DefaultParamsWriter):
    """Saves the fitted table next to the parameters, so that a saved model needs no other folder."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        stage = self.instance
        self.sparkSession.read.parquet(stage.getOrDefault(stage.table)).write.parquet(f"{path}/table")


class _FromTable(DefaultParamsReader):
    def load(self, path: str):
        stage = super().load(path)
        stage._set(table=f"{path}/table")
        return stage


class KeyStatsModel(Model, _KeyParams, MLReadable, MLWritable):
    """Joins the stored statistics of each row's key; unseen keys get zeros."""

    def write(self) -> MLWriter:
        return _WithTable(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FromTable(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        key, prefix = self.getOrDefault(self.keyCol), self.getOrDefault(self.prefix)
        stats = df.sparkSession.read.parquet(self.getOrDefault(self.table))
        named = stats.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in stats.columns if c != key])
        out = attach(df, named, key, self.getOrDefault(self.idCol), f"{prefix}_rating_count")
        return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in named.columns if c != key})


class KeyStats(Estimator, _KeyParams, DefaultParamsReadable, DefaultParamsWritable):
    """Rating and length statistics per user or product, learned from the training rows."""

    @keyword_only
    def __init__(self, keyCol="user_id", prefix="user", idCol="review_id", table=None):
        super().__init__()
        self._setDefault(keyCol="user_id", prefix="user", idCol="review_id")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> KeyStatsModel:
        key = self.getOrDefault(self.keyCol)
        path = self.getOrDefault(self.table) if self.isSet(self.table) else scratch_path(df.sparkSession, "key-stats")
        key_stats(df, key).write.mode("overwrite").parquet(path)
        model = KeyStatsModel()
        model._set(keyCol=key, prefix=self.getOrDefault(self.prefix), idCol=self.getOrDefault(self.idCol), table=path)
        return model
