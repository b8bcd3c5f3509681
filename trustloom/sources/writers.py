"""File sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def parquet(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> str:
    path = path if path.endswith(".parquet") else f"{path}.parquet"
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"').csv(path)
    return path


def json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def append_metric_rows(df: DataFrame, path: str) -> str:
    """Metric rows ``(ts, name, labels, kind, value)`` appended to the shared metric table."""
    df.select("ts", "name", "labels", "kind", "value").write.mode("append").parquet(path)
    return path
