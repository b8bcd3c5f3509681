"""Helpers shared by the operators: scratch tables, joins behind a size check, words of a text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustloom.session import scratch_path

# The bytes that separate words: \x20 and \x09-\x0D. bytes.split() cuts at exactly these.
SPACES = " \t\n\x0b\f\r"
WORDS = r"[\x20\x09-\x0D]+"

# Rows of a table that may be broadcast after its rows were counted; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation, lineage ends here.

    The shuffle files behind the table are dropped as soon as it is written; the table replaces them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the table, whose rows were counted, is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small_bytes(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if ``rows`` counted rows of at most ``row_bytes`` each are within ``BROADCAST_BYTES``."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """A column name, made from ``name``, that no column of ``df`` starts with."""
    name = f"_{name}"
    while any(c.lower().startswith(name) for c in df.columns):
        name = f"_{name}"
    return name


def document_key(id_col: str, text_col: str):
    """What tells documents apart: id and SHA-256 of the text, null counting as empty."""
    return F.struct(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("sha"))


def without(docs: DataFrame, away: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose document key is not a ``key`` of the stored table ``away``."""
    if not away.limit(1).count():
        return docs
    name = unused(docs, "document")
    marked = docs.withColumn(name, document_key(id_col, text_col))
    away = away.select(F.col("key.id").alias(f"{name}_id"), F.col("key.sha").alias(f"{name}_sha"))
    same = marked[name]["id"].eqNullSafe(away[f"{name}_id"]) & (marked[name]["sha"] == away[f"{name}_sha"])
    return marked.join(away, same, "left_anti").drop(name)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def lower_ascii(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text in blocks of about ``size`` bytes, so that a very long text is never held as one word list."""
    if len(data) <= size:
        yield data.split()
        return
    start, end = 0, len(data)
    while start < end:
        stop = min(end, start + size)
        while stop < end and data[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        yield data[start:stop].split()
        start = stop
