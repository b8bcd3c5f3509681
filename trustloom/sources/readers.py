"""File sources: every reader takes an explicit schema and scans folders in parallel."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustloom import schema as S
from trustloom.session import written
from trustloom.sources import conform

BAD = "_bad"


class NoRecordsError(RuntimeError):
    """Nothing in the source could be read."""


def json_lines(spark: SparkSession, path, ddl: str, pattern: str | None = None) -> DataFrame:
    """Newline JSON; a line that does not parse keeps its text in ``_bad`` with all fields null.

    Lines are read as text and parsed by ``from_json``, so one plan can serve both the good and the bad lines.
    """
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    lines = reader.text(path).where(F.trim("value") != "").select("value")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return lines.select(F.from_json("value", f"{ddl}, {BAD} STRING", options).alias("r")).select("r.*")


def good(df: DataFrame) -> DataFrame:
    return df.where(F.col(BAD).isNull()).drop(BAD)


def quarantine(df: DataFrame) -> DataFrame:
    return df.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line"))


def require_rows(df: DataFrame) -> DataFrame:
    """The good lines; an error if there is none (looks at one row only)."""
    kept = good(df)
    if kept.limit(1).isEmpty():
        raise NoRecordsError("no line of the source could be read")
    return kept


def csv(spark: SparkSession, path, ddl: str, multi_line: bool = False) -> DataFrame:
    """Delimited files with a header. Records over several lines (quoted line ends) must be asked for: such files can't be
    split, so each is read by one task."""
    return (spark.read.schema(ddl).option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("quote", '"').csv(path))


def parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def json_documents(spark: SparkSession, path, ddl: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def named_files(spark: SparkSession, folder: str, names: list[str], ddl: str) -> DataFrame:
    """Only the named files of a folder."""
    return good(json_lines(spark, [f"{folder}/{n}" for n in names], ddl))


def labelled_lines(spark: SparkSession, path) -> DataFrame:
    """One review per line; label and polarity come from the name of the file (or of the folder
    a distributed writer made for it), blank lines are dropped."""
    name = F.lower(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1))
    lines = spark.read.text(path).select(F.trim(F.col("value")).alias("text"), name.alias("file"))
    positive = F.contains(F.col("file"), F.lit("positive"))
    return lines.where(F.length("text") > 0).select(
        "text", "file", F.contains(F.col("file"), F.lit("deceptive")).alias("is_fake"),
        F.when(positive, "positive").otherwise("negative").alias("sentiment"),
        F.when(positive, 5.0).otherwise(1.0).alias("rating"))


@dataclass(frozen=True)
class Entity:
    pattern: str
    ddl: str
    transform: Callable[[DataFrame], DataFrame]


ENTITIES: Mapping[str, Entity] = {
    "review": Entity("*review*.json", S.REVIEW_DDL, conform.reviews),
    "business": Entity("*business*.json", S.BUSINESS_DDL, conform.businesses),
    "user": Entity("*user*.json", S.USER_DDL, conform.users),
}


def collect_entities(spark: SparkSession, folder: str, out: str, kinds=tuple(ENTITIES),
                     entities: Mapping[str, Entity] = ENTITIES) -> DataFrame:
    """Read, conform and store each kind of entity; a kind that cannot be read is reported, not fatal.

    Gives one report row per kind with status, rows and bad lines. A source is read and parsed once, into a staging table
    from which good rows and bad lines are taken; rows are counted from the stored parquet footers.
    """
    report = []
    for kind in kinds:
        try:
            entity = entities[kind]
            raw = written(json_lines(spark, f"{folder}/{kind}", entity.ddl, entity.pattern), f"staged-{kind}")
            entity.transform(good(raw)).write.mode("overwrite").option("compression", "snappy").parquet(f"{out}/{kind}")
            quarantine(raw).write.mode("overwrite").parquet(f"{out}/{kind}_bad")
            report.append((kind, "completed", spark.read.parquet(f"{out}/{kind}").count(),
                           spark.read.parquet(f"{out}/{kind}_bad").count(), None))
        except Exception as exc:  # one missing source must not stop the others
            report.append((kind, "failed", 0, 0, type(exc).__name__))
    return spark.createDataFrame(report, "kind STRING, status STRING, rows BIGINT, bad_lines BIGINT, error STRING")
