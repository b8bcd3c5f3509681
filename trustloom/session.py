"""Session helpers: the few settings every job relies on, and shared scratch storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Fix the session settings results depend on (UTC calendar arithmetic)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a temporary folder; on a cluster an unset folder is an error, because a machine-local
    path would not be visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="trustloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)  # only the folder made here
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    A written table outlives any executor, is columnar, and gives later plans exact sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shard_count(spark: SparkSession) -> int:
    """How many pieces to cut one ordered group into: follows the cluster's shuffle width."""
    return max(2, min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 4096))
