"""Session settings shared by every job: UTC time, hot-key threshold, shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

HOT_KEY_ROWS = "spark.aisleworks.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 2_000_000
CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("aisleworks")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("AISLEWORKS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone: every timestamp in the model is UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def hot_key_rows(spark: SparkSession) -> int:
    """Rows one key may have before its ordered work is cut into slices."""
    return int(spark.conf.get(HOT_KEY_ROWS, str(DEFAULT_HOT_KEY_ROWS)))


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder; nothing exists there yet."""
    return f"{shared_folder(spark)}/aisleworks/{purpose}-{uuid.uuid4().hex}"


def keep_checkpoints(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder, those of long fits among them."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def checkpointed(df):
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    keep_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, purpose: str):
    """``df`` as a written table in the shared folder: lineage ends there, and it is computed once."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
