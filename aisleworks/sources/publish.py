"""Staged publication of several tables: stage, validate, then promote all at once.

A run stages every table in a folder of its own and checks row count and schema of what
was written. Promotion is one appended log file that points every table at its staged
folder, so readers see all tables of a run or none. A failed run leaves FAILED rows and
the earlier version stays current.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

LOG_SCHEMA = (
    "run_id string, table_name string, path string, row_count bigint, status string, error string, generated_at timestamp"
)


class PublicationError(RuntimeError):
    """A run that was not promoted."""


def signature(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def _append_log(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    stamped = spark.createDataFrame(rows, LOG_SCHEMA).withColumn("generated_at", F.current_timestamp())
    stamped.coalesce(1).write.mode("append").parquet(f"{root}/_log")


def read_log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/_log")
    except AnalysisException:
        return spark.createDataFrame([], LOG_SCHEMA)


def publish(
    spark: SparkSession,
    root: str,
    run_id: str,
    frames: Mapping[str, DataFrame],
    *,
    contracts: Mapping[str, T.StructType] | None = None,
    on_step: Callable[[str, str], None] | None = None,
) -> DataFrame:
    """Publish ``frames`` as one run and return the run's log rows.

    ``on_step(step, table)`` is called before each step; tests use it to inject faults.
    """
    step = on_step or (lambda _step, _table: None)
    staged: list[tuple[str, str, int]] = []
    try:
        for name, df in frames.items():
            step("stage", name)
            path = f"{root}/{name}/{run_id}"
            df.write.mode("errorifexists").parquet(path)
            step("validate", name)
            written = spark.read.parquet(path)
            expected = (contracts or {}).get(name, df.schema)
            if signature(written.schema) != signature(expected):
                raise PublicationError(
                    f"{name}: staged schema {signature(written.schema)} differs from {signature(expected)}"
                )
            staged.append((name, path, written.count()))
        step("promote", ",".join(frames))
        _append_log(spark, root, [(run_id, n, p, c, "PROMOTED", None, None) for n, p, c in staged])
    except Exception as error:
        counts = {n: (p, c) for n, p, c in staged}
        _append_log(
            spark, root,
            [(run_id, n, *counts.get(n, (None, None)), "FAILED", f"{type(error).__name__}: {error}"[:500], None) for n in frames],
        )
        raise PublicationError(f"run {run_id} was not promoted: {error}") from error
    return read_log(spark, root).where(F.col("run_id") == run_id)


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The version of ``table`` that the latest promoted run points at."""
    newest = (
        read_log(spark, root)
        .where((F.col("table_name") == table) & (F.col("status") == "PROMOTED"))
        .orderBy(F.desc("generated_at"), F.desc("run_id"))
        .limit(1)
        .collect()
    )
    if not newest:
        raise PublicationError(f"{table} has never been published")
    return spark.read.parquet(newest[0]["path"])


def latest_states(log: DataFrame, order: list[str]) -> DataFrame:
    """The last state of every (run, table)."""
    w = Window.partitionBy("run_id", "table_name").orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def run_report(log: DataFrame, order: list[str]) -> DataFrame:
    """Per run: tables, rows promoted, failed tables and the terminal state."""
    return (
        latest_states(log, order)
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("tables"),
            F.sum(F.when(F.col("status") == "PROMOTED", F.col("row_count")).otherwise(0)).alias("rows_promoted"),
            F.count_if(F.col("status") == "FAILED").alias("failed_tables"),
        )
        .withColumn("state", F.when(F.col("failed_tables") > 0, "FAILED").otherwise("PROMOTED"))
    )
