"""Streaming sources, idempotent sinks and bounded runs.

A sink writes one folder per micro-batch and overwrites it on replay, so a batch that is
run again after a failure leaves the same table. All folders lie below the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.operators.gold import latest_per_key
from aisleworks.session import prepare, scratch_path
from aisleworks.sources.fixtures import utc_timestamps

def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as a stream of files, with UTC timestamps."""
    prepare(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A file source wants a folder or a pattern; the pattern matches exactly one file.
    return utc_timestamps(spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"))


def stream_folder(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """Tail a folder of Parquet files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(
    stream: DataFrame, *, mode: str = "append", name: str = "stream", each: Callable[[DataFrame, int], None] | None = None,
    partition_by: Sequence[str] = (), root: str | None = None,
) -> str:
    """Run a stream over everything available now; returns the table folder.

    ``each`` replaces the default per-batch write. ``root`` is the folder of an earlier run to
    go on from.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, name)
    table = f"{root}/table"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{table}/batch_id={batch_id}")

    started = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(each or write)
        .start()
    )
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()
    return table


def with_batch_id(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def appended(spark: SparkSession, table: str, schema) -> DataFrame:
    """All batches of an append run."""
    return spark.read.schema(with_batch_id(schema)).parquet(table).drop("batch_id")


def last_complete(spark: SparkSession, table: str, schema) -> DataFrame:
    """The newest batch of a complete-mode run."""
    df = spark.read.schema(with_batch_id(schema)).parquet(table)
    newest = df.agg(F.max("batch_id")).scalar()
    return df.where(F.col("batch_id") == newest).drop("batch_id")


def upserted(spark: SparkSession, table: str, schema, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of an update-mode run."""
    df = spark.read.schema(with_batch_id(schema)).parquet(table)
    return latest_per_key(df, keys, [F.desc("batch_id")]).drop("batch_id")


def collect_append(stream: DataFrame, name: str) -> DataFrame:
    schema = stream.schema
    return appended(stream.sparkSession, drain(stream, name=name), schema)


def collect_update(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    schema = stream.schema
    return upserted(stream.sparkSession, drain(stream, mode="update", name=name), schema, keys)


def collect_complete(stream: DataFrame, name: str) -> DataFrame:
    schema = stream.schema
    return last_complete(stream.sparkSession, drain(stream, mode="complete", name=name), schema)
