"""JSON event envelopes: parse, route, and build them from wide rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The envelope every event carries besides its payload.
ENVELOPE = (
    "event_type string, trace_id string, ingest_timestamp string, schema_version string, source string, "
    "correlation_id string, partition_key string, session_id string, parent_event_id string"
)


def envelope_schema(payload: str | T.StructType) -> T.StructType:
    base = T.StructType.fromDDL(ENVELOPE)
    body = T.StructType.fromDDL(payload) if isinstance(payload, str) else payload
    return T.StructType([*base.fields, T.StructField("payload", body)])


def parse_envelope(df: DataFrame, json_column: str, payload: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """Envelope and payload columns, typed; text that is no JSON object gives NULLs."""
    schema = envelope_schema(payload)
    names = [f.name for f in schema["payload"].dataType.fields]
    parsed = df.select(*keep, F.from_json(json_column, schema).alias("_e"))
    return parsed.select(
        *keep,
        *[
            F.col(f"_e.{f.name}").try_cast("timestamp").alias(f.name)
            if f.name == "ingest_timestamp"
            else F.col(f"_e.{f.name}").alias(f.name)
            for f in schema.fields
            if f.name != "payload"
        ],
        *[F.col(f"_e.payload.{n}").alias(n) for n in names],
    )


def with_route(df: DataFrame, known: Sequence[str], *, type_column: str = "event_type") -> DataFrame:
    """Add the sink of each row: its event type when known, else the dead-letter sink."""
    return df.withColumn(
        "sink", F.when(F.col(type_column).isin(list(known)), F.col(type_column)).otherwise("unknown_event")
    )


def write_routed(df: DataFrame, path: str, known: Sequence[str], *, strict: bool = False) -> None:
    """Append one micro-batch, one folder per event type, in a single job."""
    routed = with_route(df, known)
    if strict and not routed.where(F.col("sink") == "unknown_event").isEmpty():
        raise ValueError("the batch holds an event type without a sink")
    routed.write.mode("append").partitionBy("sink").parquet(path)


def explode_bundle(
    df: DataFrame, events: Mapping[str, tuple[Column, Column]], *, keep: Sequence[str], envelope: Mapping[str, Column]
) -> DataFrame:
    """One source row to several correlated events in one pass.

    ``events`` maps an event type to (condition, payload struct); the payload travels as
    JSON inside the envelope, so all slots share one type.
    """
    slots = [
        F.when(
            condition,
            F.struct(
                F.lit(name).alias("event_type"),
                F.to_json(
                    F.struct(F.lit(name).alias("event_type"), *[c.alias(n) for n, c in envelope.items()], payload.alias("payload"))
                ).alias("body"),
            ),
        )
        for name, (condition, payload) in events.items()
    ]
    return (
        df.select(*keep, F.explode(F.array(*slots)).alias("_s"))
        .where(F.col("_s").isNotNull())
        .select(*keep, F.col("_s.event_type").alias("event_type"), F.col("_s.body").alias("body"))
    )
