"""Alert rules over a trailing window that ends at ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, at: str) -> Column:
    """The latest time in ``df`` as a scalar subquery, the stand-in for the wall clock."""
    return df.agg(F.max(at)).scalar()


def trailing(df: DataFrame, at: str, as_of: Column, minutes: int) -> DataFrame:
    return df.where(F.col(at) > as_of - F.make_dt_interval(mins=F.lit(minutes)))


def stockout(facts: DataFrame, as_of: Column, *, minutes: int = 5) -> DataFrame:
    return trailing(facts, "event_ts", as_of, minutes).select(
        "store_id", "dc_id", "product_id", "last_known_quantity", "detection_time", "trace_id"
    )


def reorder_urgent(facts: DataFrame, as_of: Column, *, minutes: int = 10) -> DataFrame:
    return trailing(facts.where("priority = 'URGENT'"), "event_ts", as_of, minutes).select(
        "store_id", "dc_id", "product_id", "reorder_quantity", "reorder_point", "current_quantity", "trace_id"
    )


def minutes_between(start: str, end: str) -> Column:
    return F.unix_micros(end) / F.lit(60_000_000.0) - F.unix_micros(start) / F.lit(60_000_000.0)


def truck_dwell_breach(lifecycles: DataFrame, as_of: Column, *, minutes: int = 5, threshold: float = 90.0) -> DataFrame:
    """Completed lifecycles (one row each) that stayed longer than the agreed time."""
    recent = trailing(lifecycles.where("departure_time > arrival_time"), "arrival_time", as_of, minutes)
    return (
        recent.withColumn("dwell_minutes", minutes_between("arrival_time", "departure_time"))
        .where(F.col("dwell_minutes") > threshold)
        .withColumn("threshold_minutes", F.lit(threshold))
    )


def zone_overcrowded(
    facts: DataFrame, as_of: Column, *, minutes: int = 5, max_customers: int = 50, max_dwell: float = 600.0
) -> DataFrame:
    return (
        trailing(facts, "event_ts", as_of, minutes)
        .groupBy("store_id", "zone")
        .agg(F.sum("count").alias("customers"), F.avg("dwell_seconds").alias("avg_dwell"))
        .where((F.col("customers") > max_customers) | (F.col("avg_dwell") > max_dwell))
    )


def high_value_receipt(receipts: DataFrame, as_of: Column, *, minutes: int = 5, threshold_cents: int = 20_000) -> DataFrame:
    return trailing(receipts, "event_ts", as_of, minutes).where(F.col("total_cents") > threshold_cents)
