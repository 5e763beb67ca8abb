"""Reports over price recommendations and the decisions taken on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleworks.operators.gold import latest_per_key, ratio

# The report's bucket limits and labels.
CONFIDENCE = [(90, "Very High (>=90%)"), (70, "High (70-90%)"), (50, "Medium (50-70%)")]
LOW_CONFIDENCE = "Low (<50%)"
CHANGE = [
    (-20, "Large Markdown (>20%)"), (-10, "Moderate Markdown (10-20%)"), (-5, "Small Markdown (5-10%)"),
    (5, "Minimal Change (<5%)"), (10, "Small Increase (5-10%)"),
]
LARGE_INCREASE = "Large Increase (>10%)"


def change_bucket(change_pct: Column) -> Column:
    out = None
    for limit, label in CHANGE:
        out = F.when(change_pct < limit, label) if out is None else out.when(change_pct < limit, label)
    return out.otherwise(LARGE_INCREASE)


def confidence_bucket(percent: Column) -> Column:
    out = None
    for limit, label in CONFIDENCE:
        out = F.when(percent >= limit, label) if out is None else out.when(percent >= limit, label)
    return out.otherwise(LOW_CONFIDENCE)


def pending(created: DataFrame) -> DataFrame:
    """Latest pending recommendation per id."""
    return latest_per_key(created.where("status = 'PENDING'"), ["recommendation_id"], [F.desc("event_ts"), F.desc("event_id")])


def decisions(approved: DataFrame, rejected: DataFrame) -> DataFrame:
    return approved.withColumn("action", F.lit("Approved")).unionByName(rejected.withColumn("action", F.lit("Rejected")))


def per_hour(made: DataFrame) -> DataFrame:
    return made.groupBy(F.date_trunc("hour", "event_ts").alias("hour"), "action").agg(F.count(F.lit(1)).alias("decisions"))


def approval_rate(made: DataFrame, created: DataFrame) -> DataFrame:
    joined = made.select("recommendation_id", "action").join(created.select("recommendation_id", "confidence_pct"), "recommendation_id")
    return (
        joined.groupBy(confidence_bucket(F.col("confidence_pct")).alias("confidence_bucket"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "Approved").alias("approved"))
        .withColumn("approval_rate", ratio(F.col("approved"), F.col("total")))
    )


def decision_minutes(made: DataFrame, created: DataFrame) -> DataFrame:
    """Whole minutes between each decision and the creation of its recommendation."""
    minute = lambda c: F.floor(F.unix_seconds(c) / F.lit(60))
    joined = made.select("recommendation_id", "event_ts").join(
        created.select("recommendation_id", F.col("event_ts").alias("created_ts")), "recommendation_id"
    )
    return joined.select("recommendation_id", (minute("event_ts") - minute("created_ts")).alias("minutes"))
