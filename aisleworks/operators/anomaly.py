"""Anomalies in hourly series: average baseline, optional hour-of-day season, percentile fence.

A series has one point per key and hour of the look-back, so per-key windows are bounded
by the length of the look-back, not by the number of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fence and the severity limits on the absolute score.
FENCE = 1.5
SEVERITY = [(3.0, "critical"), (2.0, "high"), (1.5, "medium")]
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def decompose(series: DataFrame, keys: Sequence[str], at: str, value: str, *, seasonal: bool = False) -> DataFrame:
    """Add expected value, score and anomaly flag (-1, 0, 1) to every observed point."""
    per_key = Window.partitionBy(*keys)
    base = F.avg(value).over(per_key)
    out = series.withColumn("_dev", F.col(value) - base)
    if seasonal:
        out = out.withColumn("_hour", F.hour(at)).withColumn("_season", F.avg("_dev").over(Window.partitionBy(*keys, "_hour"))).drop("_hour")
    else:
        out = out.withColumn("_season", F.lit(0.0))
    out = out.withColumn("_res", F.col("_dev") - F.col("_season")).withColumn("expected_value", F.col(value) - F.col("_res"))
    fences = out.groupBy(*keys).agg(F.percentile("_res", F.lit(0.1)).alias("_p10"), F.percentile("_res", F.lit(0.9)).alias("_p90"))
    spread = F.col("_p90") - F.col("_p10")
    score = F.when(F.col("_res") > F.col("_p90"), F.try_divide(F.col("_res") - F.col("_p90"), spread)).when(
        F.col("_res") < F.col("_p10"), F.try_divide(F.col("_res") - F.col("_p10"), spread)
    )
    return (
        out.join(fences, list(keys))
        .withColumn("anomaly_score", F.coalesce(score, F.lit(0.0)))
        .withColumn("anomaly", F.when(F.col("anomaly_score") >= FENCE, 1).when(F.col("anomaly_score") <= -FENCE, -1).otherwise(0))
        .drop("_dev", "_season", "_res", "_p10", "_p90")
    )


def severity(score: Column) -> Column:
    out = None
    for limit, label in SEVERITY:
        hit = F.abs(score) >= limit
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("low")


def severity_rank(name: Column) -> Column:
    out = None
    for label, rank in SEVERITY_RANK.items():
        out = F.when(name == label, rank) if out is None else out.when(name == label, rank)
    return out


def alerts(
    series: DataFrame, keys: Sequence[str], at: str, value: str, *, metric: str, entity: str, prefix: str,
    details: dict[str, Column], seasonal: bool = False,
) -> DataFrame:
    """Alert rows for the anomalous points of one metric.

    ``details`` may use ``expected_value`` and ``anomaly_score`` besides the series columns.
    """
    scored = decompose(series, keys, at, value, seasonal=seasonal).where("anomaly <> 0")
    entity_id = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    return scored.select(
        F.concat(F.lit(prefix), F.sha2(F.concat(entity_id, F.col(at).cast("string")), 256)).alias("alert_id"),
        F.lit(metric).alias("metric_type"), F.lit(entity).alias("entity_type"), entity_id.alias("entity_id"),
        F.col(at).alias("time_window"), F.round("expected_value", 6).alias("expected_value"),
        F.col(value).cast("double").alias("actual_value"), F.round("anomaly_score", 6).alias("anomaly_score"),
        severity(F.col("anomaly_score")).alias("severity"),
        F.to_json(F.struct(*[c.alias(n) for n, c in details.items()])).alias("alert_details"),
    )


def direction(value: str, up: str, down: str) -> Column:
    return F.when(F.col(value) > F.col("expected_value"), up).otherwise(down)


def deviation_pct(value: str) -> Column:
    return F.round(F.try_divide(F.col(value) - F.col("expected_value"), F.col("expected_value")) * 100, 2)
