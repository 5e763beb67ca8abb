"""Data-quality checks: every check is a row (check, violations)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.operators.ordered import dealt


def row_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Violations of any number of row conditions in one pass; NULL counts as no violation."""
    one = df.agg(*[F.count_if(c).alias(f"_{i}") for i, c in enumerate(checks.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(checks)])
    return one.select(F.inline(pairs))


def not_null_checks(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c} is null": F.col(c).isNull() for c in columns}


def blank_checks(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c} is blank": F.trim(F.col(c)) == "" for c in columns}


def finite_checks(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c} is not finite": F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf"))) for c in columns}


def unit_interval_checks(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c} outside 0..1": F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1) for c in columns}


def unique_check(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def fk_check(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Non-NULL child rows without a parent. Child keys are counted before the join."""
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    lost = keys.join(parent.select(F.col(parent_key).alias("_key")), "_key", "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def report(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


class ContractError(ValueError):
    """A frame that breaks its output contract."""


def validate_output(df: DataFrame, contract: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Compare names and types with the contract and look for NULLs in required columns.

    Returns the frame in contract order; one aggregate covers all required columns.
    """
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [f"{n}: {actual.get(n, 'missing')} instead of {k}" for n, k, _ in contract if actual.get(n) != k]
    extra = sorted(set(actual) - {n for n, _, _ in contract})
    if wrong or extra:
        raise ContractError(f"contract broken: {wrong}; unexpected columns: {extra}")
    required = [n for n, _, nullable in contract if not nullable]
    if required:
        nulls = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in required]).first().asDict()
        if any(nulls.values()):
            raise ContractError(f"NULLs in required columns: { {n: v for n, v in nulls.items() if v} }")
    return df.select(*[n for n, _, _ in contract])


def forecast_checks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    c = F.col
    rows = row_checks(
        df.withColumn("_step", F.datediff("forecast_date", F.to_date("source_as_of"))),
        {
            "negative units": (c("predicted_units") < 0) | (c("lower_bound") < 0),
            "bounds out of order": (c("upper_bound") < c("lower_bound")) | (c("predicted_units") < c("lower_bound")) | (c("predicted_units") > c("upper_bound")),
            "negative error": c("mape") < 0, "no horizon": c("forecast_horizon_days") <= 0,
            "outside horizon": (c("_step") < 1) | (c("_step") > c("forecast_horizon_days")),
            "source after generation": c("source_as_of") > c("generated_at"),
        },
    )
    steps = df.select(*keys, "forecast_date", "forecast_horizon_days", F.datediff("forecast_date", F.to_date("source_as_of")).alias("_step"))
    per_key = dealt(steps, keys).groupBy(*keys).agg(
        F.countDistinct("forecast_date").alias("_dates"), F.min("_step").alias("_lo"), F.max("_step").alias("_hi"),
        F.min("forecast_horizon_days").alias("_hmin"), F.max("forecast_horizon_days").alias("_hmax"),
    )
    whole = row_checks(per_key, {"incomplete horizon": (c("_hmin") != c("_hmax")) | (c("_dates") != c("_hmax")) | (c("_lo") != 1) | (c("_hi") != c("_hmax"))})
    return report(rows, whole)


def segment_checks(df: DataFrame) -> DataFrame:
    c = F.col
    return row_checks(df, {
        "negative cluster": c("cluster_id") < 0, "negative recency": c("recency_days") < 0, "no purchases": c("frequency") <= 0,
        "no value": (c("monetary_value") <= 0) | (c("avg_order_value") <= 0), "dates out of order": c("first_purchase_date") > c("last_purchase_date"),
        "segmented after generation": c("segmented_at") > c("generated_at"),
    })


def churn_checks(df: DataFrame) -> DataFrame:
    c = F.col
    return row_checks(df, {
        "class not 0 or 1": ~c("churn_prediction").isin(0, 1), "actual label present": c("is_churned_actual").isNotNull(),
        "no window": c("churn_window_days") <= 0, "predicted after generation": c("prediction_date") > c("generated_at"),
        **unit_interval_checks(["churn_probability"]),
    })


def stockout_checks(df: DataFrame) -> DataFrame:
    c = F.col
    return row_checks(df, {
        "class not 0 or 1": ~c("stockout_predicted").isin(0, 1), "negative inventory": c("current_inventory") < 0,
        "negative demand": c("demand_velocity_daily") < 0, "negative days": c("days_of_inventory") < 0, "no rank": c("ranking") <= 0,
        "inventory after prediction": c("inventory_as_of") > c("predicted_at"), **unit_interval_checks(["stockout_probability"]),
    })


def event_contract(df: DataFrame, body: str, *, payload: str, known: Sequence[str], key: str) -> DataFrame:
    """First contract rule each JSON event breaks, or OK.

    The parser itself finds truncated text and values of the wrong type.
    """
    from aisleworks.sources.envelope import envelope_schema

    schema = envelope_schema(payload).add(T.StructField("_corrupt", T.StringType()))
    parsed = df.withColumn("_e", F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    e = lambda name: F.col(f"_e.{name}")
    verdict = (
        F.when(e("_corrupt").isNotNull() | F.col("_e").isNull(), "MALFORMED")
        .when(~F.coalesce(e("event_type").isin(list(known)), F.lit(False)), "UNKNOWN_EVENT")
        .when(e("payload").isNull() | e(f"payload.{key}").isNull(), "NULL_KEY")
        .when(e("ingest_timestamp").isNull(), "NO_EVENT_TIME")
        .when(~e("ingest_timestamp").endswith("Z") | e("ingest_timestamp").try_cast("timestamp").isNull(), "NOT_UTC")
        .otherwise("OK")
    )
    return parsed.withColumn("verdict", verdict).drop("_e")
