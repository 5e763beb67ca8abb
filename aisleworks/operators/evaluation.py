"""Model evaluation as SQL aggregates, and chronological split labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brier(df: DataFrame, label: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col(probability) - F.col(label)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("brier"))


def error_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAPE over non-zero actuals, MAE and RMSE."""
    gap = F.col(predicted) - F.col(actual)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(actual) != 0, F.abs(gap / F.nullif(F.col(actual), F.lit(0))))).alias("mape"),
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )


def interval_coverage(df: DataFrame, actual: str, lower: str, upper: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col(actual).between(F.col(lower), F.col(upper))) / F.count(F.lit(1))).alias("coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias("mean_width"),
    )


def split_cutoffs(df: DataFrame, date: str, *, train: float, calibration: float) -> tuple[Column, Column]:
    """Cut-off dates that leave the given shares of the distinct dates before them.

    A date column has few distinct values, so the sorted list stays small.
    """
    days = df.select(date).distinct().agg(F.sort_array(F.collect_list(date)).alias("_d"))
    at = lambda share: days.select(F.col("_d")[F.greatest(F.lit(0), F.ceil(F.size("_d") * F.lit(share)).cast("int") - 1)]).scalar()
    return at(train), at(train + calibration)


def assign_chronological_split(
    df: DataFrame, date: str, *, train_until: Column, calibration_until: Column, embargo_days: int
) -> DataFrame:
    """Label rows by the day their label is known.

    Rows within the embargo after a cut-off belong to no set: their look-ahead overlaps the
    set before.
    """
    d = F.col(date)
    return df.withColumn(
        "split",
        F.when(d <= train_until, "train").when(d <= F.date_add(train_until, embargo_days), "embargo")
        .when(d <= calibration_until, "calibration").when(d <= F.date_add(calibration_until, embargo_days), "embargo").otherwise("test"),
    )
