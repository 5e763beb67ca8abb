"""Scalar helpers of the domain, all of them column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def portable_number(text: Column) -> Column:
    """40-bit number from MD5, reproducible in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("bigint")


def portable_uniform(text: Column) -> Column:
    """Draw in [0, 1) from MD5, reproducible in any SQL engine."""
    return portable_number(text) / F.lit(float(16**10))


def portable_normal(text: Column) -> Column:
    """Standard normal draw: Box-Muller on two draws of the same text."""
    radius, angle = (portable_uniform(F.concat(text, F.lit(part))) for part in ("|radius", "|angle"))
    return F.sqrt(F.log(1 - radius) * -2) * F.cos(angle * (2 * math.pi))


def weighted_pick(draw: Column, weighted: Sequence[tuple[str, int]]) -> Column:
    """Category whose share of the total weight the draw falls into."""
    shares = list(accumulate(weight for _, weight in weighted))
    return F.get(F.array(*[F.lit(value) for value, _ in weighted]), inverse_cdf_pick(draw * shares[-1], shares))


def inverse_cdf_pick(draw: Column, cumulative: Sequence[float]) -> Column:
    """0-based index of the first cumulative share above the draw."""
    below = F.filter(F.array(*[F.lit(float(c)) for c in cumulative]), lambda c: c <= draw)
    return F.least(F.size(below), F.lit(len(cumulative) - 1))


def tax_cents(amount: str, rate_bps: str, multiplier_pct: str) -> Column:
    """Tax in cents, rounded half up in pure integer arithmetic."""
    return F.expr(f"({amount} * {rate_bps} * {multiplier_pct} + 500000) div 1000000")


def bogo_discount(unit_cents: str, quantity: str) -> Column:
    """Every second unit is free."""
    return F.expr(f"{unit_cents} * ({quantity} div 2)")


def promo_eligible(month: Column, subtotal: Column, quantity: Column, *, months: Sequence[int], min_subtotal: int, min_quantity: int) -> Column:
    return month.isin(list(months)) & (subtotal >= min_subtotal) & (quantity >= min_quantity)


def date_dimension(span: DataFrame, first: str, last: str) -> DataFrame:
    """Calendar attributes for every day of a one-row span; the fiscal year starts in
    July and is named by the year it starts in.

    ``week_sunday`` counts weeks from the first Sunday of the year (0 before it).
    """
    d = F.col("date")
    days = span.select(F.explode(F.sequence(first, last)).alias("date"))
    return days.select(
        d, F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), F.year(d).alias("year"), F.quarter(d).alias("quarter"),
        F.month(d).alias("month"), F.dayofmonth(d).alias("day"), (F.weekday(d) + 1).alias("iso_day_of_week"),
        F.floor((F.dayofyear(d) + 6 - (F.dayofweek(d) - 1)) / 7).cast("int").alias("week_sunday"),
        F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "EEEE").alias("day_name"),
        F.year(F.add_months(d, -6)).alias("fiscal_year"), F.quarter(F.add_months(d, -6)).alias("fiscal_quarter"), F.dayofweek(d).isin(1, 7).alias("is_weekend"),
    )


def seeded_split(key: Column, seed: int, holdout_pct: int) -> Column:
    """train / holdout by a draw from the key, independent of row order and partitioning."""
    draw = portable_uniform(F.concat(key.cast("string"), F.lit(f"|holdout|{seed}")))
    return F.when(draw * 100 < holdout_pct, "holdout").otherwise("train")
