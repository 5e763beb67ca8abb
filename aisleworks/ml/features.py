"""Feature and label frames of the models; all of them checked against SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.operators.gold import ratio
from aisleworks.operators.ranges import explode_snapshots, prior_history, snapshot_grid
from aisleworks.session import written


def churn_features(sales: DataFrame, *, first: Column, last: Column, every: int, behind: int) -> DataFrame:
    """Spending features per customer and snapshot over the look-back window.

    ``sales``: customer_id, event_date, cents, category. Days are summed before they are
    copied to snapshots; exact decimal moments make deviation independent of row order.
    """
    c = F.col
    square = c("cents").cast("decimal(19,0)") * c("cents").cast("decimal(19,0)")
    daily = sales.groupBy("customer_id", "event_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.sum(square).alias("squares")
    )
    spent = explode_snapshots(daily, "event_date", first, last, every=every, behind=behind).groupBy("customer_id", "snapshot_date").agg(
        F.sum("n").alias("purchases"), F.sum("cents").alias("spend_cents"), F.sum("squares").alias("_squares"),
        F.count(F.lit(1)).alias("active_days"), F.datediff("snapshot_date", F.max("event_date")).alias("recency_days"),
    )
    kinds = explode_snapshots(
        sales.select("customer_id", "event_date", "category").distinct(), "event_date", first, last, every=every, behind=behind
    ).groupBy("customer_id", "snapshot_date").agg(F.countDistinct("category").alias("categories"))
    n, total = c("purchases"), c("spend_cents").cast("double")
    variance = F.when(n > 1, (c("_squares").cast("double") - total * total / n) / (n - 1))
    return (
        spent.join(kinds, ["customer_id", "snapshot_date"])
        .withColumn("avg_basket_cents", ratio(c("spend_cents"), n))
        .withColumn("basket_stddev", F.sqrt(F.when(variance < 0, 0.0).otherwise(variance)))
        .withColumn("basket_cv", F.try_divide(c("basket_stddev"), c("avg_basket_cents")))
        .drop("_squares")
    )


def churn_rows(customers: DataFrame, sales: DataFrame, *, first: Column, last: Column, every: int, behind: int) -> DataFrame:
    """``churn_features`` for every customer at every snapshot, lapsed and never active ones included.

    Without a purchase in the look-back, counts, sums and the figures of the basket are zero;
    ``recency_days`` then reaches back to the last purchase before it. A customer without any
    purchase so far has one day more than the history from ``first - behind`` on is long.
    """
    c = F.col
    keys = ["customer_id", "snapshot_date"]
    everyone = customers.select("customer_id").unionByName(sales.select("customer_id")).where("customer_id IS NOT NULL").distinct()
    base = F.unix_date(first)
    step = F.greatest(F.lit(0), F.ceil((F.unix_date("event_date") + 1 - base) / F.lit(every)).cast("int"))
    newest = sales.withColumn("snapshot_date", F.date_from_unix_date(base + step * every)).groupBy(*keys).agg(F.max("event_date").alias("_last"))
    features = churn_features(sales, first=first, last=last, every=every, behind=behind).drop("recency_days")
    # One row per snapshot in each window, so its size is bounded by the calendar.
    so_far = F.max("_last").over(Window.partitionBy("customer_id").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0))
    none = F.datediff("snapshot_date", F.date_sub(first, behind)) + 1
    return (
        snapshot_grid(everyone, first, last, every=every).join(newest, keys, "left")
        .withColumn("recency_days", F.coalesce(F.datediff(c("snapshot_date"), so_far), none)).drop("_last")
        .join(features, keys, "left")
        .fillna(0, ["purchases", "spend_cents", "active_days", "categories", "avg_basket_cents", "basket_stddev", "basket_cv"])
    )


def churn_labels(sales: DataFrame, *, first: Column, last: Column, every: int, ahead: int) -> DataFrame:
    """1 when the customer buys nothing in the ``ahead`` days from the snapshot on."""
    days = sales.select("customer_id", "event_date").distinct()
    bought = explode_snapshots(days, "event_date", first, last, every=every, behind=0, ahead=ahead).select(
        "customer_id", "snapshot_date", F.lit(0).alias("churned")
    ).distinct()
    grid = snapshot_grid(sales.select("customer_id").distinct(), first, last, every=every)
    return grid.join(bought, ["customer_id", "snapshot_date"], "left").fillna(1, ["churned"])


def stockout_features(daily: DataFrame, keys: Sequence[str], *, horizon: int) -> DataFrame:
    """Trailing demand and the forward stock-out label per key and day.

    ``daily`` holds one row per key and day with movement (snapshot_date, on_hand, demand),
    so the day-range windows are bounded by the calendar.
    """
    day = F.unix_date("snapshot_date")
    w = Window.partitionBy(*keys).orderBy(day)
    trailing = lambda days: F.sum("demand").over(w.rangeBetween(-(days - 1), 0))
    ahead = F.min("on_hand").over(w.rangeBetween(1, horizon))
    return daily.select(
        "*", *[trailing(n).alias(f"demand_{n}d") for n in (7, 14, 30)], F.dayofweek("snapshot_date").alias("day_of_week"),
        F.when(ahead <= 0, 1).otherwise(0).alias("stockout"),
    ).withColumn("demand_velocity_daily", F.col("demand_30d") / F.lit(30)).withColumn(
        "days_of_inventory", F.try_divide(F.col("on_hand"), F.col("demand_velocity_daily"))
    )


def dwell_features(arrivals: DataFrame, completed: DataFrame) -> DataFrame:
    """Prior average dwell overall, per site and per hour, known strictly before the arrival.

    ``completed`` rows become history when their truck has left. Only what differs goes through the
    ordered pass: history summed by time, site and weekday, and each arrival time of a site once. Its
    result is written, so that the planner knows its size when the arrivals look their figures up.
    """
    keys = ["arrived", "site", "weekday"]
    history = completed.groupBy("departed", "site", "weekday").agg(F.count("dwell_minutes").alias("_stays"), F.sum("dwell_minutes").alias("dwell_minutes"))
    known = written(prior_history(
        arrivals.select(*keys).distinct(), history, target_at="arrived", history_at="departed", value="dwell_minutes",
        groups={"all": [], "site": ["site"], "weekday": ["weekday"]}, count="_stays",
    ), "dwell-history")
    same = [arrivals[c].eqNullSafe(known[c]) for c in keys]
    found = arrivals.join(known, same).select(*[arrivals[c] for c in arrivals.columns], *[known[c] for c in known.columns if c not in keys])
    return found.select("*", *[ratio(F.col(f"{p}_sum"), F.col(f"{p}_count")).alias(f"{p}_mean") for p in ("all", "site", "weekday")])
