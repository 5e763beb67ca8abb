"""Last-touch marketing attribution with money reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleworks.operators.gold import latest_per_key, trailing_filter
from aisleworks.operators.ranges import DAY_SECONDS, asof_last, within_tolerance

# Fixed values of the attribution contract.
MODEL = "LAST_TOUCH_7D"
WINDOW_DAYS = 7
TOUCH_COLUMNS = ["touch_ts", "impression_id", "campaign_id", "channel"]


def attribution_id() -> Column:
    return F.concat(F.lit("ATTR-"), F.col("purchase_type"), F.lit("-"), F.col("purchase_key").cast("string"))


def union_purchases(store: DataFrame, online: DataFrame) -> DataFrame:
    """Store receipts and online orders in one shape, each with its own id column."""
    s = store.withColumn("purchase_type", F.lit("STORE")).withColumn("receipt_id", F.col("purchase_key"))
    o = online.withColumn("purchase_type", F.lit("ONLINE")).withColumn("order_id", F.col("purchase_key"))
    return s.unionByName(o, allowMissingColumns=True)


def money_holds() -> Column:
    return (F.col("gross_cents") - F.col("discount_cents") == F.col("subtotal_cents")) & (
        F.col("subtotal_cents") + F.col("tax_cents") == F.col("total_cents")
    )


def _true(condition: Column) -> Column:
    """NULL counts as not fulfilled."""
    return F.coalesce(condition, F.lit(False))


def _latest_touch(touches: DataFrame) -> DataFrame:
    return latest_per_key(touches, ["journey_id"], [F.desc("touch_ts"), F.desc("impression_id")]).select(
        "journey_id", *TOUCH_COLUMNS, "touch_customer_id"
    )


def _finish(df: DataFrame) -> DataFrame:
    hit = F.col("attribution_status") == "ATTRIBUTED"
    return df.select(
        attribution_id().alias("attribution_id"), "journey_id", "attribution_status",
        F.lit(MODEL).alias("attribution_model"), F.lit(WINDOW_DAYS).alias("attribution_window_days"),
        *TOUCH_COLUMNS, "customer_id", "purchase_ts", "lag_seconds", "purchase_type", "purchase_key",
        "gross_cents", "discount_cents", "subtotal_cents", "tax_cents", "total_cents", "payment_cents",
        F.when(hit, F.col("subtotal_cents")).otherwise(F.lit(0)).cast("bigint").alias("attributed_revenue_cents"),
    )


def by_customer(purchases: DataFrame, touches: DataFrame) -> DataFrame:
    """Gold form: the latest touch of the customer that lies within the window decides.

    ``purchases`` carry payment_status and payment_cents. A declined payment or broken sums
    outrank the question whether a touch exists.
    """
    columns = purchases.columns
    matched = within_tolerance(
        asof_last(
            purchases, touches, key="match_key", at="purchase_ts", touch_at="touch_ts", touch_id="impression_id",
            carry=["campaign_id", "channel"], purchase_id="purchase_key",
        ),
        at="purchase_ts", touch_at="touch_ts", matched_columns=TOUCH_COLUMNS, seconds=WINDOW_DAYS * DAY_SECONDS,
    )
    status = (
        F.when(~_true(F.col("payment_status") == "APPROVED"), "PAYMENT_DECLINED")
        .when(~_true((F.col("payment_cents") == F.col("total_cents")) & money_holds()), "RECONCILIATION_FAILED")
        .when(F.col("touch_ts").isNull(), "UNATTRIBUTED_NO_JOURNEY")
        .otherwise("ATTRIBUTED")
    )
    hit = F.col("attribution_status") == "ATTRIBUTED"
    judged = matched.withColumn("attribution_status", status)
    judged = judged.select(
        *columns, "attribution_status", *[F.when(hit, F.col(c)).alias(c) for c in TOUCH_COLUMNS]
    )
    return _finish(
        judged.withColumn("lag_seconds", F.unix_seconds("purchase_ts") - F.unix_seconds("touch_ts"))
        .withColumn("journey_id", F.when(hit, F.col("match_key").cast("string")))
    )


def latest_payment(payments: DataFrame, key: str) -> DataFrame:
    return latest_per_key(payments, [key], [F.desc("payment_ts"), F.desc("transaction_id")]).select(
        key, "payment_status", "payment_cents"
    )


def by_journey_strict(
    purchases: DataFrame, touches: DataFrame, payments: DataFrame, promotions: DataFrame, *, report_shared: bool = False,
) -> DataFrame:
    """Silver form: only fully reconciled journeys, plus reconciled purchases without one.

    Two purchases on one journey would double its revenue. They make the run fail, or with
    ``report_shared`` stand in the result, where reconciled, as unattributed with a status of
    their own.
    """
    linked = purchases.where(F.col("journey_id").isNotNull())
    per_key = linked.groupBy("journey_id").agg(F.count(F.lit(1)).alias("_n"))
    apart = purchases.where(F.col("journey_id").isNull())
    if report_shared:
        shared = per_key.where("_n > 1").select("journey_id")
        apart = apart.unionByName(linked.join(shared, "journey_id", "left_semi"))
        linked = linked.join(per_key.where("_n = 1").select("journey_id"), "journey_id", "left_semi")
    elif not per_key.where("_n > 1").isEmpty():
        raise ValueError("several purchases share one attribution journey")
    paid = latest_payment(payments, "purchase_key")
    per_journey = promotions.where("journey_id IS NOT NULL").groupBy("journey_id").agg(F.sum("promo_cents").alias("promo_cents"))
    per_purchase = promotions.groupBy("purchase_key").agg(F.sum("promo_cents").alias("promo_cents"))
    settled = (
        (F.col("payment_status") == "APPROVED")
        & (F.col("payment_cents") == F.col("total_cents"))
        & (F.coalesce(F.col("promo_cents"), F.lit(0)) == F.col("discount_cents"))
        & money_holds()
    )
    complete = (
        linked.join(_latest_touch(touches), "journey_id")
        .join(paid, "purchase_key")
        .join(per_journey, "journey_id", "left")
        .withColumn("lag_seconds", F.unix_seconds("purchase_ts") - F.unix_seconds("touch_ts"))
        .where(settled & F.col("lag_seconds").between(0, WINDOW_DAYS * DAY_SECONDS) & (F.col("customer_id") == F.col("touch_customer_id")))
        .withColumn("attribution_status", F.lit("ATTRIBUTED"))
    )
    loose = (
        apart.join(paid, "purchase_key")
        .join(per_purchase, "purchase_key", "left")
        .where(settled)
        .withColumn("attribution_status", F.when(F.col("journey_id").isNull(), "UNATTRIBUTED_NO_JOURNEY").otherwise("UNATTRIBUTED_SHARED_JOURNEY"))
    )
    return _finish(complete.unionByName(loose, allowMissingColumns=True))


def by_journey_labelled(purchases: DataFrame, touches: DataFrame, payments: DataFrame, promotions: DataFrame) -> DataFrame:
    """Live form: every journey's latest purchase, labelled with the first check it fails."""
    newest = latest_per_key(
        purchases.where("journey_id IS NOT NULL"), ["journey_id", "purchase_type"], [F.desc("purchase_ts"), F.desc("purchase_key")]
    )
    paid = latest_payment(payments.where("journey_id IS NOT NULL"), "journey_id")
    promo = promotions.where("journey_id IS NOT NULL").groupBy("journey_id").agg(F.sum("promo_cents").alias("promo_cents"))
    joined = (
        newest.join(_latest_touch(touches), "journey_id", "left")
        .join(paid, "journey_id", "left")
        .join(promo, "journey_id", "left")
        .withColumn("lag_seconds", F.unix_seconds("purchase_ts") - F.unix_seconds("touch_ts"))
    )
    status = (
        F.when(~_true(F.col("lag_seconds").between(0, WINDOW_DAYS * DAY_SECONDS)), "OUTSIDE_WINDOW")
        .when(~_true((F.col("payment_status") == "APPROVED") & (F.col("payment_cents") == F.col("total_cents"))), "RECONCILIATION_FAILED")
        .when(~_true(F.coalesce(F.col("promo_cents"), F.lit(0)) == F.col("discount_cents")), "PROMOTION_MISMATCH")
        .when(~_true(money_holds()), "MONEY_MISMATCH")
        .otherwise("ATTRIBUTED")
    )
    return _finish(joined.withColumn("attribution_status", status))


def in_window(attributed: DataFrame, campaign: str, hours: int) -> DataFrame:
    return attributed.where((F.col("campaign_id") == campaign) & (F.col("lag_seconds") <= hours * 3600))


def reconciliation(attributed: DataFrame) -> DataFrame:
    """The three sums that must be zero on a clean purchase."""
    return attributed.select(
        "attribution_id", "attribution_status", "purchase_ts", "campaign_id",
        (F.col("gross_cents") - F.col("discount_cents") - F.col("subtotal_cents")).alias("gross_discount_net_delta"),
        (F.col("subtotal_cents") + F.col("tax_cents") - F.col("total_cents")).alias("net_tax_total_delta"),
        (F.col("payment_cents") - F.col("total_cents")).alias("payment_total_delta"),
    )


def touches_in_lookback(touches: DataFrame, attributed: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Recent touches plus older ones that led to a purchase in the look-back."""
    recent = trailing_filter(touches, "touch_ts", as_of, hours)
    older = touches.where(F.col("touch_ts") <= as_of - F.make_dt_interval(hours=F.lit(hours))).join(
        attributed.select("impression_id").where("impression_id IS NOT NULL"), "impression_id", "left_semi"
    )
    return recent.unionByName(older)
