"""KPI measures: additive sums first, ratios from the sums, never averages of averages.

Every function takes the frames of one subject and optional slicing columns ``by``, and
returns one row per slice. Numbers that come from another subject are passed as columns
(usually scalar subqueries).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.operators.gold import dollars, or_zero, ratio


def divide(top: Column, bottom: Column) -> Column:
    """Ratio that is 0 when the divisor is 0 or missing."""
    return or_zero(ratio(top, bottom))


def measures(df: DataFrame, by: Sequence[str], sums: dict[str, Column], derived: dict[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """Aggregate once, then derive ratios from the aggregated columns, in the given order."""
    out = df.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
    for name, column in derived.items():
        out = out.withColumn(name, column)
    return out.drop(*drop)


def total(name: str, where: Column | None = None) -> Column:
    column = F.col(name) if where is None else F.when(where, F.col(name))
    return F.coalesce(F.sum(column), F.lit(0))


N = F.count


def rows() -> Column:
    return F.count(F.lit(1))


def store_sales(receipts: DataFrame, *, line_revenue: Column, stores: Column, customers: Column, by: Sequence[str] = ()) -> DataFrame:
    c = F.col
    return measures(
        receipts, by,
        {
            "total_sales": dollars(total("total_cents")), "total_tax": dollars(total("tax_cents")),
            "total_subtotal": dollars(total("subtotal_cents")), "receipt_count": rows(),
            "total_returns": dollars(total("total_cents", c("receipt_type") == "RETURN")),
        },
        {
            "average_basket_size": divide(c("total_sales"), c("receipt_count")), "net_sales": line_revenue,
            "sales_per_store": divide(c("net_sales"), stores), "sales_per_customer": divide(c("net_sales"), customers),
            "return_rate": divide(F.abs("total_returns"), c("total_sales")),
        },
    )


def line_margin(lines: DataFrame, products: DataFrame, *, receipts: Column, by: Sequence[str] = ()) -> DataFrame:
    """Cost is looked up per product; lines of unknown products cost nothing."""
    c = F.col
    costed = lines.join(products.select("product_id", "cost_cents"), "product_id", "left").withColumn(
        "line_cost_cents", c("quantity") * F.coalesce("cost_cents", F.lit(0))
    )
    return measures(
        costed, by,
        {
            "total_units_sold": total("quantity"), "line_revenue": dollars(total("ext_cents")), "total_lines": rows(),
            "line_cost": dollars(total("line_cost_cents")),
        },
        {
            "average_unit_price": divide(c("line_revenue"), c("total_units_sold")), "gross_profit": c("line_revenue") - c("line_cost"),
            "gross_margin": divide(c("gross_profit"), c("line_revenue")), "units_per_receipt": divide(c("total_units_sold"), receipts),
        },
    )


def online(headers: DataFrame, lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Headers and lines are summed separately on the slice, then joined one to one."""
    c = F.col
    head = measures(
        headers, by,
        {"total_online_sales": dollars(total("total_cents")), "total_online_tax": dollars(total("tax_cents")),
         "total_online_subtotal": dollars(total("subtotal_cents")), "online_order_count": rows()},
        {"average_online_order_value": divide(c("total_online_sales"), c("online_order_count"))},
    )
    body = measures(
        lines, by, {"total_online_units": total("quantity"), "online_line_revenue": dollars(total("ext_cents"))},
        {"average_online_unit_price": divide(c("online_line_revenue"), c("total_online_units"))},
    )
    both = head.join(body, list(by), "left") if by else head.withColumns({n: body.select(n).scalar() for n in body.columns})
    return both.withColumn("online_units_per_order", divide(c("total_online_units"), c("online_order_count")))


def omnichannel(stores: DataFrame, web: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both channels on a shared grain; each side has net revenue, units and orders."""
    c = F.col
    joined = stores.join(web, list(by), "full_outer").fillna(0)
    return (
        joined.withColumn("omnichannel_revenue", c("store_revenue") + c("online_revenue"))
        .withColumn("omnichannel_orders", c("store_orders") + c("online_orders"))
        .withColumn("omnichannel_units", c("store_units") + c("online_units"))
        .withColumn("omnichannel_aov", divide(c("omnichannel_revenue"), c("omnichannel_orders")))
        .withColumn("store_share", divide(c("store_revenue"), c("omnichannel_revenue")))
        .withColumn("online_share", divide(c("online_revenue"), c("omnichannel_revenue")))
        .withColumn("online_units_share", divide(c("online_units"), c("omnichannel_units")))
    )


def payments(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = F.col
    return measures(
        df, by,
        {
            "total_amounts": dollars(total("amount_cents")), "payment_count": rows(), "approved_payment_count": F.count_if(c("status") == "APPROVED"),
            "declined_payment_count": F.count_if(c("status") == "DECLINED"), "avg_processing_ms": F.avg("processing_time_ms"),
        },
        {"payment_decline_rate": divide(c("declined_payment_count"), c("payment_count"))},
    )


def inventory(position: DataFrame, products: DataFrame, *, dc_units: Column, dc_skus: Column, net_sales: Column, transactions: Column, quantity_delta: Column) -> DataFrame:
    c = F.col
    priced = position.join(products.select("product_id", "cost_cents", "sale_cents"), "product_id", "left").withColumns(
        {"value_cents": c("on_hand") * F.coalesce("cost_cents", F.lit(0)), "retail_cents": c("on_hand") * F.coalesce("sale_cents", F.lit(0))}
    )
    return measures(
        priced, [],
        {"total_units_on_hand": total("on_hand"), "total_inventory_value": dollars(total("value_cents")),
         "total_inventory_retail_value": dollars(total("retail_cents")), "store_sku_count": F.countDistinct("product_id")},
        {
            "avg_store_units_per_sku": divide(c("total_units_on_hand"), c("store_sku_count")),
            "inventory_margin_value": c("total_inventory_retail_value") - c("total_inventory_value"),
            "inventory_margin": divide(c("inventory_margin_value"), c("total_inventory_retail_value")),
            "dc_units_on_hand": dc_units, "dc_sku_count": dc_skus, "avg_dc_units_per_sku": divide(c("dc_units_on_hand"), c("dc_sku_count")),
            "network_units_on_hand": c("total_units_on_hand") + c("dc_units_on_hand"),
            "inventory_to_sales_ratio": divide(c("total_inventory_retail_value"), net_sales),
            "total_inventory_transactions": transactions, "total_quantity_delta": quantity_delta,
        },
    )


def attribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = F.col
    hit = c("attribution_status") == "ATTRIBUTED"
    return measures(
        df, by,
        {
            "attributed_revenue": dollars(total("attributed_revenue_cents")), "attributed_purchases": F.count_if(hit),
            "unattributed_purchases": F.count_if(~hit), "discount_amount": dollars(total("discount_cents")),
            "attributed_tax": dollars(total("tax_cents", hit)), "attributed_payments": dollars(total("payment_cents", hit)),
            "payment_variance": dollars(total("payment_cents") - total("total_cents")),
            "average_lag_hours": or_zero(F.try_divide(F.avg("lag_seconds"), F.lit(3600.0))),
        },
        {"attribution_rate": divide(c("attributed_purchases"), c("attributed_purchases") + c("unattributed_purchases"))},
    )


def campaign(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = F.col
    return measures(
        daily, by,
        {"spend": dollars(total("spend_cents")), "impressions": total("impressions"), "conversions": total("conversions"),
         "attributed_revenue": dollars(total("attributed_revenue_cents"))},
        {"conversion_rate": divide(c("conversions"), c("impressions")), "roas": divide(c("attributed_revenue"), c("spend"))},
    )


def marketing(cost_daily: DataFrame, channel_touches: DataFrame, *, omnichannel_revenue: Column) -> DataFrame:
    """``marketing_spend_channel`` counts only campaigns that occur in ``channel_touches``."""
    c = F.col
    selected = cost_daily.join(channel_touches.select("campaign_id"), "campaign_id", "left_semi").agg(dollars(total("cost_cents"))).scalar()
    return measures(
        cost_daily, [], {"total_marketing_cost": dollars(total("cost_cents")), "total_marketing_impressions": total("impressions")},
        {
            "marketing_cpm": divide(c("total_marketing_cost") * 1000, c("total_marketing_impressions")),
            "marketing_spend_of_revenue": divide(c("total_marketing_cost"), omnichannel_revenue), "marketing_spend_channel": F.coalesce(selected, F.lit(0.0)),
        },
    )


def logistics(dwell_daily: DataFrame, *, moves: Column, avg_unload: Column, breach_minutes: float = 45.0) -> DataFrame:
    """``dwell_daily`` carries dwell seconds and trucks, so the average is weighted exactly."""
    c = F.col
    return measures(
        dwell_daily, [],
        {
            "total_trucks": total("trucks"), "_seconds": total("dwell_seconds"),
            "breach_days": F.count_if(ratio(c("dwell_seconds"), c("trucks")) / 60.0 > breach_minutes), "_sites": F.countDistinct("site"),
        },
        {
            "avg_truck_dwell_minutes": divide(c("_seconds"), c("total_trucks")) / 60.0, "trucks_per_site": divide(c("total_trucks"), c("_sites")),
            "truck_move_count": moves, "avg_unload_duration": avg_unload,
        },
        drop=["_seconds", "_sites"],
    )


def weighted_zone(minutes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dwell weighted by customers from per-minute sums."""
    c = F.col
    return measures(
        minutes, by, {"zone_customers": total("customers"), "_x": F.sum(ratio(c("dwell"), c("n")) * c("customers"))},
        {"avg_zone_dwell": divide(F.round("_x", 6), c("zone_customers"))}, drop=["_x"],
    )


def promotions(lines: DataFrame, promos: DataFrame, by: Sequence[str]) -> DataFrame:
    a = measures(lines, by, {"promo_line_quantity": total("quantity"), "promo_line_discount": dollars(total("discount_cents"))}, {})
    b = measures(promos, by, {"promotion_count": rows(), "promotion_discount": dollars(total("discount_cents"))}, {})
    return a.join(b, list(by), "full_outer").fillna(0)


def reorders(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = F.col
    return measures(
        df, by,
        {
            "total_reorder_quantity": total("reorder_quantity"), "reorder_events": rows(),
            "high_priority_quantity": total("reorder_quantity", c("priority").isin("HIGH", "URGENT")),
            "reorder_fill_gap": F.sum(c("reorder_point") - c("current_quantity")),
        },
        {"avg_reorder_quantity": divide(c("total_reorder_quantity"), c("reorder_events"))},
    )


def stockouts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return measures(df, by, {"stockout_events": rows(), "avg_last_known_quantity": F.avg("last_known_quantity")}, {})


def store_ops(df: DataFrame, *, stores: Column, by: Sequence[str] = ()) -> DataFrame:
    return measures(df, by, {"operation_events": rows()}, {"operation_events_per_store": divide(F.col("operation_events"), stores)})


def foot_traffic(df: DataFrame, *, receipts: Column, by: Sequence[str] = ()) -> DataFrame:
    c = F.col
    return measures(
        df, by, {"foot_traffic_count": total("count"), "_dwell": total("dwell_seconds")},
        {"avg_dwell_minutes": divide(c("_dwell"), c("foot_traffic_count") * 60), "conversion_proxy": divide(receipts, c("foot_traffic_count"))},
        drop=["_dwell"],
    )


def churn(df: DataFrame, as_of: Column) -> DataFrame:
    c = F.col
    risky = c("churn_prediction") == 1
    return measures(
        df, [],
        {
            "customers_at_risk": F.countDistinct(F.when(risky, c("customer_id"))), "_all": F.countDistinct("customer_id"),
            "avg_churn_probability": F.round(F.avg("churn_probability"), 6),
            "high_risk_customers": F.countDistinct(F.when(c("risk_category").isin("High", "Very High"), c("customer_id"))),
            "data_as_of": F.max("prediction_date"),
        },
        {"predicted_churn_rate": divide(c("customers_at_risk"), c("_all")), "freshness_hours": hours_between(c("data_as_of"), as_of)}, drop=["_all"],
    )


def hours_between(start: Column, end: Column) -> Column:
    """Hour boundaries crossed, as the report counts freshness."""
    return (F.floor(F.unix_seconds(end) / F.lit(3600)) - F.floor(F.unix_seconds(start) / F.lit(3600))).cast("bigint")


def segments(df: DataFrame, as_of: Column) -> DataFrame:
    return measures(
        df, [],
        {
            "segmented_customers": F.countDistinct("customer_id"), "avg_recency_days": F.avg("recency_days"), "avg_frequency": F.avg("frequency"),
            "monetary_value": dollars(total("monetary_cents")), "avg_order_value": F.round(F.avg("avg_order_value"), 6), "data_as_of": F.max("segmented_at"),
        },
        {"freshness_hours": hours_between(F.col("data_as_of"), as_of)},
    )


def forecast(df: DataFrame, as_of: Column) -> DataFrame:
    return measures(
        df, [],
        {
            "forecasted_units": F.round(F.sum("predicted_units"), 4), "lower_bound": F.round(F.sum("lower_bound"), 4),
            "upper_bound": F.round(F.sum("upper_bound"), 4), "forecast_mape": F.round(F.avg("mape"), 6), "data_as_of": F.max("generated_at"),
        },
        {"freshness_hours": hours_between(F.col("data_as_of"), as_of)},
    )


def stockout_risk(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows are summed per store, product and horizon first; distinct counts are then plain ones."""
    means = ["stockout_probability", "days_of_inventory", "demand_velocity_daily"]
    grains = df.groupBy("store_id", "product_id", "forecast_horizon_days").agg(
        F.max(F.when(F.col("risk_level") == "HIGH", 1)).alias("_high"), F.max("inventory_as_of").alias("inventory_as_of"),
        *[f(c).alias(f"_{n}_{c}") for c in means for n, f in (("sum", F.sum), ("count", F.count))],
    )
    mean = lambda c: F.round(F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_count_{c}")), 6)
    return measures(
        grains, [],
        {
            "risk_sku_count": rows(), "high_risk_skus": F.count("_high"),
            "avg_stockout_probability": mean("stockout_probability"), "avg_days_of_inventory": mean("days_of_inventory"),
            "avg_demand_velocity": mean("demand_velocity_daily"), "data_as_of": F.max("inventory_as_of"),
        },
        {"freshness_hours": hours_between(F.col("data_as_of"), as_of)},
    )


def date_spine(daily: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    """Dense daily rows from the first to the last observed date, zero-filled."""
    span = daily.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias(date))
    return days.join(daily.select(date, *values), date, "left").fillna(0, list(values))


def time_intelligence(spine: DataFrame, date: str, value: str) -> DataFrame:
    """To-date sums, shifted periods, growth and 7-day sums of one measure.

    A spine has one row per calendar day. Shifted values are equi-joins on the shifted date
    and the 7-day sum counts every day into the seven windows it belongs to, so no window
    spans the whole table. 29 February compares with 28 February.
    """
    c = F.col
    out = spine.select(date, value)
    for name, unit in (("mtd", "month"), ("qtd", "quarter"), ("ytd", "year")):
        w = Window.partitionBy(F.trunc(date, unit)).orderBy(date)
        out = out.withColumn(name, F.sum(value).over(w))
    base = spine.select(c(date).alias("_d"), c(value).alias("_v"))
    shifts = {"py": F.add_months(date, -12), "pm": F.add_months(date, -1), "pq": F.add_months(date, -3), "pd": F.date_sub(date, 1)}
    for name, shifted in shifts.items():
        side = base.select(c("_d").alias(f"_d{name}"), c("_v").alias(name))
        out = out.join(side, shifted == c(f"_d{name}"), "left").drop(f"_d{name}")
    week = base.select(F.explode(F.sequence("_d", F.date_add("_d", 6))).alias("_w"), "_v").groupBy("_w").agg(F.sum("_v").alias("last_7d"))
    out = out.join(week.select(c("_w").alias("_w0"), "last_7d"), c(date) == c("_w0"), "left").drop("_w0")
    out = out.join(week.select(c("_w").alias("_w1"), c("last_7d").alias("prior_7d")), F.date_sub(date, 7) == c("_w1"), "left").drop("_w1")
    growth = lambda now, then: ratio(c(now) - c(then), c(then))
    return out.withColumns({
        "yoy": growth(value, "py"), "mom": growth(value, "pm"), "qoq": growth(value, "pq"), "dod": growth(value, "pd"), "wow": growth("last_7d", "prior_7d"),
    })


def latest_and_prior_year(daily: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    newest = daily.select(F.year(F.max(date))).scalar()
    year = F.year(date)
    return daily.agg(
        F.max(year).cast("bigint").alias("latest_year"),
        *[F.sum(F.when(year == newest, F.col(v))).alias(f"{v}_latest_year") for v in values],
        *[F.sum(F.when(year == newest - 1, F.col(v))).alias(f"{v}_prior_year") for v in values],
    )
