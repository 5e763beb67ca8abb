"""Raw events to conformed facts: pure projections, one pass over the scan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(df: DataFrame, amount: str, exact: str) -> Column:
    """Integer cents: the exact column when filled, else the rounded decimal amount."""
    return F.coalesce(F.col(exact), F.round(F.col(amount) * 100).cast("bigint"))


def as_text(amount_cents: Column) -> Column:
    return F.format_string("%.2f", amount_cents / F.lit(100.0))


def money_chain(df: DataFrame) -> DataFrame:
    """Fill gross, discount, net, tax and total cents from whatever the event carries."""
    return (
        df.withColumn("net_c", money(df, "subtotal", "subtotal_cents"))
        .withColumn("disc_c", F.coalesce(F.col("discount_cents"), F.lit(0).cast("bigint")))
        .withColumn("tax_c", money(df, "tax", "tax_cents"))
        .withColumn("gross_c", F.coalesce(F.col("gross_subtotal_cents"), F.col("net_c") + F.col("disc_c")))
        .withColumn("total_c", F.coalesce(F.col("total_cents"), F.col("net_c") + F.col("tax_c")))
    )


_MONEY_OUT = {
    "gross_c": "gross_subtotal_cents", "disc_c": "discount_cents", "net_c": "subtotal_cents",
    "tax_c": "tax_cents", "total_c": "total_cents",
}
_AMOUNT_OUT = {"disc_c": "discount_amount", "net_c": "subtotal_amount", "tax_c": "tax_amount", "total_c": "total_amount"}


def _money_columns() -> list[Column]:
    return [F.col(c).alias(n) for c, n in _MONEY_OUT.items()] + [as_text(F.col(c)).alias(n) for c, n in _AMOUNT_OUT.items()]


def receipts(df: DataFrame) -> DataFrame:
    return money_chain(df).selectExpr(
        "*", "ingest_timestamp AS event_ts", "to_date(ingest_timestamp) AS event_date"
    ).select(
        "event_ts", "event_date", F.col("receipt_id").alias("receipt_id_ext"), "store_id", "customer_id",
        F.lit("SALE").alias("receipt_type"), "tender_type", F.col("tender_type").alias("payment_method"),
        *_money_columns(),
        F.col("correlation_id").alias("attribution_journey_id"), "campaign_id", "trace_id",
    )


def online_orders(df: DataFrame) -> DataFrame:
    return money_chain(df).select(
        F.col("ingest_timestamp").alias("event_ts"), F.to_date("ingest_timestamp").alias("event_date"),
        F.col("order_id").alias("order_id_ext"), F.col("customer_id").cast("bigint").alias("customer_id"),
        "fulfillment_mode", "node_type", F.col("node_id").cast("bigint").alias("node_id"),
        F.col("item_count").cast("int").alias("item_count"), F.col("tender_type").alias("payment_method"),
        *_money_columns(), F.col("correlation_id").alias("attribution_journey_id"), "campaign_id",
    )


# Output column -> SQL expression over the raw event, per fact.
PROJECTIONS: dict[str, dict[str, str]] = {
    "receipt_lines": {
        "receipt_id_ext": "receipt_id", "event_ts": "ingest_timestamp", "event_date": "to_date(ingest_timestamp)",
        "product_id": "cast(product_id AS bigint)", "line_num": "cast(line_number AS int)",
        "quantity": "cast(quantity AS int)", "unit_price": "unit_price", "ext_price": "extended_price",
        "unit_cents": "cast(round(unit_price * 100) AS bigint)",
        "ext_cents": "cast(round(extended_price * 100) AS bigint)", "promo_code": "promo_code",
    },
    "payments": {
        "event_ts": "ingest_timestamp", "event_date": "to_date(ingest_timestamp)", "payment_id": "transaction_id",
        "receipt_id_ext": "receipt_id", "order_id_ext": "order_id", "payment_method": "payment_method",
        "amount_cents": "cast(amount_cents AS bigint)", "transaction_id": "transaction_id",
        "processing_time_ms": "cast(processing_time_ms AS bigint)", "status": "status",
        "decline_reason": "decline_reason", "store_id": "cast(store_id AS bigint)",
        "customer_id": "cast(customer_id AS bigint)", "attribution_journey_id": "correlation_id",
    },
    "foot_traffic": {
        "event_ts": "ingest_timestamp", "event_date": "to_date(ingest_timestamp)", "store_id": "cast(store_id AS bigint)",
        "customer_id": "cast(NULL AS bigint)", "sensor_id": "sensor_id", "zone": "zone",
        "dwell_seconds": "cast(dwell_time AS int)", "count": "cast(customer_count AS int)", "trace_id": "trace_id",
    },
    "stockouts": {
        "event_ts": "ingest_timestamp", "store_id": "cast(store_id AS bigint)", "dc_id": "cast(dc_id AS bigint)",
        "product_id": "cast(product_id AS bigint)", "last_known_quantity": "cast(last_known_quantity AS int)",
        "detection_time": "detection_time", "trace_id": "trace_id",
    },
    "reorders": {
        "event_ts": "ingest_timestamp", "store_id": "cast(store_id AS bigint)", "dc_id": "cast(dc_id AS bigint)",
        "product_id": "cast(product_id AS bigint)", "current_quantity": "cast(current_quantity AS int)",
        "reorder_quantity": "cast(reorder_quantity AS int)", "reorder_point": "cast(reorder_point AS int)",
        "priority": "priority", "trace_id": "trace_id",
    },
    "marketing": {
        "event_ts": "ingest_timestamp", "event_date": "to_date(ingest_timestamp)", "channel": "channel",
        "campaign_id": "campaign_id", "creative_id": "creative_id", "customer_ad_id": "customer_ad_id",
        "impression_id_ext": "impression_id", "customer_id": "cast(customer_id AS double)",
        "cost_cents": "cast(round(cost * 100) AS bigint)", "device": "device_type",
        "attribution_journey_id": "correlation_id", "trace_id": "trace_id",
    },
    "promotions": {
        "event_ts": "ingest_timestamp", "event_date": "to_date(ingest_timestamp)", "promo_code": "promo_code",
        "store_id": "cast(store_id AS bigint)", "product_ids": "product_ids", "discount_type": "discount_type",
        "discount_cents": "cast(discount_cents AS bigint)", "product_count": "cast(product_count AS bigint)",
        "customer_id": "cast(customer_id AS bigint)", "receipt_id_ext": "receipt_id", "trace_id": "trace_id",
        "attribution_journey_id": "correlation_id",
    },
    "zone_changes": {
        "event_ts": "ingest_timestamp", "store_id": "cast(store_id AS bigint)", "customer_ble_id": "customer_ble_id",
        "from_zone": "from_zone", "to_zone": "to_zone", "trace_id": "trace_id",
    },
    "ble_pings": {
        "event_ts": "ingest_timestamp", "store_id": "cast(store_id AS bigint)", "beacon_id": "beacon_id",
        "customer_ble_id": "customer_ble_id", "rssi": "cast(rssi AS int)", "zone": "zone", "trace_id": "trace_id",
        "customer_id": "cast(NULL AS bigint)",
    },
    "store_ops": {
        "event_ts": "ingest_timestamp", "event_date": "to_date(ingest_timestamp)", "store_id": "cast(store_id AS bigint)",
        "operation_time": "operation_time", "operation_type": "operation_type", "trace_id": "trace_id",
    },
    "order_status": {
        "event_ts": "ingest_timestamp", "order_id_ext": "order_id", "node_type": "node_type",
        "node_id": "cast(node_id AS bigint)", "fulfillment_mode": "fulfillment_mode", "status_time": "status_time",
        "status": "status",
    },
    "inventory": {
        "event_ts": "ingest_timestamp", "store_id": "cast(store_id AS bigint)", "product_id": "cast(product_id AS bigint)",
        "txn_type": "reason", "quantity": "cast(quantity_delta AS bigint)", "source": "source", "trace_id": "trace_id",
    },
}


def project(df: DataFrame, fact: str) -> DataFrame:
    """The named fact's columns from its raw events."""
    return df.selectExpr(*[f"{expression} AS `{name}`" for name, expression in PROJECTIONS[fact].items()])


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Event types that feed one fact, told apart by a constant column."""
    tagged = [df.withColumn(tag, F.lit(value)) for value, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out
