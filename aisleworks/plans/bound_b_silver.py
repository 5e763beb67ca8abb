"""Silver projections and alert rules on the fixture tables."""

from pyspark.sql import functions as F

from aisleworks.operators import rules, silver
from aisleworks.plans.registry import query

RAW_RECEIPT_SQL = """
WITH raw AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id, o_custkey % 50 AS store_id, o_orderdate AS ts, o_orderpriority AS tender_type,
         o_totalprice AS subtotal, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS s,
         'T' || CAST(o_orderkey AS VARCHAR) AS trace_id FROM orders),
filled AS (
  SELECT *, CASE WHEN s = 'P' THEN cents ELSE cents - 1 END AS net,
         CASE WHEN s = 'O' THEN 0 ELSE customer_id % 500 END AS disc,
         CASE WHEN s = 'F' THEN CAST(round(subtotal * 8) AS BIGINT) ELSE CAST(round(round(subtotal * 0.08, 2) * 100) AS BIGINT) END AS tax
  FROM raw)
"""


def raw_receipts(t, id_name):
    """Orders in the shape of the live receipt events; some money columns are unset."""
    o = t.orders
    whole = F.round(F.col("o_totalprice") * 100).cast("bigint")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias(id_name), F.col("o_custkey").alias("customer_id"),
        (F.col("o_custkey") % 50).alias("store_id"), F.col("o_orderdate").alias("ingest_timestamp"),
        F.col("o_orderpriority").alias("tender_type"), F.col("o_totalprice").alias("subtotal"),
        F.when(status != "P", whole - 1).alias("subtotal_cents"),
        F.when(status != "O", F.col("o_custkey") % 500).alias("discount_cents"),
        F.lit(None).cast("bigint").alias("gross_subtotal_cents"), F.lit(None).cast("bigint").alias("total_cents"),
        F.round(F.col("o_totalprice") * 0.08, 2).alias("tax"),
        F.when(status == "F", F.round(F.col("o_totalprice") * 8).cast("bigint")).alias("tax_cents"),
        F.lit(None).cast("string").alias("campaign_id"),
        F.when(status == "F", F.concat(F.lit("J"), F.col("o_custkey").cast("string"))).alias("correlation_id"),
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("trace_id"),
        F.when(F.col("o_custkey") % 2 == 0, "SHIP").otherwise("PICKUP").alias("fulfillment_mode"),
        F.when(F.col("o_custkey") % 3 == 0, "STORE").otherwise("DC").alias("node_type"),
        (F.col("o_custkey") % 20).alias("node_id"), (F.col("o_custkey") % 9).alias("item_count"),
    )


MONEY_SQL = """net + disc AS gross_subtotal_cents, disc AS discount_cents, net AS subtotal_cents, tax AS tax_cents,
       net + tax AS total_cents, printf('%.2f', disc / 100.0) AS discount_amount, printf('%.2f', net / 100.0) AS subtotal_amount,
       printf('%.2f', tax / 100.0) AS tax_amount, printf('%.2f', (net + tax) / 100.0) AS total_amount,
       CASE WHEN s = 'F' THEN 'J' || CAST(customer_id AS VARCHAR) END AS attribution_journey_id, CAST(NULL AS VARCHAR) AS campaign_id"""


@query("silver_receipts", RAW_RECEIPT_SQL + f"""
SELECT ts AS event_ts, CAST(ts AS DATE) AS event_date, id AS receipt_id_ext, store_id, customer_id, 'SALE' AS receipt_type,
       tender_type, tender_type AS payment_method, {MONEY_SQL}, trace_id FROM filled""")
def silver_receipts(t):
    return silver.receipts(raw_receipts(t, "receipt_id"))


@query("silver_online_created", RAW_RECEIPT_SQL + f"""
SELECT ts AS event_ts, CAST(ts AS DATE) AS event_date, id AS order_id_ext, customer_id,
       CASE WHEN customer_id % 2 = 0 THEN 'SHIP' ELSE 'PICKUP' END AS fulfillment_mode,
       CASE WHEN customer_id % 3 = 0 THEN 'STORE' ELSE 'DC' END AS node_type, customer_id % 20 AS node_id,
       CAST(customer_id % 9 AS INTEGER) AS item_count, tender_type AS payment_method, {MONEY_SQL} FROM filled""")
def silver_online_created(t):
    return silver.online_orders(raw_receipts(t, "order_id"))


@query("silver_receipt_lines", """
SELECT l_orderkey AS receipt_id_ext, l_shipdate AS event_ts, CAST(l_shipdate AS DATE) AS event_date, l_partkey AS product_id,
       l_linenumber AS line_num, CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice / l_quantity AS unit_price,
       l_extendedprice AS ext_price, CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS unit_cents,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS ext_cents, CASE WHEN l_discount > 0 THEN 'PROMO' END AS promo_code FROM lineitem""")
def silver_receipt_lines(t):
    raw = t.lineitem.select(
        F.col("l_orderkey").alias("receipt_id"), F.col("l_shipdate").alias("ingest_timestamp"),
        F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("extended_price"), F.when(F.col("l_discount") > 0, "PROMO").alias("promo_code"),
    )
    return silver.project(raw, "receipt_lines")


@query("silver_payments", """
SELECT event_ts, event_date, receipt_id AS payment_id, receipt_id AS receipt_id_ext, CAST(NULL AS BIGINT) AS order_id_ext, payment_method,
       total_cents AS amount_cents, receipt_id AS transaction_id, customer_id % 3000 AS processing_time_ms, payment_status AS status,
       CASE WHEN payment_status = 'DECLINED' THEN 'LIMIT' END AS decline_reason, customer_id % 50 AS store_id, customer_id,
       CAST(NULL AS VARCHAR) AS attribution_journey_id FROM v_receipts""")
def silver_payments(t):
    raw = t.receipts.select(
        F.col("event_ts").alias("ingest_timestamp"), F.col("receipt_id").alias("transaction_id"), "receipt_id",
        F.lit(None).cast("bigint").alias("order_id"), "payment_method", F.col("total_cents").alias("amount_cents"),
        (F.col("customer_id") % 3000).alias("processing_time_ms"), F.col("payment_status").alias("status"),
        F.when(F.col("payment_status") == "DECLINED", "LIMIT").alias("decline_reason"),
        (F.col("customer_id") % 50).alias("store_id"), "customer_id", F.lit(None).cast("string").alias("correlation_id"),
    )
    return silver.project(raw, "payments")


@query("silver_inventory", """
SELECT event_ts, store_id, product_id, line_type AS txn_type, CASE WHEN line_type = 'SALE' THEN -quantity ELSE quantity END AS quantity,
       'POS' AS source, CAST(receipt_id AS VARCHAR) AS trace_id FROM v_lines""")
def silver_inventory(t):
    raw = t.lines.select(
        F.col("event_ts").alias("ingest_timestamp"), "store_id", "product_id", F.col("line_type").alias("reason"),
        F.when(F.col("line_type") == "SALE", -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity_delta"),
        F.lit("POS").alias("source"), F.col("receipt_id").cast("string").alias("trace_id"),
    )
    return silver.project(raw, "inventory")


@query("silver_foot_traffic", """
SELECT ingest_timestamp AS event_ts, CAST(ingest_timestamp AS DATE) AS event_date, store_id, CAST(NULL AS BIGINT) AS customer_id,
       'S' || CAST(k AS VARCHAR) AS sensor_id, event_type AS zone, CAST(trunc(value) AS INTEGER) AS dwell_seconds,
       CAST(k % 7 AS INTEGER) AS count, trace_id FROM v_raw""")
def silver_foot_traffic(t):
    return silver.project(foot_traffic_raw(t.raw), "foot_traffic")


def foot_traffic_raw(raw):
    return raw.select(
        "ingest_timestamp", "store_id", F.concat(F.lit("S"), F.col("k").cast("string")).alias("sensor_id"),
        F.col("event_type").alias("zone"), F.col("value").alias("dwell_time"), (F.col("k") % 7).alias("customer_count"), "trace_id",
    )


@query("silver_stockouts", """
SELECT ingest_timestamp AS event_ts, store_id, dc_id, product_id, CAST(k % 4 AS INTEGER) AS last_known_quantity,
       ingest_timestamp AS detection_time, trace_id FROM v_raw WHERE event_type = 'error'""")
def silver_stockouts(t):
    return silver.project(stockout_raw(t.raw), "stockouts")


def stockout_raw(raw):
    return raw.where("event_type = 'error'").select(
        "ingest_timestamp", "store_id", "dc_id", "product_id", (F.col("k") % 4).alias("last_known_quantity"),
        F.col("ingest_timestamp").alias("detection_time"), "trace_id",
    )


@query("silver_reorders", """
SELECT ingest_timestamp AS event_ts, store_id, dc_id, product_id, CAST(k % 40 AS INTEGER) AS current_quantity,
       CAST(k + 10 AS INTEGER) AS reorder_quantity, 20 AS reorder_point,
       CASE WHEN k % 40 < 5 THEN 'URGENT' WHEN k % 40 < 12 THEN 'HIGH' ELSE 'NORMAL' END AS priority, trace_id
FROM v_raw WHERE event_type = 'signup'""")
def silver_reorders(t):
    return silver.project(reorder_raw(t.raw), "reorders")


def reorder_raw(raw):
    have = F.col("k") % 40
    return raw.where("event_type = 'signup'").select(
        "ingest_timestamp", "store_id", "dc_id", "product_id", have.alias("current_quantity"),
        (F.col("k") + 10).alias("reorder_quantity"), F.lit(20).alias("reorder_point"),
        F.when(have < 5, "URGENT").when(have < 12, "HIGH").otherwise("NORMAL").alias("priority"), "trace_id",
    )


@query("silver_store_ops", """
SELECT ts AS event_ts, CAST(ts AS DATE) AS event_date, store_id, ts AS operation_time, op AS operation_type, trace_id FROM (
  SELECT ingest_timestamp AS ts, store_id, trace_id, CASE event_type WHEN 'view' THEN 'opened' ELSE 'closed' END AS op
  FROM v_raw WHERE event_type IN ('view', 'click'))""")
def silver_store_ops(t):
    part = lambda kind: t.raw.where(F.col("event_type") == kind).withColumn("operation_time", F.col("ingest_timestamp"))
    return silver.project(silver.union_tagged({"opened": part("view"), "closed": part("click")}, "operation_type"), "store_ops")


@query("silver_marketing", """
SELECT touch_ts AS event_ts, CAST(touch_ts AS DATE) AS event_date, channel, campaign_id, 'CR' AS creative_id,
       'AD' || CAST(match_key AS VARCHAR) AS customer_ad_id, impression_id AS impression_id_ext, CAST(match_key AS DOUBLE) AS customer_id,
       cost_cents, 'PHONE' AS device, 'J' || CAST(match_key AS VARCHAR) AS attribution_journey_id,
       'T' || CAST(impression_id AS VARCHAR) AS trace_id FROM v_touches""")
def silver_marketing(t):
    raw = t.keyed_events.where(F.col("event_type").isin("view", "click")).select(
        F.col("ts").alias("ingest_timestamp"), F.col("event_type").alias("channel"),
        F.concat(F.lit("CAMP"), (F.col("k") % 10).cast("string")).alias("campaign_id"), F.lit("CR").alias("creative_id"),
        F.concat(F.lit("AD"), F.col("user_id").cast("string")).alias("customer_ad_id"), F.col("event_id").alias("impression_id"),
        F.col("user_id").alias("customer_id"), F.col("value").alias("cost"), F.lit("PHONE").alias("device_type"),
        F.concat(F.lit("J"), F.col("user_id").cast("string")).alias("correlation_id"),
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("trace_id"),
    )
    return silver.project(raw, "marketing")


@query("silver_promotions", """
SELECT event_ts, event_date, promo_code, store_id, CAST(product_id AS VARCHAR) AS product_ids, 'PERCENT' AS discount_type,
       discount_cents, CAST(1 AS BIGINT) AS product_count, CAST(NULL AS BIGINT) AS customer_id, receipt_id AS receipt_id_ext,
       CAST(receipt_id AS VARCHAR) AS trace_id, CAST(NULL AS VARCHAR) AS attribution_journey_id
FROM v_lines WHERE promo_code IS NOT NULL""")
def silver_promotions(t):
    raw = t.lines.where("promo_code IS NOT NULL").select(
        F.col("event_ts").alias("ingest_timestamp"), "promo_code", "store_id", F.col("product_id").cast("string").alias("product_ids"),
        F.lit("PERCENT").alias("discount_type"), "discount_cents", F.lit(1).alias("product_count"),
        F.lit(None).cast("bigint").alias("customer_id"), "receipt_id", F.col("receipt_id").cast("string").alias("trace_id"),
        F.lit(None).cast("string").alias("correlation_id"),
    )
    return silver.project(raw, "promotions")


@query("silver_zone_changes", """
SELECT event_ts, store_id, customer_ble_id, from_zone, to_zone, 'T' || CAST(event_id AS VARCHAR) AS trace_id FROM v_zone_changes""")
def silver_zone_changes(t):
    raw = t.zone_changes.select(
        F.col("event_ts").alias("ingest_timestamp"), "store_id", "customer_ble_id", "from_zone", "to_zone",
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("trace_id"),
    )
    return silver.project(raw, "zone_changes")


@query("silver_ble", """
SELECT event_ts, store_id, 'B' || zone AS beacon_id, customer_ble_id, CAST(-40 - event_id % 50 AS INTEGER) AS rssi, zone,
       'T' || CAST(event_id AS VARCHAR) AS trace_id, CAST(NULL AS BIGINT) AS customer_id FROM v_pings""")
def silver_ble(t):
    raw = t.pings.select(
        F.col("event_ts").alias("ingest_timestamp"), "store_id", F.concat(F.lit("B"), F.col("zone")).alias("beacon_id"),
        "customer_ble_id", (-40 - F.col("event_id") % 50).alias("rssi"), "zone",
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("trace_id"),
    )
    return silver.project(raw, "ble_pings")


@query("silver_order_status", """
SELECT event_ts, receipt_id AS order_id_ext, CASE WHEN customer_id % 3 = 0 THEN 'STORE' ELSE 'DC' END AS node_type,
       customer_id % 20 AS node_id, 'SHIP' AS fulfillment_mode, event_ts AS status_time,
       CASE payment_status WHEN 'APPROVED' THEN 'SHIPPED' ELSE 'PICKED' END AS status
FROM v_receipts WHERE payment_status IN ('APPROVED', 'PENDING')""")
def silver_order_status(t):
    def part(state):
        return t.receipts.where(F.col("payment_status") == state).select(
            F.col("event_ts").alias("ingest_timestamp"), F.col("receipt_id").alias("order_id"),
            F.when(F.col("customer_id") % 3 == 0, "STORE").otherwise("DC").alias("node_type"),
            (F.col("customer_id") % 20).alias("node_id"), F.lit("SHIP").alias("fulfillment_mode"),
            F.col("event_ts").alias("status_time"),
        )

    return silver.project(silver.union_tagged({"PICKED": part("PENDING"), "SHIPPED": part("APPROVED")}, "status"), "order_status")


# --- alert rules: the trailing window ends at the newest event instead of the wall clock ---

AS_OF = "(SELECT max(ts) FROM events)"


@query("rule_stockout", f"""
SELECT store_id, dc_id, product_id, CAST(k % 4 AS INTEGER) AS last_known_quantity, ingest_timestamp AS detection_time, trace_id
FROM v_raw WHERE event_type = 'error' AND ingest_timestamp > {AS_OF} - INTERVAL 6 HOUR""")
def rule_stockout(t):
    facts = silver.project(stockout_raw(t.raw), "stockouts")
    return rules.stockout(facts, rules.newest(t.events, "ts"), minutes=360)


@query("rule_reorder_urgent", f"""
SELECT store_id, dc_id, product_id, CAST(k + 10 AS INTEGER) AS reorder_quantity, 20 AS reorder_point,
       CAST(k % 40 AS INTEGER) AS current_quantity, trace_id
FROM v_raw WHERE event_type = 'signup' AND k % 40 < 5 AND ingest_timestamp > {AS_OF} - INTERVAL 48 HOUR""")
def rule_reorder_urgent(t):
    facts = silver.project(reorder_raw(t.raw), "reorders")
    return rules.reorder_urgent(facts, rules.newest(t.events, "ts"), minutes=48 * 60)


@query("rule_truck_dwell_breach", """
SELECT truck_id, dc_id, store_id, shipment_id, arrived AS arrival_time, departed AS departure_time,
       epoch_us(departed) / 60000000.0 - epoch_us(arrived) / 60000000.0 AS dwell_minutes, 90.0::DOUBLE AS threshold_minutes
FROM v_shipments WHERE departed > arrived AND (epoch_us(departed) - epoch_us(arrived)) / 60000000.0 > 90
  AND arrived > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY""")
def rule_truck_dwell_breach(t):
    lifecycles = t.shipments.withColumnsRenamed({"arrived": "arrival_time", "departed": "departure_time"})
    return rules.truck_dwell_breach(lifecycles, rules.newest(t.orders, "o_orderdate"), minutes=30 * 24 * 60)


@query("rule_zone_overcrowded", f"""
SELECT store_id, event_type AS zone, CAST(sum(k % 7) AS BIGINT) AS customers,
       CAST(sum(CAST(trunc(value) AS BIGINT)) AS DOUBLE) / count(*) AS avg_dwell
FROM v_raw WHERE ingest_timestamp > {AS_OF} - INTERVAL 24 HOUR GROUP BY 1, 2
HAVING sum(k % 7) > 20 OR CAST(sum(CAST(trunc(value) AS BIGINT)) AS DOUBLE) / count(*) > 40""")
def rule_zone_overcrowded(t):
    facts = silver.project(foot_traffic_raw(t.raw), "foot_traffic")
    return rules.zone_overcrowded(facts, rules.newest(t.events, "ts"), minutes=24 * 60, max_customers=20, max_dwell=40)


@query("rule_high_value_receipt", """
SELECT customer_id % 50 AS store_id, receipt_id, total_cents FROM v_receipts
WHERE event_ts > (SELECT max(o_orderdate) FROM orders) - INTERVAL 5 DAY AND total_cents > 20000""")
def rule_high_value_receipt(t):
    receipts = t.receipts.withColumn("store_id", F.col("customer_id") % 50)
    return rules.high_value_receipt(receipts, rules.newest(t.orders, "o_orderdate"), minutes=5 * 24 * 60).select(
        "store_id", "receipt_id", "total_cents"
    )
