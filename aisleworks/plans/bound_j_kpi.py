"""KPI measures on the fixture tables."""

from pyspark.sql import functions as F

from aisleworks.operators import gold, kpi
from aisleworks.operators.ordered import dealt
from aisleworks.plans.bound_d_attribution import PERFORMANCE_TAIL, campaign_performance_daily, labelled
from aisleworks.plans.bound_f_windows import PLAN_SQL, plan
from aisleworks.plans.registry import query


def one(df, column):
    return df.agg(column).scalar()


RCPT_SQL = """rc AS (SELECT receipt_id, event_date, customer_id, payment_method, total_cents, total_cents * 8 // 108 AS tax_cents, total_cents - total_cents * 8 // 108 AS subtotal_cents,
  CASE WHEN receipt_id % 13 = 0 THEN 'RETURN' ELSE 'SALE' END AS receipt_type FROM v_receipts)"""


def receipts(t):
    return (
        t.receipts.withColumn("tax_cents", F.expr("total_cents * 8 div 108")).withColumn("subtotal_cents", F.col("total_cents") - F.col("tax_cents"))
        .withColumn("receipt_type", F.when(F.col("receipt_id") % 13 == 0, "RETURN").otherwise("SALE"))
    )


NET_SQL = "(SELECT CAST(sum(ext_cents) AS DOUBLE) / 100.0 FROM v_lines)"


def net_sales(t):
    return one(t.lines, gold.dollars(F.sum("ext_cents")))


@query("kpi_store_sales", f"""WITH {RCPT_SQL}, s AS (SELECT payment_method, CAST(sum(total_cents) AS DOUBLE) / 100.0 AS total_sales, CAST(sum(tax_cents) AS DOUBLE) / 100.0 AS total_tax, CAST(sum(subtotal_cents) AS DOUBLE) / 100.0 AS total_subtotal, count(*) AS receipt_count,
  CAST(coalesce(sum(total_cents) FILTER (WHERE receipt_type = 'RETURN'), 0) AS DOUBLE) / 100.0 AS total_returns FROM rc GROUP BY 1)
SELECT *, total_sales / receipt_count AS average_basket_size, {NET_SQL} AS net_sales, {NET_SQL} / (SELECT count(*) FROM supplier) AS sales_per_store, {NET_SQL} / (SELECT count(*) FROM customer) AS sales_per_customer,
  abs(total_returns) / total_sales AS return_rate FROM s""")
def kpi_store_sales(t):
    return kpi.store_sales(receipts(t), line_revenue=net_sales(t), stores=one(t.supplier, kpi.rows()), customers=one(t.customer, kpi.rows()), by=["payment_method"])


@query("kpi_store_minute_sales", """
WITH m AS (SELECT user_id % 10 AS store_id, date_trunc('minute', ts) AS minute, sum(CAST(round(value * 100) AS BIGINT)) AS c, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT store_id, CAST(sum(c) AS DOUBLE) / 100.0 AS total_store_sales, CAST(sum(n) AS BIGINT) AS total_store_receipts, CAST(sum(c) AS DOUBLE) / 100.0 / sum(n) AS avg_store_basket FROM m GROUP BY 1""")
def kpi_store_minute_sales(t):
    sold = t.raw.where("event_type = 'purchase'").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    minutes = gold.by_minute(sold, ["store_id"], "ingest_timestamp", [F.sum("cents").alias("cents"), kpi.rows().alias("n")])
    return kpi.measures(
        minutes, ["store_id"], {"total_store_sales": gold.dollars(kpi.total("cents")), "total_store_receipts": kpi.total("n")},
        {"avg_store_basket": kpi.divide(F.col("total_store_sales"), F.col("total_store_receipts"))},
    )


@query("kpi_line_margin", """
WITH m AS (SELECT line_type, CAST(sum(quantity) AS BIGINT) AS total_units_sold, CAST(sum(ext_cents) AS DOUBLE) / 100.0 AS line_revenue, count(*) AS total_lines, CAST(sum(quantity * coalesce(cost_cents, 0)) AS DOUBLE) / 100.0 AS line_cost
  FROM v_lines LEFT JOIN v_products USING (product_id) GROUP BY 1)
SELECT *, line_revenue / total_units_sold AS average_unit_price, line_revenue - line_cost AS gross_profit, (line_revenue - line_cost) / line_revenue AS gross_margin, CAST(total_units_sold AS DOUBLE) / (SELECT count(*) FROM orders) AS units_per_receipt FROM m""")
def kpi_line_margin(t):
    return kpi.line_margin(t.lines, t.products, receipts=one(t.receipts, kpi.rows()), by=["line_type"])


@query("kpi_top_products", """
SELECT product_id, CAST(sum(ext_cents) AS DOUBLE) / 100.0 AS top_product_revenue, CAST(sum(quantity) AS BIGINT) AS top_product_units FROM v_lines GROUP BY 1""")
def kpi_top_products(t):
    return kpi.measures(t.lines, ["product_id"], {"top_product_revenue": gold.dollars(kpi.total("ext_cents")), "top_product_units": kpi.total("quantity")}, {})


ONLINE_SQL = f"""{RCPT_SQL}, oh AS (SELECT * FROM rc WHERE payment_method IN ('1-URGENT', '2-HIGH')), ol AS (SELECT l.*, h.payment_method FROM v_lines l JOIN oh h USING (receipt_id))"""


def online_parts(t):
    heads = receipts(t).where(F.col("payment_method").isin("1-URGENT", "2-HIGH"))
    return heads, t.lines.join(heads.select("receipt_id", "payment_method"), "receipt_id")


@query("kpi_online", f"""WITH {ONLINE_SQL}, h AS (SELECT payment_method, CAST(sum(total_cents) AS DOUBLE) / 100.0 AS total_online_sales, CAST(sum(tax_cents) AS DOUBLE) / 100.0 AS total_online_tax, CAST(sum(subtotal_cents) AS DOUBLE) / 100.0 AS total_online_subtotal, count(*) AS online_order_count FROM oh GROUP BY 1),
b AS (SELECT payment_method, CAST(sum(quantity) AS BIGINT) AS total_online_units, CAST(sum(ext_cents) AS DOUBLE) / 100.0 AS online_line_revenue FROM ol GROUP BY 1)
SELECT h.*, total_online_sales / online_order_count AS average_online_order_value, total_online_units, online_line_revenue, online_line_revenue / total_online_units AS average_online_unit_price,
  CAST(total_online_units AS DOUBLE) / online_order_count AS online_units_per_order FROM h LEFT JOIN b USING (payment_method)""")
def kpi_online(t):
    return kpi.online(*online_parts(t), by=["payment_method"])


@query("kpi_online_daily", """
WITH d AS (SELECT event_date AS day, sum(total_cents) AS c, count(*) AS n FROM v_receipts GROUP BY 1)
SELECT CAST(sum(c) AS DOUBLE) / 100.0 AS online_revenue, CAST(sum(n) AS BIGINT) AS online_orders, CAST(sum(c) AS DOUBLE) / 100.0 / sum(n) AS online_average_order_value FROM d""")
def kpi_online_daily(t):
    daily = gold.by_day(t.receipts, [], "event_ts", [F.sum("total_cents").alias("c"), kpi.rows().alias("n")])
    return kpi.measures(
        daily, [], {"online_revenue": gold.dollars(kpi.total("c")), "online_orders": kpi.total("n")},
        {"online_average_order_value": kpi.divide(F.col("online_revenue"), F.col("online_orders"))},
    )


@query("kpi_omnichannel", """
WITH s AS (SELECT year(l.event_date) AS year, l.ext_cents, l.quantity, r.payment_method IN ('1-URGENT', '2-HIGH') AS web, l.receipt_id FROM v_lines l JOIN v_receipts r USING (receipt_id)),
g AS (SELECT year, CAST(coalesce(sum(ext_cents) FILTER (WHERE NOT web), 0) AS DOUBLE) / 100.0 AS store_revenue, CAST(coalesce(sum(quantity) FILTER (WHERE NOT web), 0) AS BIGINT) AS store_units, count(DISTINCT receipt_id) FILTER (WHERE NOT web) AS store_orders,
  CAST(coalesce(sum(ext_cents) FILTER (WHERE web), 0) AS DOUBLE) / 100.0 AS online_revenue, CAST(coalesce(sum(quantity) FILTER (WHERE web), 0) AS BIGINT) AS online_units, count(DISTINCT receipt_id) FILTER (WHERE web) AS online_orders FROM s GROUP BY 1)
SELECT *, store_revenue + online_revenue AS omnichannel_revenue, store_orders + online_orders AS omnichannel_orders, store_units + online_units AS omnichannel_units, (store_revenue + online_revenue) / (store_orders + online_orders) AS omnichannel_aov,
  store_revenue / (store_revenue + online_revenue) AS store_share, online_revenue / (store_revenue + online_revenue) AS online_share, CAST(online_units AS DOUBLE) / (store_units + online_units) AS online_units_share FROM g""")
def kpi_omnichannel(t):
    joined = t.lines.join(t.receipts.select("receipt_id", "payment_method"), "receipt_id").withColumn("year", F.year("event_date").cast("bigint"))
    web = F.col("payment_method").isin("1-URGENT", "2-HIGH")
    side = lambda where, name: kpi.measures(
        joined.where(where), ["year"],
        {f"{name}_revenue": gold.dollars(kpi.total("ext_cents")), f"{name}_units": kpi.total("quantity"), f"{name}_orders": F.countDistinct("receipt_id")}, {},
    )
    return kpi.omnichannel(side(~web, "store"), side(web, "online"), ["year"])


@query("kpi_payments", """
WITH p AS (SELECT payment_method, CAST(sum(total_cents) AS DOUBLE) / 100.0 AS total_amounts, count(*) AS payment_count, count(*) FILTER (WHERE payment_status = 'APPROVED') AS approved_payment_count, count(*) FILTER (WHERE payment_status = 'DECLINED') AS declined_payment_count,
  CAST(sum(customer_id % 3000) AS DOUBLE) / count(*) AS avg_processing_ms FROM v_receipts GROUP BY 1)
SELECT *, CAST(declined_payment_count AS DOUBLE) / payment_count AS payment_decline_rate FROM p""")
def kpi_payments(t):
    paid = t.receipts.select("payment_method", F.col("total_cents").alias("amount_cents"), F.col("payment_status").alias("status"), (F.col("customer_id") % 3000).alias("processing_time_ms"))
    return kpi.payments(paid, by=["payment_method"])


@query("kpi_tender_mix", "SELECT CAST(sum(total_cents) AS DOUBLE) / 100.0 AS tender_amount, count(*) AS tender_transactions FROM v_receipts")
def kpi_tender_mix(t):
    daily = gold.by_day(t.receipts, ["payment_method"], "event_ts", [F.sum("total_cents").alias("c"), kpi.rows().alias("n")])
    return kpi.measures(daily, [], {"tender_amount": gold.dollars(kpi.total("c")), "tender_transactions": kpi.total("n")}, {})


@query("kpi_inventory", f"""
WITH q AS (SELECT store_id, product_id, CASE WHEN line_type = 'SALE' THEN -quantity ELSE quantity END AS d FROM v_lines),
pos AS (SELECT store_id, product_id, CAST(sum(d) + 60 AS BIGINT) AS on_hand FROM q GROUP BY 1, 2), dc AS (SELECT store_id % 5 AS dc_id, product_id, CAST(sum(d) + 500 AS BIGINT) AS on_hand FROM q GROUP BY 1, 2),
s AS (SELECT CAST(sum(on_hand) AS BIGINT) AS total_units_on_hand, CAST(sum(on_hand * cost_cents) AS DOUBLE) / 100.0 AS total_inventory_value, CAST(sum(on_hand * sale_cents) AS DOUBLE) / 100.0 AS total_inventory_retail_value, count(DISTINCT product_id) AS store_sku_count
  FROM pos JOIN v_products USING (product_id)),
d AS (SELECT CAST(sum(on_hand) AS BIGINT) AS dc_units_on_hand, count(DISTINCT product_id) AS dc_sku_count FROM dc)
SELECT s.*, CAST(total_units_on_hand AS DOUBLE) / store_sku_count AS avg_store_units_per_sku, total_inventory_retail_value - total_inventory_value AS inventory_margin_value,
  (total_inventory_retail_value - total_inventory_value) / total_inventory_retail_value AS inventory_margin, d.*, CAST(dc_units_on_hand AS DOUBLE) / dc_sku_count AS avg_dc_units_per_sku, total_units_on_hand + dc_units_on_hand AS network_units_on_hand,
  total_inventory_retail_value / {NET_SQL} AS inventory_to_sales_ratio, (SELECT count(*) FROM q) AS total_inventory_transactions, (SELECT CAST(sum(d) AS BIGINT) FROM q) AS total_quantity_delta FROM s, d""")
def kpi_inventory(t):
    moves = t.lines.select("store_id", "product_id", F.when(F.col("line_type") == "SALE", -F.col("quantity")).otherwise(F.col("quantity")).alias("d"))
    position = moves.groupBy("store_id", "product_id").agg((F.sum("d") + 60).alias("on_hand"))
    depots = moves.groupBy((F.col("store_id") % 5).alias("dc_id"), "product_id").agg((F.sum("d") + 500).alias("on_hand"))
    return kpi.inventory(
        position, t.products, dc_units=one(depots, F.sum("on_hand")), dc_skus=one(depots, F.countDistinct("product_id")), net_sales=net_sales(t),
        transactions=one(moves, kpi.rows()), quantity_delta=one(moves, F.sum("d")),
    )


@query("kpi_attribution", """
WITH a AS (SELECT purchase_type, CAST(sum(attributed_revenue_cents) AS DOUBLE) / 100.0 AS attributed_revenue, count(*) FILTER (WHERE attribution_status = 'ATTRIBUTED') AS attributed_purchases, count(*) FILTER (WHERE attribution_status <> 'ATTRIBUTED') AS unattributed_purchases,
  CAST(sum(discount_cents) AS DOUBLE) / 100.0 AS discount_amount, CAST(coalesce(sum(tax_cents) FILTER (WHERE attribution_status = 'ATTRIBUTED'), 0) AS DOUBLE) / 100.0 AS attributed_tax,
  CAST(coalesce(sum(payment_cents) FILTER (WHERE attribution_status = 'ATTRIBUTED'), 0) AS DOUBLE) / 100.0 AS attributed_payments, CAST(sum(payment_cents) - sum(total_cents) AS DOUBLE) / 100.0 AS payment_variance,
  CAST(sum(lag_seconds) AS DOUBLE) / count(lag_seconds) / 3600.0 AS average_lag_hours FROM v_labelled GROUP BY 1)
SELECT *, CAST(attributed_purchases AS DOUBLE) / (attributed_purchases + unattributed_purchases) AS attribution_rate FROM a""")
def kpi_attribution(t):
    return kpi.attribution(labelled(t), by=["purchase_type"])


CAMPAIGN_SQL = """
spend AS (SELECT campaign_id, channel, CAST(touch_ts AS DATE) AS day, count(DISTINCT impression_id) AS impressions, CAST(sum(cost_cents) AS BIGINT) AS spend_cents FROM v_touches GROUP BY 1, 2, 3),
won AS (SELECT campaign_id, channel, CAST(touch_ts AS DATE) AS day, count(DISTINCT purchase_id) AS conversions, CAST(sum(total_cents) AS BIGINT) AS attributed_revenue_cents FROM v_last_touch GROUP BY 1, 2, 3)"""


@query("kpi_campaign", f"""WITH {CAMPAIGN_SQL}, perf AS ({PERFORMANCE_TAIL}), s AS (SELECT channel, CAST(sum(spend_cents) AS DOUBLE) / 100.0 AS spend, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(conversions) AS BIGINT) AS conversions,
  CAST(sum(attributed_revenue_cents) AS DOUBLE) / 100.0 AS attributed_revenue FROM perf GROUP BY 1)
SELECT *, CAST(conversions AS DOUBLE) / impressions AS conversion_rate, attributed_revenue / spend AS roas FROM s""")
def kpi_campaign(t):
    return kpi.campaign(campaign_performance_daily(t), by=["channel"])


@query("kpi_marketing", f"""
WITH d AS (SELECT campaign_id, CAST(touch_ts AS DATE) AS day, count(*) AS impressions, sum(cost_cents) AS cost_cents FROM v_touches GROUP BY 1, 2),
s AS (SELECT CAST(sum(cost_cents) AS DOUBLE) / 100.0 AS total_marketing_cost, CAST(sum(impressions) AS BIGINT) AS total_marketing_impressions FROM d)
SELECT *, total_marketing_cost * 1000 / total_marketing_impressions AS marketing_cpm, total_marketing_cost / {NET_SQL} AS marketing_spend_of_revenue,
  (SELECT CAST(coalesce(sum(cost_cents), 0) AS DOUBLE) / 100.0 FROM d WHERE campaign_id IN (SELECT campaign_id FROM v_touches WHERE channel = 'click' AND impression_id % 50 = 7)) AS marketing_spend_channel FROM s""")
def kpi_marketing(t):
    daily = gold.by_day(t.touches, ["campaign_id"], "touch_ts", [kpi.rows().alias("impressions"), F.sum("cost_cents").alias("cost_cents")])
    return kpi.marketing(daily, t.touches.where("channel = 'click' AND impression_id % 50 = 7"), omnichannel_revenue=net_sales(t))


@query("kpi_logistics", """
WITH life AS (SELECT *, epoch(departed) - epoch(arrived) AS secs, CASE WHEN store_id IS NOT NULL THEN 'STORE_' || CAST(store_id AS VARCHAR) ELSE 'DC_' || CAST(dc_id AS VARCHAR) END AS site FROM v_shipments WHERE departed > arrived),
d AS (SELECT site, CAST(arrived AS DATE) AS day, CAST(sum(secs) AS BIGINT) AS dwell_seconds, count(*) AS trucks FROM life GROUP BY 1, 2),
s AS (SELECT CAST(sum(trucks) AS BIGINT) AS total_trucks, count(*) FILTER (WHERE CAST(dwell_seconds AS DOUBLE) / trucks / 60.0 > 45) AS breach_days, sum(dwell_seconds) AS sec, count(DISTINCT site) AS sites FROM d)
SELECT total_trucks, breach_days, CAST(sec AS DOUBLE) / total_trucks / 60.0 AS avg_truck_dwell_minutes, CAST(total_trucks AS DOUBLE) / sites AS trucks_per_site, (SELECT count(*) FROM v_shipments) AS truck_move_count,
  (SELECT CAST(sum(CAST(epoch(departed) - epoch(arrived) AS BIGINT)) AS DOUBLE) / count(*) FROM v_shipments) AS avg_unload_duration FROM s""")
def kpi_logistics(t):
    seconds = F.unix_seconds("departed") - F.unix_seconds("arrived")
    daily = t.shipments.where("departed > arrived").groupBy(gold.site_label().alias("site"), F.to_date("arrived").alias("day")).agg(
        F.sum(seconds).alias("dwell_seconds"), kpi.rows().alias("trucks")
    )
    return kpi.logistics(daily, moves=one(t.shipments, kpi.rows()), avg_unload=one(t.shipments, F.avg(seconds)))


@query("kpi_zone", """
WITH m AS (SELECT event_type AS zone, user_id % 10 AS store_id, date_trunc('minute', ts) AS ts, sum(k) AS dwell, count(*) AS n, sum(k % 7) AS customers FROM v_events GROUP BY 1, 2, 3)
SELECT zone, CAST(sum(customers) AS BIGINT) AS zone_customers, round(sum(CAST(dwell AS DOUBLE) / n * customers), 6) / sum(customers) AS avg_zone_dwell FROM m GROUP BY 1""")
def kpi_zone(t):
    minutes = gold.by_minute(
        t.raw.withColumn("zone", F.col("event_type")), ["zone", "store_id"], "ingest_timestamp",
        [F.sum("k").alias("dwell"), kpi.rows().alias("n"), F.sum(F.col("k") % 7).alias("customers")],
    )
    return kpi.weighted_zone(minutes, by=["zone"])


@query("kpi_promotions", """
WITH p AS (SELECT receipt_id, promo_code, quantity, unit_cents * quantity - ext_cents AS d FROM v_lines WHERE line_type = 'SALE' AND promo_code IS NOT NULL AND unit_cents * quantity - ext_cents > 0),
r AS (SELECT receipt_id, promo_code, sum(d) AS d FROM p GROUP BY 1, 2)
SELECT promo_code, promo_line_quantity, promo_line_discount, promotion_count, promotion_discount FROM (SELECT promo_code, CAST(sum(quantity) AS BIGINT) AS promo_line_quantity, CAST(sum(d) AS DOUBLE) / 100.0 AS promo_line_discount FROM p GROUP BY 1)
FULL JOIN (SELECT promo_code, count(*) AS promotion_count, CAST(sum(d) AS DOUBLE) / 100.0 AS promotion_discount FROM r GROUP BY 1) USING (promo_code)""")
def kpi_promotions(t):
    lines = gold.promo_lines(t.lines)
    promos = lines.groupBy("receipt_id", "promo_code").agg(F.sum("discount_cents").alias("discount_cents"))
    return kpi.promotions(lines, promos, by=["promo_code"])


@query("kpi_reorders", f"""WITH {PLAN_SQL}, s AS (SELECT store_id, CAST(sum(reorder_quantity) AS BIGINT) AS total_reorder_quantity, count(*) AS reorder_events, CAST(coalesce(sum(reorder_quantity) FILTER (WHERE priority IN ('HIGH', 'URGENT')), 0) AS BIGINT) AS high_priority_quantity,
  CAST(sum(reorder_point - current_quantity) AS BIGINT) AS reorder_fill_gap FROM plan GROUP BY 1) SELECT *, CAST(total_reorder_quantity AS DOUBLE) / reorder_events AS avg_reorder_quantity FROM s""")
def kpi_reorders(t):
    return kpi.reorders(plan(t), by=["store_id"])


@query("kpi_stockouts", "SELECT store_id, count(*) AS stockout_events, CAST(sum(k % 4) AS DOUBLE) / count(*) AS avg_last_known_quantity FROM v_raw WHERE event_type = 'error' GROUP BY 1")
def kpi_stockouts(t):
    facts = t.raw.where("event_type = 'error'").withColumn("last_known_quantity", F.col("k") % 4)
    return kpi.stockouts(facts, by=["store_id"])


@query("kpi_store_ops", "SELECT event_type AS operation_type, count(*) AS operation_events, CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT store_id) FROM v_raw) AS operation_events_per_store FROM v_raw WHERE event_type IN ('view', 'click') GROUP BY 1")
def kpi_store_ops(t):
    ops = t.raw.where(F.col("event_type").isin("view", "click")).withColumn("operation_type", F.col("event_type"))
    return kpi.store_ops(ops, stores=one(t.raw, F.countDistinct("store_id")), by=["operation_type"])


@query("kpi_foot_traffic", """
SELECT store_id, CAST(sum(k % 7) AS BIGINT) AS foot_traffic_count, CAST(sum(k) AS DOUBLE) / (sum(k % 7) * 60) AS avg_dwell_minutes,
  CAST((SELECT count(*) FROM v_raw WHERE event_type = 'purchase') AS DOUBLE) / sum(k % 7) AS conversion_proxy FROM v_raw GROUP BY 1""")
def kpi_foot_traffic(t):
    facts = t.raw.select("store_id", (F.col("k") % 7).alias("count"), F.col("k").alias("dwell_seconds"))
    return kpi.foot_traffic(facts, receipts=one(t.raw.where("event_type = 'purchase'"), kpi.rows()), by=["store_id"])


@query("kpi_dimensions", """
SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(DISTINCT store_id % 5) FROM v_stores) AS distribution_centers, (SELECT count(*) FROM nation) AS locations, (SELECT count(*) FROM part) AS products,
  (SELECT count(*) FROM supplier) AS stores, (SELECT count(DISTINCT truck_id) FROM v_shipments) AS trucks, (SELECT CAST(sum(cost_cents) AS DOUBLE) / count(*) / 100.0 FROM v_products) AS average_product_cost,
  (SELECT CAST(sum(sale_cents) AS DOUBLE) / count(*) / 100.0 FROM v_products) AS average_product_price""")
def kpi_dimensions(t):
    return t.products.agg(
        (F.avg("cost_cents") / 100.0).alias("average_product_cost"), (F.avg("sale_cents") / 100.0).alias("average_product_price"), kpi.rows().alias("products")
    ).withColumns({
        "customers": one(t.customer, kpi.rows()), "distribution_centers": one(t.stores, F.countDistinct(F.col("store_id") % 5)),
        "locations": one(t.nation, kpi.rows()), "stores": one(t.supplier, kpi.rows()), "trucks": one(t.shipments, F.countDistinct("truck_id")),
    })


# --- prediction tables are stood in for by deterministic scores over the fixtures ---


def last_order(t):
    return one(t.orders, F.max("o_orderdate"))


@query("kpi_ml", """
WITH s AS (SELECT customer_id, (customer_id % 100) / 100.0::DOUBLE AS p, max(event_ts) AS d FROM v_receipts GROUP BY 1),
a AS (SELECT count(DISTINCT customer_id) FILTER (WHERE p >= 0.5) AS customers_at_risk, round(avg(p), 6) AS avg_churn_probability, count(DISTINCT customer_id) FILTER (WHERE p >= 0.7) AS high_risk_customers, max(d) AS data_as_of, count(*) AS n FROM s)
SELECT customers_at_risk, avg_churn_probability, high_risk_customers, data_as_of, CAST(customers_at_risk AS DOUBLE) / n AS predicted_churn_rate,
  CAST(floor(epoch((SELECT max(ts) FROM events)) / 3600) - floor(epoch(data_as_of) / 3600) AS BIGINT) AS freshness_hours FROM a""")
def kpi_ml(t):
    p = (F.col("customer_id") % 100) / F.lit(100.0)
    scores = t.receipts.groupBy("customer_id").agg(F.max("event_ts").alias("prediction_date")).select(
        "customer_id", "prediction_date", p.alias("churn_probability"), (p >= 0.5).cast("int").alias("churn_prediction"),
        F.when(p >= 0.85, "Very High").when(p >= 0.7, "High").otherwise("Low").alias("risk_category"),
    )
    return kpi.churn(scores, one(t.events, F.max("ts")))


@query("kpi_segments", """
WITH r AS (SELECT customer_id, date_diff('day', CAST(max(event_ts) AS DATE), (SELECT CAST(max(event_ts) AS DATE) FROM v_receipts)) AS recency_days, count(DISTINCT receipt_id) AS frequency, sum(total_cents) AS monetary_cents, max(event_ts) AS segmented_at FROM v_receipts GROUP BY 1)
SELECT count(*) AS segmented_customers, CAST(sum(recency_days) AS DOUBLE) / count(*) AS avg_recency_days, CAST(sum(frequency) AS DOUBLE) / count(*) AS avg_frequency, CAST(sum(monetary_cents) AS DOUBLE) / 100.0 AS monetary_value,
  round(avg(CAST(monetary_cents AS DOUBLE) / frequency / 100.0), 6) AS avg_order_value, max(segmented_at) AS data_as_of, CAST(floor(epoch((SELECT max(ts) FROM events)) / 3600) - floor(epoch(max(segmented_at)) / 3600) AS BIGINT) AS freshness_hours FROM r""")
def kpi_segments(t):
    rfm = gold.rfm(t.receipts, customer="customer_id", receipt="receipt_id", at="event_ts", cents="total_cents").withColumn("segmented_at", F.col("last_purchase"))
    return kpi.segments(rfm, one(t.events, F.max("ts")))


@query("kpi_forecast", """
WITH d AS (SELECT store_id, product_id, CAST(sum(quantity) AS DOUBLE) AS u, max(event_ts) AS g, count(*) AS n FROM v_lines GROUP BY 1, 2)
SELECT round(sum(u), 4) AS forecasted_units, round(sum(u * 0.8::DOUBLE), 4) AS lower_bound, round(sum(u * 1.2::DOUBLE), 4) AS upper_bound, round(avg(1.0::DOUBLE / (n + 1)), 6) AS forecast_mape, max(g) AS data_as_of,
  CAST(floor(epoch((SELECT max(ts) FROM events)) / 3600) - floor(epoch(max(g)) / 3600) AS BIGINT) AS freshness_hours FROM d""")
def kpi_forecast(t):
    keys = ["store_id", "product_id"]
    units = dealt(t.lines.select(*keys, "quantity", "event_ts"), keys).groupBy(*keys).agg(
        F.sum("quantity").cast("double").alias("predicted_units"), F.max("event_ts").alias("generated_at"), (1.0 / (kpi.rows() + 1)).alias("mape")
    )
    return kpi.forecast(
        units.withColumns({"lower_bound": F.col("predicted_units") * 0.8, "upper_bound": F.col("predicted_units") * 1.2}), one(t.events, F.max("ts"))
    )


@query("kpi_stockout_risk", """
WITH d AS (SELECT store_id, product_id, CAST(sum(quantity) AS DOUBLE) / 30 AS v, max(event_ts) AS g, (product_id % 100) / 100.0::DOUBLE AS p FROM v_lines GROUP BY 1, 2)
SELECT count(*) AS risk_sku_count, count(*) FILTER (WHERE p >= 0.7) AS high_risk_skus, round(avg(p), 6) AS avg_stockout_probability, round(avg(100.0::DOUBLE / (v + 1)), 6) AS avg_days_of_inventory, round(avg(v), 6) AS avg_demand_velocity, max(g) AS data_as_of,
  CAST(floor(epoch((SELECT max(ts) FROM events)) / 3600) - floor(epoch(max(g)) / 3600) AS BIGINT) AS freshness_hours FROM d""")
def kpi_stockout_risk(t):
    p = (F.col("product_id") % 100) / F.lit(100.0)
    keys = ["store_id", "product_id"]
    risk = dealt(t.lines.select(*keys, "quantity", "event_ts"), keys).groupBy(*keys).agg(
        (F.sum("quantity") / F.lit(30)).alias("demand_velocity_daily"), F.max("event_ts").alias("inventory_as_of")
    ).withColumns({
        "stockout_probability": p, "risk_level": F.when(p >= 0.7, "HIGH").otherwise("LOW"), "forecast_horizon_days": F.lit(3),
        "days_of_inventory": F.lit(100.0) / (F.col("demand_velocity_daily") + 1),
    })
    return kpi.stockout_risk(risk, one(t.events, F.max("ts")))


DAILY_SQL = """
d AS (SELECT event_date, CAST(sum(ext_cents) AS BIGINT) AS net_cents FROM v_lines GROUP BY 1),
spine AS (SELECT CAST(s AS DATE) AS event_date, coalesce(net_cents, 0) AS net_cents FROM (SELECT unnest(generate_series(CAST((SELECT min(event_date) FROM d) AS TIMESTAMP), CAST((SELECT max(event_date) FROM d) AS TIMESTAMP), INTERVAL 1 DAY)) AS s) LEFT JOIN d ON d.event_date = CAST(s AS DATE))"""


def intelligence_sql(value, daily):
    return f"""WITH {daily}, w AS (SELECT event_date, {value}, CAST(sum({value}) OVER (PARTITION BY date_trunc('month', event_date) ORDER BY event_date) AS BIGINT) AS mtd, CAST(sum({value}) OVER (PARTITION BY date_trunc('quarter', event_date) ORDER BY event_date) AS BIGINT) AS qtd,
  CAST(sum({value}) OVER (PARTITION BY date_trunc('year', event_date) ORDER BY event_date) AS BIGINT) AS ytd, CAST(sum({value}) OVER (ORDER BY event_date ROWS 6 PRECEDING) AS BIGINT) AS last_7d FROM spine)
SELECT w.*, y.{value} AS py, m.{value} AS pm, q.{value} AS pq, p.{value} AS pd, k.last_7d AS prior_7d, CAST(w.{value} - y.{value} AS DOUBLE) / nullif(y.{value}, 0) AS yoy, CAST(w.{value} - m.{value} AS DOUBLE) / nullif(m.{value}, 0) AS mom,
  CAST(w.{value} - q.{value} AS DOUBLE) / nullif(q.{value}, 0) AS qoq, CAST(w.{value} - p.{value} AS DOUBLE) / nullif(p.{value}, 0) AS dod, CAST(w.last_7d - k.last_7d AS DOUBLE) / nullif(k.last_7d, 0) AS wow
FROM w LEFT JOIN w y ON y.event_date = CAST(w.event_date - INTERVAL 12 MONTH AS DATE) LEFT JOIN w m ON m.event_date = CAST(w.event_date - INTERVAL 1 MONTH AS DATE) LEFT JOIN w q ON q.event_date = CAST(w.event_date - INTERVAL 3 MONTH AS DATE)
LEFT JOIN w p ON p.event_date = w.event_date - 1 LEFT JOIN w k ON k.event_date = w.event_date - 7"""


@query("kpi_time_intelligence", intelligence_sql("net_cents", DAILY_SQL))
def kpi_time_intelligence(t):
    daily = t.lines.groupBy("event_date").agg(F.sum("ext_cents").alias("net_cents"))
    return kpi.time_intelligence(kpi.date_spine(daily, "event_date", ["net_cents"]), "event_date", "net_cents")


ONLINE_DAILY_SQL = DAILY_SQL.replace("CAST(sum(ext_cents) AS BIGINT) AS net_cents FROM v_lines", "CAST(sum(total_cents) AS BIGINT) AS online_cents FROM v_receipts WHERE payment_method IN ('1-URGENT', '2-HIGH')").replace("net_cents", "online_cents")


@query("kpi_online_time_intelligence", intelligence_sql("online_cents", ONLINE_DAILY_SQL))
def kpi_online_time_intelligence(t):
    daily = t.receipts.where(F.col("payment_method").isin("1-URGENT", "2-HIGH")).groupBy("event_date").agg(F.sum("total_cents").alias("online_cents"))
    return kpi.time_intelligence(kpi.date_spine(daily, "event_date", ["online_cents"]), "event_date", "online_cents")


COUNT_DAILY_SQL = DAILY_SQL.replace("CAST(sum(ext_cents) AS BIGINT) AS net_cents FROM v_lines", "count(*) AS receipt_count FROM v_receipts").replace("net_cents", "receipt_count")


@query("kpi_receipt_count_time_intelligence", intelligence_sql("receipt_count", COUNT_DAILY_SQL))
def kpi_receipt_count_time_intelligence(t):
    daily = t.receipts.groupBy("event_date").agg(kpi.rows().alias("receipt_count"))
    return kpi.time_intelligence(kpi.date_spine(daily, "event_date", ["receipt_count"]), "event_date", "receipt_count")


OMNI_DAILY_SQL = DAILY_SQL.replace(
    "SELECT event_date, CAST(sum(ext_cents) AS BIGINT) AS net_cents FROM v_lines GROUP BY 1",
    "SELECT event_date, CAST(sum(c) AS BIGINT) AS omni_cents FROM (SELECT event_date, ext_cents AS c FROM v_lines UNION ALL SELECT event_date, total_cents FROM v_receipts WHERE payment_method IN ('1-URGENT', '2-HIGH')) GROUP BY 1",
).replace("net_cents", "omni_cents")


def omni_daily(t):
    web = t.receipts.where(F.col("payment_method").isin("1-URGENT", "2-HIGH")).select("event_date", F.col("total_cents").alias("c"))
    return t.lines.select("event_date", F.col("ext_cents").alias("c")).unionByName(web).groupBy("event_date").agg(F.sum("c").alias("omni_cents"))


@query("kpi_omnichannel_time_intelligence", intelligence_sql("omni_cents", OMNI_DAILY_SQL))
def kpi_omnichannel_time_intelligence(t):
    return kpi.time_intelligence(kpi.date_spine(omni_daily(t), "event_date", ["omni_cents"]), "event_date", "omni_cents")


@query("kpi_latest_year", f"""WITH {DAILY_SQL}, y AS (SELECT max(year(event_date)) AS m FROM d)
SELECT (SELECT m FROM y) AS latest_year, CAST(sum(net_cents) FILTER (WHERE year(event_date) = (SELECT m FROM y)) AS BIGINT) AS net_cents_latest_year, CAST(sum(net_cents) FILTER (WHERE year(event_date) = (SELECT m FROM y) - 1) AS BIGINT) AS net_cents_prior_year FROM d""")
def kpi_latest_year(t):
    daily = t.lines.groupBy("event_date").agg(F.sum("ext_cents").alias("net_cents"))
    return kpi.latest_and_prior_year(daily, "event_date", ["net_cents"])


@query("kpi_omnichannel_latest_year", f"""WITH {OMNI_DAILY_SQL}, y AS (SELECT max(year(event_date)) AS m FROM d)
SELECT (SELECT m FROM y) AS latest_year, CAST(sum(omni_cents) FILTER (WHERE year(event_date) = (SELECT m FROM y)) AS BIGINT) AS omni_cents_latest_year, CAST(sum(omni_cents) FILTER (WHERE year(event_date) = (SELECT m FROM y) - 1) AS BIGINT) AS omni_cents_prior_year FROM d""")
def kpi_omnichannel_latest_year(t):
    return kpi.latest_and_prior_year(omni_daily(t), "event_date", ["omni_cents"])
