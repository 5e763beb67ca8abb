"""Gold aggregates, look-back reports and top-k on the fixture tables."""

from pyspark.sql import functions as F

from aisleworks.operators import approvals, gold, ranges
from aisleworks.plans.registry import query

SALES = "FROM v_raw WHERE event_type = 'purchase'"
CENTS = "CAST(round(value * 100) AS BIGINT)"
LAST = "(SELECT max(ts) FROM events)"


def receipts(t):
    """Purchase events as receipts with cents."""
    return t.raw.where("event_type = 'purchase'").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


def newest(t):
    return t.events.agg(F.max("ts")).scalar()


def recent(t, df, hours, at="ingest_timestamp"):
    return gold.trailing_filter(df, at, newest(t), hours)


@query("sales_minute_store", f"""
SELECT store_id, date_trunc('minute', ingest_timestamp) AS ts, CAST(sum({CENTS}) AS DOUBLE) / 100.0 AS total_sales, count(*) AS receipts,
       CAST(sum({CENTS}) AS DOUBLE) / 100.0 / count(*) AS avg_basket {SALES} GROUP BY 1, 2""")
def sales_minute_store(t):
    return gold.by_minute(receipts(t), ["store_id"], "ingest_timestamp", gold.sales_metrics("cents"))


@query("top_products_15m", f"""
SELECT product_id, time_bucket(INTERVAL '15 minutes', ingest_timestamp) + INTERVAL '15 minutes' AS computed_at,
       CAST(sum({CENTS}) AS DOUBLE) / 100.0 AS revenue, CAST(sum(k % 5 + 1) AS BIGINT) AS units {SALES} GROUP BY 1, 2""")
def top_products_15m(t):
    return gold.by_window_end(
        receipts(t), ["product_id"], "ingest_timestamp", "15 minutes",
        {"revenue": gold.dollars(F.sum("cents")), "units": F.sum(F.col("k") % 5 + 1)},
    )


@query("sales_product_minute", f"""
SELECT product_id, date_trunc('minute', ingest_timestamp) AS ts, CAST(sum({CENTS}) AS DOUBLE) / 100.0 AS revenue, CAST(sum(k % 5 + 1) AS BIGINT) AS units
{SALES} GROUP BY 1, 2""")
def sales_product_minute(t):
    return gold.by_minute(
        receipts(t), ["product_id"], "ingest_timestamp",
        [gold.dollars(F.sum("cents")).alias("revenue"), F.sum(F.col("k") % 5 + 1).alias("units")],
    )


@query("tender_mix_15m", f"""
SELECT k % 4 AS payment_method, time_bucket(INTERVAL '15 minutes', ingest_timestamp) + INTERVAL '15 minutes' AS computed_at,
       CAST(sum({CENTS}) AS DOUBLE) / 100.0 AS amount, count(*) AS transactions {SALES} GROUP BY 1, 2""")
def tender_mix_15m(t):
    paid = receipts(t).withColumn("payment_method", F.col("k") % 4)
    return gold.by_window_end(
        paid, ["payment_method"], "ingest_timestamp", "15 minutes",
        {"amount": gold.dollars(F.sum("cents")), "transactions": F.count(F.lit(1))},
    )


@query("tender_mix_daily", """
SELECT payment_method, event_date AS day, count(*) AS transactions, CAST(sum(total_cents) AS DOUBLE) / 100.0 AS total_amount FROM v_receipts GROUP BY 1, 2""")
def tender_mix_daily(t):
    return gold.by_day(
        t.receipts, ["payment_method"], "event_ts",
        [F.count(F.lit(1)).alias("transactions"), gold.dollars(F.sum("total_cents")).alias("total_amount")],
    )


@query("zone_dwell_minute", """
SELECT store_id, event_type AS zone, date_trunc('minute', ingest_timestamp) AS ts, CAST(sum(k) AS DOUBLE) / count(*) AS avg_dwell,
       CAST(sum(k % 7) AS BIGINT) AS customers FROM v_raw GROUP BY 1, 2, 3""")
def zone_dwell_minute(t):
    return zone_minutes(t)


def zone_minutes(t):
    traffic = t.raw.select("store_id", F.col("event_type").alias("zone"), "ingest_timestamp", "k")
    return gold.by_minute(
        traffic, ["store_id", "zone"], "ingest_timestamp",
        [F.avg("k").alias("avg_dwell"), F.sum(F.col("k") % 7).alias("customers")],
    )


@query("online_sales_daily", """
SELECT event_date AS day, count(*) AS orders, CAST(sum(total_cents - total_cents * 8 // 108) AS DOUBLE) / 100.0 AS subtotal,
       CAST(sum(total_cents * 8 // 108) AS DOUBLE) / 100.0 AS tax, CAST(sum(total_cents) AS DOUBLE) / 100.0 AS total,
       CAST(sum(total_cents) AS DOUBLE) / 100.0 / count(*) AS avg_order_value FROM v_receipts GROUP BY 1""")
def online_sales_daily(t):
    orders = t.receipts.withColumn("tax_cents", F.expr("total_cents * 8 div 108"))
    total = gold.dollars(F.sum("total_cents"))
    return gold.by_day(
        orders, [], "event_ts",
        [F.count(F.lit(1)).alias("orders"), gold.dollars(F.sum(F.col("total_cents") - F.col("tax_cents"))).alias("subtotal"),
         gold.dollars(F.sum("tax_cents")).alias("tax"), total.alias("total"), (total / F.count(F.lit(1))).alias("avg_order_value")],
    )


@query("marketing_cost_daily", """
SELECT campaign_id, CAST(touch_ts AS DATE) AS day, count(*) AS impressions, CAST(sum(cost_cents) AS DOUBLE) / 100.0 AS cost FROM v_touches GROUP BY 1, 2""")
def marketing_cost_daily(t):
    return gold.by_day(
        t.touches, ["campaign_id"], "touch_ts",
        [F.count(F.lit(1)).alias("impressions"), gold.dollars(F.sum("cost_cents")).alias("cost")],
    )


LIFE = """
life AS (SELECT *, epoch(departed) - epoch(arrived) AS secs, CASE WHEN store_id IS NOT NULL THEN 'STORE_' || CAST(store_id AS VARCHAR)
  ELSE 'DC_' || CAST(dc_id AS VARCHAR) END AS site FROM v_shipments WHERE departed > arrived)"""


@query("truck_dwell_daily", f"WITH {LIFE} SELECT site, CAST(arrived AS DATE) AS day, CAST(sum(secs) AS DOUBLE) / count(*) / 60.0 AS avg_dwell_min, count(*) AS trucks FROM life GROUP BY 1, 2")
def truck_dwell_daily(t):
    return gold.truck_dwell_daily(t.shipments, arrived="arrived", departed="departed")


@query("truck_dwell_by_site", f"""WITH {LIFE}
SELECT site, CAST(sum(secs) AS DOUBLE) / count(*) / 60.0 AS avg_dwell_min, count(*) AS trucks FROM life
WHERE arrived > (SELECT max(o_orderdate) FROM orders) - INTERVAL 720 HOUR GROUP BY 1""")
def truck_dwell_by_site(t):
    last = t.orders.agg(F.max("o_orderdate")).scalar()
    life = gold.trailing_filter(t.shipments.where("departed > arrived"), "arrived", last, 720)
    return life.groupBy(gold.site_label().alias("site")).agg(
        (F.sum(F.unix_seconds("departed") - F.unix_seconds("arrived")) / F.count(F.lit(1)) / F.lit(60.0)).alias("avg_dwell_min"),
        F.count(F.lit(1)).alias("trucks"),
    )


@query("truck_sla_summary", f"WITH {LIFE} SELECT count(*) AS lifecycles, max(departed) AS latest_departure, count(*) FILTER (WHERE secs > 5400) AS breaches FROM life")
def truck_sla_summary(t):
    return t.shipments.where("departed > arrived").agg(
        F.count(F.lit(1)).alias("lifecycles"), F.max("departed").alias("latest_departure"),
        F.count_if(F.unix_seconds("departed") - F.unix_seconds("arrived") > 90 * 60).alias("breaches"),
    )


@query("rfm_features", """
WITH s AS (SELECT * FROM v_receipts WHERE payment_status <> 'DECLINED')
SELECT customer_id, date_diff('day', CAST(max(event_ts) AS DATE), (SELECT CAST(max(event_ts) AS DATE) FROM s)) AS recency_days,
       count(DISTINCT receipt_id) AS frequency, CAST(sum(total_cents) AS BIGINT) AS monetary_cents, min(event_ts) AS first_purchase,
       max(event_ts) AS last_purchase, CAST(sum(total_cents) AS DOUBLE) / count(DISTINCT receipt_id) / 100.0 AS avg_order_value FROM s GROUP BY 1""")
def rfm_features(t):
    return gold.rfm(t.receipts.where("payment_status <> 'DECLINED'"), customer="customer_id", receipt="receipt_id", at="event_ts", cents="total_cents")


@query("daily_demand", """
SELECT store_id, product_id, event_date, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(ext_cents) AS BIGINT) AS revenue_cents FROM v_lines WHERE line_type = 'SALE' GROUP BY 1, 2, 3""")
def daily_demand(t):
    return t.lines.where("line_type = 'SALE'").groupBy("store_id", "product_id", "event_date").agg(
        F.sum("quantity").alias("units"), F.sum("ext_cents").alias("revenue_cents")
    )


@query("conditional_window_sums", """
WITH d AS (SELECT store_id, product_id, quantity, date_diff('day', event_date, (SELECT max(event_date) FROM v_lines)) AS age FROM v_lines)
SELECT store_id, product_id, CAST(coalesce(sum(quantity) FILTER (WHERE age < 7), 0) AS BIGINT) AS demand_7d, CAST(coalesce(sum(quantity) FILTER (WHERE age < 14), 0) AS BIGINT) AS demand_14d,
       CAST(coalesce(sum(quantity) FILTER (WHERE age < 30), 0) AS BIGINT) AS demand_30d FROM d GROUP BY 1, 2""")
def conditional_window_sums(t):
    as_of = t.lines.agg(F.max("event_date")).scalar()
    return gold.trailing_sums(t.lines, ["store_id", "product_id"], date="event_date", value="quantity", as_of=as_of, days=[7, 14, 30], prefix="demand")


@query("distinct_devices", f"SELECT store_id, count(DISTINCT customer_ble_id) AS devices FROM v_pings WHERE event_ts > {LAST} - INTERVAL 30 HOUR GROUP BY 1")
def distinct_devices(t):
    return recent(t, t.pings, 30, "event_ts").groupBy("store_id").agg(F.countDistinct("customer_ble_id").alias("devices"))


@query("approx_distinct_devices")
def approx_distinct_devices(t):
    return recent(t, t.pings, 30, "event_ts").groupBy("store_id").agg(F.approx_count_distinct("customer_ble_id").alias("devices"))


@query("percentile_stats", """
SELECT store_id, count(*) AS n, round(quantile_cont(ext_cents, 0.5), 4) AS median_cents, round(quantile_cont(ext_cents, 0.9), 4) AS p90_cents FROM v_lines GROUP BY 1""")
def percentile_stats(t):
    exact = ranges.exact_percentiles(t.lines, ["store_id"], "ext_cents", {"median_cents": 0.5, "p90_cents": 0.9})
    return exact.select("store_id", "n", F.round("median_cents", 4).alias("median_cents"), F.round("p90_cents", 4).alias("p90_cents"))


@query("percentile_stats_approx")
def percentile_stats_approx(t):
    """The sketch form, for dashboards where a small rank error is fine."""
    return t.lines.groupBy("store_id").agg(
        F.percentile_approx("ext_cents", 0.5).alias("median_cents"), F.percentile_approx("ext_cents", 0.9).alias("p90_cents")
    )


@query("promo_lines", """
SELECT receipt_id, line_num, product_id, promo_code, quantity, unit_cents * quantity - ext_cents AS discount_cents FROM v_lines
WHERE line_type = 'SALE' AND promo_code IS NOT NULL AND unit_cents * quantity - ext_cents > 0""")
def promo_lines(t):
    return gold.promo_lines(t.lines).select("receipt_id", "line_num", "product_id", "promo_code", "quantity", "discount_cents")


@query("promo_rollup", """
SELECT receipt_id, promo_code, CAST(sum(unit_cents * quantity - ext_cents) AS BIGINT) AS discount_cents, count(DISTINCT product_id) AS product_count,
       string_agg(DISTINCT CAST(product_id AS VARCHAR), ',' ORDER BY product_id) AS product_ids, 'PERCENTAGE' AS discount_type
FROM v_lines WHERE line_type = 'SALE' AND promo_code IS NOT NULL AND unit_cents * quantity - ext_cents > 0 GROUP BY 1, 2""".replace(
    "string_agg(DISTINCT CAST(product_id AS VARCHAR), ',' ORDER BY product_id)", "array_to_string(list_sort(list(DISTINCT product_id)), ',')"))
def promo_rollup(t):
    return gold.promo_rollup(gold.promo_lines(t.lines))


@query("countif_rate", "SELECT user_id % 10 AS store_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) * 100.0 AS failure_rate FROM events GROUP BY 1")
def countif_rate(t):
    failed = F.count_if(F.col("event_type") == "error")
    return t.raw.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("total"), failed.alias("failed"), (gold.ratio(failed, F.count(F.lit(1))) * 100.0).alias("failure_rate")
    )


@query("zone_dwell_heatmap", f"""
WITH m AS (SELECT store_id, event_type AS zone, date_trunc('minute', ingest_timestamp) AS ts, sum(k) AS dwell, count(*) AS n, sum(k % 7) AS customers FROM v_raw GROUP BY 1, 2, 3)
SELECT store_id, zone, CAST(sum(dwell) AS DOUBLE) / sum(n) AS avg_dwell, CAST(sum(customers) AS BIGINT) AS customers FROM m WHERE ts > {LAST} - INTERVAL 24 HOUR GROUP BY 1, 2""")
def zone_dwell_heatmap(t):
    """Dwell is weighted by visits; averaging per-minute averages would favour quiet minutes."""
    minutes = gold.by_minute(
        t.raw.withColumn("zone", F.col("event_type")), ["store_id", "zone"], "ingest_timestamp",
        [F.sum("k").alias("dwell"), F.count(F.lit(1)).alias("n"), F.sum(F.col("k") % 7).alias("customers")],
    )
    return recent(t, minutes, 24, "ts").groupBy("store_id", "zone").agg(
        gold.ratio(F.sum("dwell"), F.sum("n")).alias("avg_dwell"), F.sum("customers").alias("customers")
    )


@query("receipts_minute_by_store", f"""
SELECT store_id, date_trunc('minute', ingest_timestamp) AS ts, CAST(sum({CENTS}) AS DOUBLE) / 100.0 AS total_sales, count(*) AS receipts,
       CAST(sum({CENTS}) AS DOUBLE) / 100.0 / count(*) AS avg_basket {SALES} GROUP BY 1, 2 HAVING date_trunc('minute', ingest_timestamp) > {LAST} - INTERVAL 24 HOUR""")
def receipts_minute_by_store(t):
    return recent(t, gold.by_minute(receipts(t), ["store_id"], "ingest_timestamp", gold.sales_metrics("cents")), 24, "ts")


@query("online_orders_15m", f"""
SELECT count(*) AS orders, CAST(sum({CENTS}) AS DOUBLE) / 100.0 AS total, CAST(sum({CENTS}) AS DOUBLE) / 100.0 / count(*) AS aov
{SALES} AND ingest_timestamp > {LAST} - INTERVAL 6 HOUR""")
def online_orders_15m(t):
    total = gold.dollars(F.sum("cents"))
    return recent(t, receipts(t), 6).agg(F.count(F.lit(1)).alias("orders"), total.alias("total"), (total / F.count(F.lit(1))).alias("aov"))


@query("tender_mix", f"SELECT k % 4 AS payment_method, CAST(sum({CENTS}) AS DOUBLE) / 100.0 AS amount {SALES} AND ingest_timestamp > {LAST} - INTERVAL 24 HOUR GROUP BY 1")
def tender_mix(t):
    return recent(t, receipts(t), 24).groupBy((F.col("k") % 4).alias("payment_method")).agg(gold.dollars(F.sum("cents")).alias("amount"))


# --- price recommendations: views are proposals, clicks approvals, errors rejections ---

CREATED_SQL = """
created AS (SELECT event_id, ts AS event_ts, user_id * 10 + k % 10 AS recommendation_id, 'D' || CAST(k % 5 AS VARCHAR) AS department,
  k AS confidence_pct, CAST(round(value * 100) AS BIGINT) - 2000 AS impact_cents, 1000 + user_id AS current_cents,
  (1000 + user_id) * (75 + k % 40) // 100 AS recommended_cents,
  CASE WHEN k % 3 = 0 THEN 'CLOSED' ELSE 'PENDING' END AS status, CASE WHEN k % 4 = 0 THEN 'HAS_WARNINGS' ELSE 'ALL_PASS' END AS constraint_status
  FROM v_events WHERE event_type = 'view'),
pend AS (SELECT * FROM created WHERE status = 'PENDING' QUALIFY row_number() OVER (PARTITION BY recommendation_id ORDER BY event_ts DESC, event_id DESC) = 1),
made AS (SELECT event_id, ts AS event_ts, user_id * 10 + k % 10 AS recommendation_id, k % 8 AS approver_id, k % 6 AS reason,
  CASE event_type WHEN 'click' THEN 'Approved' ELSE 'Rejected' END AS action FROM v_events WHERE event_type IN ('click', 'error'))"""


def created(t):
    k = F.col("k")
    base = 1000 + F.col("user_id")
    return t.keyed_events.where("event_type = 'view'").select(
        "event_id", F.col("ts").alias("event_ts"), (F.col("user_id") * 10 + k % 10).alias("recommendation_id"),
        F.concat(F.lit("D"), (k % 5).cast("string")).alias("department"), k.alias("confidence_pct"),
        (F.round(F.col("value") * 100).cast("bigint") - 2000).alias("impact_cents"), base.alias("current_cents"),
        F.expr("(1000 + user_id) * (75 + k % 40) div 100").alias("recommended_cents"),
        F.when(k % 3 == 0, "CLOSED").otherwise("PENDING").alias("status"),
        F.when(k % 4 == 0, "HAS_WARNINGS").otherwise("ALL_PASS").alias("constraint_status"),
    )


def made(t):
    def part(kind):
        return t.keyed_events.where(F.col("event_type") == kind).select(
            "event_id", F.col("ts").alias("event_ts"), (F.col("user_id") * 10 + F.col("k") % 10).alias("recommendation_id"),
            (F.col("k") % 8).alias("approver_id"), (F.col("k") % 6).alias("reason"),
        )

    return approvals.decisions(part("click"), part("error"))


@query("pricing_pending_summary", f"""WITH {CREATED_SQL}
SELECT department, constraint_status, count(*) AS recommendations, CAST(sum(impact_cents) AS BIGINT) AS impact_cents, CAST(sum(impact_cents) AS DOUBLE) / count(*) AS avg_impact_cents FROM pend GROUP BY 1, 2""")
def pricing_pending_summary(t):
    return approvals.pending(created(t)).groupBy("department", "constraint_status").agg(
        F.count(F.lit(1)).alias("recommendations"), F.sum("impact_cents").alias("impact_cents"), F.avg("impact_cents").alias("avg_impact_cents")
    )


@query("pricing_top_pending", f"""WITH {CREATED_SQL}
SELECT recommendation_id, current_cents, recommended_cents, impact_cents, constraint_status FROM pend ORDER BY impact_cents DESC, recommendation_id LIMIT 10""")
def pricing_top_pending(t):
    return approvals.pending(created(t)).orderBy(F.desc("impact_cents"), "recommendation_id").limit(10).select(
        "recommendation_id", "current_cents", "recommended_cents", "impact_cents", "constraint_status"
    )


@query("price_change_buckets", f"""WITH {CREATED_SQL}, b AS (SELECT *, round(CAST(recommended_cents - current_cents AS DOUBLE) / current_cents * 100, 1) AS change_pct FROM pend)
SELECT CASE WHEN change_pct < -20 THEN 'Large Markdown (>20%)' WHEN change_pct < -10 THEN 'Moderate Markdown (10-20%)' WHEN change_pct < -5 THEN 'Small Markdown (5-10%)'
  WHEN change_pct < 5 THEN 'Minimal Change (<5%)' WHEN change_pct < 10 THEN 'Small Increase (5-10%)' ELSE 'Large Increase (>10%)' END AS change_bucket,
  CASE WHEN confidence_pct >= 90 THEN 'Very High (>=90%)' WHEN confidence_pct >= 70 THEN 'High (70-90%)' WHEN confidence_pct >= 50 THEN 'Medium (50-70%)' ELSE 'Low (<50%)' END AS confidence_bucket,
  count(*) AS recommendations FROM b GROUP BY 1, 2""")
def price_change_buckets(t):
    change = F.round(gold.ratio(F.col("recommended_cents") - F.col("current_cents"), F.col("current_cents")) * 100, 1)
    return approvals.pending(created(t)).groupBy(
        approvals.change_bucket(change).alias("change_bucket"), approvals.confidence_bucket(F.col("confidence_pct")).alias("confidence_bucket")
    ).agg(F.count(F.lit(1)).alias("recommendations"))


@query("pricing_decision_metrics", f"WITH {CREATED_SQL} SELECT date_trunc('hour', event_ts) AS hour, action, count(*) AS decisions FROM made GROUP BY 1, 2")
def pricing_decision_metrics(t):
    return approvals.per_hour(made(t))


@query("pricing_approval_by_confidence", f"""WITH {CREATED_SQL}
SELECT CASE WHEN confidence_pct >= 90 THEN 'Very High (>=90%)' WHEN confidence_pct >= 70 THEN 'High (70-90%)' WHEN confidence_pct >= 50 THEN 'Medium (50-70%)' ELSE 'Low (<50%)' END AS confidence_bucket,
  count(*) AS total, count(*) FILTER (WHERE action = 'Approved') AS approved, CAST(count(*) FILTER (WHERE action = 'Approved') AS DOUBLE) / count(*) AS approval_rate
FROM made JOIN pend USING (recommendation_id) GROUP BY 1""")
def pricing_approval_by_confidence(t):
    return approvals.approval_rate(made(t), approvals.pending(created(t)))


@query("pricing_approver_activity", f"""WITH {CREATED_SQL} SELECT approver_id, action, count(*) AS decisions FROM made WHERE event_ts > {LAST} - INTERVAL 168 HOUR
GROUP BY 1, 2 ORDER BY decisions DESC, approver_id, action LIMIT 10""")
def pricing_approver_activity(t):
    counts = recent(t, made(t), 168, "event_ts").groupBy("approver_id", "action").agg(F.count(F.lit(1)).alias("decisions"))
    return counts.orderBy(F.desc("decisions"), "approver_id", "action").limit(10)


@query("pricing_decision_time", f"""WITH {CREATED_SQL}, d AS (SELECT CAST(floor(floor(epoch_us(m.event_ts) / 1000000) / 60) - floor(floor(epoch_us(c.event_ts) / 1000000) / 60) AS BIGINT) AS minutes
  FROM made m JOIN pend c USING (recommendation_id))
SELECT count(*) AS n, quantile_cont(minutes, 0.5) AS median_minutes, CAST(sum(minutes) AS DOUBLE) / count(*) AS avg_minutes FROM d""")
def pricing_decision_time(t):
    spent = approvals.decision_minutes(made(t), approvals.pending(created(t)))
    middle = ranges.exact_percentiles(spent, [], "minutes", {"median_minutes": 0.5})
    mean = spent.agg(F.avg("minutes").alias("m")).scalar()
    return middle.withColumn("avg_minutes", mean)


@query("pricing_realized_impact", f"""WITH {CREATED_SQL} SELECT CAST(m.event_ts AS DATE) AS day, CAST(sum(c.impact_cents) AS BIGINT) AS impact_cents
FROM made m JOIN pend c USING (recommendation_id) WHERE m.action = 'Approved' GROUP BY 1""")
def pricing_realized_impact(t):
    won = made(t).where("action = 'Approved'").select("recommendation_id", "event_ts")
    worth = approvals.pending(created(t)).select("recommendation_id", "impact_cents")
    return won.join(worth, "recommendation_id").groupBy(F.to_date("event_ts").alias("day")).agg(F.sum("impact_cents").alias("impact_cents"))


@query("pricing_top_rejections", f"WITH {CREATED_SQL} SELECT reason, count(*) AS rejections FROM made WHERE action = 'Rejected' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def pricing_top_rejections(t):
    return made(t).where("action = 'Rejected'").groupBy("reason").agg(F.count(F.lit(1)).alias("rejections")).orderBy(F.desc("rejections"), "reason").limit(10)


# --- multi-level slicing, headers, freshness, movements ---

@query("cube_rollup_sales", """
SELECT department, category, region, GROUPING_ID(department, category, region) AS level, CAST(sum(ext_cents) AS BIGINT) AS ext_cents, CAST(sum(quantity) AS BIGINT) AS units
FROM v_lines JOIN v_products USING (product_id) JOIN v_stores USING (store_id) GROUP BY CUBE (department, category, region)""")
def cube_rollup_sales(t):
    """Base level first, then the cube over the small base: facts are not expanded eightfold."""
    base = (
        t.lines.select("product_id", "store_id", "ext_cents", "quantity")
        .join(t.products.select("product_id", "department", "category"), "product_id")
        .join(t.stores.select("store_id", "region"), "store_id")
        .groupBy("department", "category", "region")
        .agg(F.sum("ext_cents").alias("ext_cents"), F.sum("quantity").alias("units"))
    )
    return base.cube("department", "category", "region").agg(
        F.grouping_id().alias("level"), F.sum("ext_cents").alias("ext_cents"), F.sum("units").alias("units")
    )


@query("rollup_sales_calendar", """
SELECT year(event_date) AS year, quarter(event_date) AS quarter, month(event_date) AS month, GROUPING_ID(year(event_date), quarter(event_date), month(event_date)) AS level,
       CAST(sum(total_cents) AS BIGINT) AS total_cents FROM v_receipts GROUP BY ROLLUP (year(event_date), quarter(event_date), month(event_date))""")
def rollup_sales_calendar(t):
    daily = t.receipts.groupBy("event_date").agg(F.sum("total_cents").alias("cents"))
    parts = daily.select(
        F.year("event_date").cast("bigint").alias("year"), F.quarter("event_date").cast("bigint").alias("quarter"),
        F.month("event_date").cast("bigint").alias("month"), "cents",
    )
    return parts.rollup("year", "quarter", "month").agg(F.grouping_id().alias("level"), F.sum("cents").alias("total_cents"))


@query("global_scalar_agg", "SELECT min(event_ts) AS first_ts, max(event_ts) AS source_as_of, count(*) AS rows, CAST(sum(total_cents) AS DOUBLE) / count(*) AS avg_cents FROM v_receipts")
def global_scalar_agg(t):
    return t.receipts.agg(
        F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("source_as_of"), F.count(F.lit(1)).alias("rows"), F.avg("total_cents").alias("avg_cents")
    )


@query("header_from_lines", """
WITH s AS (SELECT receipt_id, CAST(sum(ext_cents) AS BIGINT) AS subtotal_cents, CAST(sum(discount_cents) AS BIGINT) AS discount_cents, CAST(sum(tax_cents) AS BIGINT) AS tax_cents FROM v_lines WHERE line_type <> 'RETURN' GROUP BY 1)
SELECT receipt_id, customer_id, coalesce(subtotal_cents, 0) AS subtotal_cents, coalesce(discount_cents, 0) AS discount_cents, coalesce(tax_cents, 0) AS tax_cents,
       coalesce(subtotal_cents, 0) + coalesce(tax_cents, 0) AS total_cents FROM v_receipts LEFT JOIN s USING (receipt_id)""")
def header_from_lines(t):
    return gold.header_from_lines(t.receipts.select("receipt_id", "customer_id"), t.lines, "receipt_id", counted=F.col("line_type") != "RETURN")


@query("freshness_by_source", """
SELECT 'receipts' AS source, count(*) AS rows, max(o_orderdate) AS latest FROM orders UNION ALL SELECT 'lines', count(*), max(l_shipdate) FROM lineitem
UNION ALL SELECT 'events', count(*), max(ts) FROM events""")
def freshness_by_source(t):
    return gold.freshness({"receipts": (t.receipts, "event_ts"), "lines": (t.lines, "event_ts"), "events": (t.events, "ts")})


@query("inventory_movement_summary", """
SELECT store_id, brand, txn_type, count(*) AS movements, CAST(sum(quantity) AS BIGINT) AS net_quantity, max(event_ts) AS latest FROM v_inventory_txn GROUP BY 1, 2, 3
ORDER BY latest DESC, store_id, brand, txn_type LIMIT 25""")
def inventory_movement_summary(t):
    return (
        t.inventory_txn.groupBy("store_id", "brand", "txn_type")
        .agg(F.count(F.lit(1)).alias("movements"), F.sum("quantity").alias("net_quantity"), F.max("event_ts").alias("latest"))
        .orderBy(F.desc("latest"), "store_id", "brand", "txn_type").limit(25)
    )


@query("replenishment_signals", """
SELECT event_type AS signal, store_id, product_id, count(*) AS events, max(ingest_timestamp) AS latest FROM v_raw WHERE event_type IN ('error', 'signup') GROUP BY 1, 2, 3
ORDER BY latest DESC, signal, store_id, product_id LIMIT 25""")
def replenishment_signals(t):
    return (
        t.raw.where(F.col("event_type").isin("error", "signup")).groupBy(F.col("event_type").alias("signal"), "store_id", "product_id")
        .agg(F.count(F.lit(1)).alias("events"), F.max("ingest_timestamp").alias("latest"))
        .orderBy(F.desc("latest"), "signal", "store_id", "product_id").limit(25)
    )


@query("fulfilment_progression", f"SELECT event_type AS stage, count(*) AS events FROM events WHERE event_type IN ('view', 'click', 'purchase') AND ts > {LAST} - INTERVAL 24 HOUR GROUP BY 1")
def fulfilment_progression(t):
    staged = t.events.where(F.col("event_type").isin("view", "click", "purchase"))
    return recent(t, staged, 24, "ts").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("events"))


# --- top-k ---

@query("top_n_products_by_sales", """
SELECT product_id, CAST(sum(ext_cents) AS BIGINT) AS revenue_cents, CAST(sum(quantity) AS BIGINT) AS units FROM v_lines WHERE line_type = 'SALE' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""")
def top_n_products_by_sales(t):
    return (
        t.lines.where("line_type = 'SALE'").groupBy("product_id").agg(F.sum("ext_cents").alias("revenue_cents"), F.sum("quantity").alias("units"))
        .orderBy(F.desc("revenue_cents"), "product_id").limit(25)
    )


@query("top_products_min_days", """
SELECT product_id, CAST(sum(ext_cents) AS BIGINT) AS revenue_cents, CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT event_date) AS days_sold FROM v_lines
GROUP BY 1 HAVING count(DISTINCT event_date) >= 30 ORDER BY 2 DESC, 1 LIMIT 100""")
def top_products_min_days(t):
    per_day = t.lines.groupBy("product_id", "event_date").agg(F.sum("ext_cents").alias("c"), F.sum("quantity").alias("q"))
    return (
        per_day.groupBy("product_id").agg(F.sum("c").alias("revenue_cents"), F.sum("q").alias("units"), F.count(F.lit(1)).alias("days_sold"))
        .where("days_sold >= 30").orderBy(F.desc("revenue_cents"), "product_id").limit(100)
    )


@query("top_stores_by_sales", f"""
SELECT store_id, CAST(sum({CENTS}) AS BIGINT) AS sales_cents {SALES} AND ingest_timestamp > {LAST} - INTERVAL 24 HOUR GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_stores_by_sales(t):
    return recent(t, receipts(t), 24).groupBy("store_id").agg(F.sum("cents").alias("sales_cents")).orderBy(F.desc("sales_cents"), "store_id").limit(10)


@query("stockouts_open_by_store", f"""
SELECT store_id, product_id, k % 4 AS last_known_quantity, ingest_timestamp AS last_event_ts FROM v_raw WHERE event_type = 'error' AND ingest_timestamp > {LAST} - INTERVAL 168 HOUR
QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY ingest_timestamp DESC, event_id DESC) = 1""")
def stockouts_open_by_store(t):
    facts = recent(t, t.raw.where("event_type = 'error'"), 168)
    return gold.latest_per_key(facts, ["store_id", "product_id"], [F.desc("ingest_timestamp"), F.desc("event_id")]).select(
        "store_id", "product_id", (F.col("k") % 4).alias("last_known_quantity"), F.col("ingest_timestamp").alias("last_event_ts")
    )


@query("intersect_customers", """
SELECT c AS customer_id FROM (SELECT customer_id AS c FROM v_receipts WHERE payment_status = 'APPROVED' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')""")
def intersect_customers(t):
    in_store = t.receipts.where("payment_status = 'APPROVED'").select("customer_id")
    online = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("customer_id"))
    return in_store.intersect(online)
