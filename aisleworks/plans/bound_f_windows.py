"""Ordered and calendar operators on the fixture tables."""

from pyspark.sql import functions as F

from aisleworks.operators import gold, ledger, ranges
from aisleworks.operators.ordered import find_hot_keys
from aisleworks.plans.registry import query

ORDER = ["event_ts", "receipt_id", "line_num", "product_id", "gross_cents"]
ORDER_SQL = "event_ts, receipt_id, line_num, product_id, gross_cents"
KEYS = ["store_id", "brand"]

LEDGER_SQL = f"""
WITH txns AS (SELECT store_id, brand, event_ts, receipt_id, line_num, product_id, gross_cents, quantity, txn_type FROM v_inventory_txn
  UNION ALL SELECT store_id, brand, min(event_ts) - INTERVAL 1 SECOND, NULL, NULL, NULL, NULL, 120, 'INITIAL' FROM v_inventory_txn GROUP BY 1, 2),
ledger AS (SELECT *, CAST(sum(quantity) OVER (PARTITION BY store_id, brand ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM txns)"""


def store_ledger(t):
    opened = ledger.with_opening(t.inventory_txn, KEYS, quantity=F.lit(120).cast("bigint"), at="event_ts")
    return ledger.running_balance(opened, KEYS, ORDER, hot=ledger_hot(t))


def ledger_hot(t):
    """Counted on the movements themselves; the opening row adds one per key."""
    return find_hot_keys(t.inventory_txn, KEYS, "event_ts")


@query("running_balance", LEDGER_SQL + " SELECT store_id, brand, event_ts, receipt_id, line_num, product_id, txn_type, quantity, balance FROM ledger")
def running_balance(t):
    return store_ledger(t).select("store_id", "brand", "event_ts", "receipt_id", "line_num", "product_id", "txn_type", "quantity", "balance")


@query("stockout_crossings", LEDGER_SQL + f""", p AS (SELECT *, lag(balance) OVER (PARTITION BY store_id, brand ORDER BY {ORDER_SQL}) AS previous_balance FROM ledger)
SELECT store_id, brand, event_ts, CAST(event_ts AS DATE) AS event_date, receipt_id, balance, previous_balance, abs(quantity) AS last_known_quantity FROM p
WHERE balance <= 0 AND previous_balance > 0 QUALIFY row_number() OVER (PARTITION BY store_id, brand, CAST(event_ts AS DATE) ORDER BY {ORDER_SQL}) = 1""")
def stockout_crossings(t):
    return ledger.stockout_crossings(store_ledger(t), KEYS, ORDER, at="event_ts", hot=ledger_hot(t)).select(
        "store_id", "brand", "event_ts", "event_date", "receipt_id", "balance", "previous_balance", F.abs("quantity").alias("last_known_quantity")
    )


@query("end_of_day_snapshot", LEDGER_SQL + """ SELECT store_id, brand, CAST(event_ts AS DATE) AS snapshot_date, balance AS on_hand FROM ledger
QUALIFY row_number() OVER (PARTITION BY store_id, brand, CAST(event_ts AS DATE) ORDER BY event_ts DESC NULLS LAST, receipt_id DESC NULLS LAST,
  line_num DESC NULLS LAST, product_id DESC NULLS LAST, gross_cents DESC NULLS LAST) = 1""")
def end_of_day_snapshot(t):
    return ledger.end_of_day(store_ledger(t), KEYS, ORDER, at="event_ts").select("store_id", "brand", "snapshot_date", F.col("balance").alias("on_hand"))


POSITION_SQL = LEDGER_SQL + """ SELECT store_id, brand, balance AS on_hand, event_ts AS as_of FROM ledger
QUALIFY row_number() OVER (PARTITION BY store_id, brand ORDER BY event_ts DESC, receipt_id DESC NULLS LAST, line_num DESC, product_id DESC, gross_cents DESC) = 1"""


def position(t):
    return gold.latest_per_key(store_ledger(t), KEYS, [F.desc(c) for c in ORDER]).select(
        "store_id", "brand", F.col("balance").alias("on_hand"), F.col("event_ts").alias("as_of")
    )


@query("inventory_position_current", POSITION_SQL)
def inventory_position_current(t):
    """On-hand from the filled balance; the last movement wins with a full tie-break."""
    return position(t)


@query("dc_inventory_position_current", """
WITH txns AS (SELECT store_id % 5 AS dc_id, brand, event_ts, receipt_id, line_num, product_id, gross_cents, quantity FROM v_inventory_txn),
l AS (SELECT *, CAST(sum(quantity) OVER (PARTITION BY dc_id, brand ORDER BY event_ts, receipt_id, line_num, product_id, gross_cents ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM txns)
SELECT dc_id, brand, balance AS on_hand, event_ts AS as_of FROM l
QUALIFY row_number() OVER (PARTITION BY dc_id, brand ORDER BY event_ts DESC, receipt_id DESC, line_num DESC, product_id DESC, gross_cents DESC) = 1""")
def dc_inventory_position_current(t):
    """The last balance is the total of all movements, so one aggregate gives it without ordering them."""
    moves = t.inventory_txn.withColumn("dc_id", F.col("store_id") % 5)
    return moves.groupBy("dc_id", "brand").agg(F.sum("quantity").alias("on_hand"), F.max("event_ts").alias("as_of"))


@query("arg_max_star", """
SELECT customer_id, receipt_id, event_ts, total_cents FROM v_receipts QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_ts DESC, receipt_id DESC) = 1""")
def arg_max_star(t):
    return gold.latest_per_key(t.receipts, ["customer_id"], [F.desc("event_ts"), F.desc("receipt_id")]).select("customer_id", "receipt_id", "event_ts", "total_cents")


@query("arg_min_star", """
SELECT customer_id, receipt_id, event_ts, total_cents FROM v_receipts QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_ts, receipt_id) = 1""")
def arg_min_star(t):
    return gold.latest_per_key(t.receipts, ["customer_id"], [F.asc("event_ts"), F.asc("receipt_id")]).select("customer_id", "receipt_id", "event_ts", "total_cents")


@query("latest_by_key", """
SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_by_key(t):
    return gold.latest_per_key(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts")


@query("dedupe_keep_first", """
SELECT receipt_id, line_num, product_id, event_ts, gross_cents FROM v_lines QUALIFY row_number() OVER (PARTITION BY receipt_id, line_num
  ORDER BY event_ts ASC NULLS LAST, product_id, gross_cents, store_id) = 1""")
def dedupe_keep_first(t):
    return gold.latest_per_key(
        t.lines, ["receipt_id", "line_num"], [F.col("event_ts").asc_nulls_last(), F.asc("product_id"), F.asc("gross_cents"), F.asc("store_id")]
    ).select("receipt_id", "line_num", "product_id", "event_ts", "gross_cents")


@query("top_k_per_group", """
SELECT store_id, product_id, CAST(sum(quantity) AS BIGINT) AS demand, row_number() OVER (PARTITION BY store_id ORDER BY sum(quantity) DESC, product_id) AS rank
FROM v_lines WHERE line_type = 'SALE' GROUP BY 1, 2 QUALIFY rank <= 5""")
def top_k_per_group(t):
    demand = t.lines.where("line_type = 'SALE'").groupBy("store_id", "product_id").agg(F.sum("quantity").alias("demand"))
    return gold.top_per_group(demand, ["store_id"], [F.desc("demand"), F.asc("product_id")], 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("global_rank", "SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events")
def global_rank(t):
    return ranges.global_rank(t.events.select("event_id", "value"), [F.desc("value"), F.asc("event_id")])


# --- daily series: brand demand ---

DAILY_SQL = "daily AS (SELECT brand, CAST(event_ts AS DATE) AS sale_date, CAST(sum(abs(quantity)) AS BIGINT) AS units, CAST(sum(gross_cents) AS BIGINT) AS revenue_cents FROM v_inventory_txn GROUP BY 1, 2)"


def brand_daily(t):
    return t.inventory_txn.groupBy("brand", F.to_date("event_ts").alias("sale_date")).agg(
        F.sum(F.abs("quantity")).alias("units"), F.sum("gross_cents").alias("revenue_cents")
    )


@query("lag_features", f"""WITH {DAILY_SQL} SELECT brand, sale_date, units, lag(units, 1) OVER w AS lag_1, lag(units, 7) OVER w AS lag_7, lag(units, 14) OVER w AS lag_14, lag(units, 28) OVER w AS lag_28
FROM daily WINDOW w AS (PARTITION BY brand ORDER BY sale_date)""")
def lag_features(t):
    return ledger.lag_columns(brand_daily(t), ["brand"], "sale_date", "units", [1, 7, 14, 28]).drop("revenue_cents")


@query("rolling_features", f"""WITH {DAILY_SQL} SELECT brand, sale_date, units, round(avg(units) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS mean_7, round(avg(units) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 6) AS mean_14,
round(avg(units) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS mean_28, round(stddev_samp(units) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 6) AS std_14
FROM daily WINDOW w AS (PARTITION BY brand ORDER BY sale_date)""")
def rolling_features(t):
    out = ledger.rolling_columns(brand_daily(t), ["brand"], "sale_date", "units", means=[7, 14, 28], deviations=[14])
    return out.select("brand", "sale_date", "units", *[F.round(c, 6).alias(c) for c in ("mean_7", "mean_14", "mean_28", "std_14")])


@query("calendar_features", """
SELECT DISTINCT event_date, CAST(dayofweek(event_date) + 1 AS INTEGER) AS day_of_week, CAST(day(event_date) AS INTEGER) AS day_of_month, CAST(month(event_date) AS INTEGER) AS month,
       CAST(weekofyear(event_date) AS INTEGER) AS week_of_year, CASE WHEN dayofweek(event_date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend FROM v_receipts""")
def calendar_features(t):
    return ledger.calendar_columns(t.receipts.select("event_date").distinct(), "event_date")


@query("dense_calendar", f"""WITH {DAILY_SQL}, lim AS (SELECT max(sale_date) AS hi, max(sale_date) - 60 AS cut FROM daily),
spans AS (SELECT brand, min(sale_date) AS first_date FROM daily WHERE sale_date <= (SELECT cut FROM lim) GROUP BY 1
  HAVING (SELECT cut FROM lim) - min(sale_date) + 1 >= 90 AND CAST(sum(units) AS DOUBLE) / ((SELECT cut FROM lim) - min(sale_date) + 1) >= 0.5),
cal AS (SELECT brand, CAST(unnest(generate_series(CAST(first_date AS TIMESTAMP), CAST((SELECT hi FROM lim) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS sale_date FROM spans)
SELECT brand, sale_date, coalesce(units, 0) AS units, coalesce(revenue_cents, 0) AS revenue_cents FROM cal LEFT JOIN daily USING (brand, sale_date)""")
def dense_calendar(t):
    daily = brand_daily(t)
    last = daily.agg(F.max("sale_date").alias("m"))
    return ledger.dense_calendar(
        daily, ["brand"], date="sale_date", measures=["units", "revenue_cents"], end=last.scalar(),
        eligible_until=last.select(F.date_sub("m", 60)).scalar(), min_history_days=90, min_daily=0.5,
    )


@query("promo_episodes", """
WITH d AS (SELECT DISTINCT store_id, promo_code, event_date FROM v_lines WHERE promo_code IS NOT NULL),
f AS (SELECT *, CASE WHEN coalesce(event_date - lag(event_date) OVER w > 7, true) THEN 1 ELSE 0 END AS s FROM d WINDOW w AS (PARTITION BY store_id, promo_code ORDER BY event_date))
SELECT store_id, promo_code, event_date, CAST(sum(s) OVER (PARTITION BY store_id, promo_code ORDER BY event_date) AS BIGINT) AS episode FROM f""")
def promo_episodes(t):
    days = t.lines.where("promo_code IS NOT NULL").select("store_id", "promo_code", "event_date").distinct()
    return ledger.promo_episodes(days, ["store_id", "promo_code"], "event_date")


PLAN_SQL = """
d AS (SELECT store_id % 10 AS store_id, event_date, product_id, CAST(sum(quantity) AS BIGINT) AS demand FROM v_lines WHERE line_type = 'SALE' GROUP BY 1, 2, 3),
best AS (SELECT *, 20 + product_id % 60 AS reorder_point, greatest(0, 20 + product_id % 60 - demand) AS current_quantity, 50 + product_id % 150 AS reorder_quantity
  FROM d QUALIFY row_number() OVER (PARTITION BY store_id, event_date ORDER BY demand DESC, product_id) <= 5),
plan AS (SELECT *, CAST((sum(reorder_quantity) OVER (PARTITION BY store_id, event_date ORDER BY product_id) - reorder_quantity) // 200 AS BIGINT) AS leg,
  CASE WHEN (reorder_point - current_quantity) * 100 >= 50 * reorder_point THEN 'URGENT' WHEN (reorder_point - current_quantity) * 100 >= 25 * reorder_point THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM best)"""


def plan(t):
    demand = t.lines.where("line_type = 'SALE'").groupBy((F.col("store_id") % 10).alias("store_id"), "event_date", "product_id").agg(F.sum("quantity").alias("demand"))
    return ledger.reorder_plan(
        demand, keys=["store_id", "event_date"], product="product_id", top=5, point=20 + F.col("product_id") % 60,
        lot=50 + F.col("product_id") % 150, capacity=200,
    )


@query("reorder_signals", f"WITH {PLAN_SQL} SELECT store_id, event_date, product_id, demand, reorder_point, current_quantity, reorder_quantity, priority FROM plan")
def reorder_signals(t):
    return plan(t).drop("leg")


@query("capacity_legs", f"WITH {PLAN_SQL} SELECT store_id, event_date, leg, count(*) AS products, CAST(sum(reorder_quantity) AS BIGINT) AS units FROM plan GROUP BY 1, 2, 3")
def capacity_legs(t):
    return plan(t).groupBy("store_id", "event_date", "leg").agg(F.count(F.lit(1)).alias("products"), F.sum("reorder_quantity").alias("units"))


SAMPLE_SQL = """
s AS (SELECT *, md5(CAST(receipt_id AS VARCHAR) || '|return') AS draw, count(*) OVER (PARTITION BY event_month) AS n FROM (SELECT *, strftime(event_date, '%Y-%m') AS event_month FROM v_receipts)),
kept AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY event_month ORDER BY ('0x' || substr(draw, 1, 12))::BIGINT, receipt_id) <= floor(least(0.10, CASE WHEN event_month LIKE '%-12' THEN 0.06 * 6 ELSE 0.06 END) * n))"""


def sampled(t):
    months = t.receipts.withColumn("event_month", F.date_format("event_date", "yyyy-MM"))
    draw = F.conv(F.substring(F.md5(F.concat(F.col("receipt_id").cast("string"), F.lit("|return"))), 1, 12), 16, 10).cast("bigint")
    december = F.col("event_month").endswith("-12")
    rate = F.least(F.lit(0.10), F.when(december, F.lit(0.06) * 6).otherwise(F.lit(0.06)))
    return ledger.exact_share_sample(months, "event_month", rate=F.first(rate), draw=draw, tie="receipt_id")


@query("sample_exact_rate", f"WITH {SAMPLE_SQL} SELECT receipt_id, event_month, total_cents FROM kept")
def sample_exact_rate(t):
    return sampled(t).select("receipt_id", "event_month", "total_cents")


@query("returns_reverse", f"""WITH {SAMPLE_SQL}, r AS (SELECT receipt_id, customer_id, event_date, total_cents, least((SELECT max(event_date) FROM v_receipts), event_date + CAST(1 + receipt_id % 30 AS INTEGER)) AS return_date FROM kept)
SELECT 'RET' || strftime(return_date, '%Y%m%d') || lpad(CAST(receipt_id AS VARCHAR), 8, '0') AS return_id, receipt_id, customer_id, CAST(return_date AS TIMESTAMP) + INTERVAL 12 HOUR AS event_ts,
       return_date, 'RETURN' AS receipt_type, -total_cents AS total_cents FROM r WHERE return_date > event_date""")
def returns_reverse(t):
    return returned(t)


def returned(t):
    return ledger.reverse_sales(
        sampled(t), amounts=["total_cents"], delay_days=1 + F.col("receipt_id") % 30, last_day=t.receipts.agg(F.max("event_date")).scalar(),
        seq_keys=["customer_id"],
    )


@query("returns_mirror_lines", f"""WITH {SAMPLE_SQL}, r AS (SELECT receipt_id, event_date, least((SELECT max(event_date) FROM v_receipts), event_date + CAST(1 + receipt_id % 30 AS INTEGER)) AS return_date FROM kept)
SELECT 'RET' || strftime(return_date, '%Y%m%d') || lpad(CAST(r.receipt_id AS VARCHAR), 8, '0') AS return_id, return_date, line_num, product_id, -quantity AS quantity, unit_cents, -ext_cents AS ext_cents,
       'RETURN' AS promo_code FROM r JOIN v_lines l ON l.receipt_id = r.receipt_id WHERE return_date > r.event_date""")
def returns_mirror_lines(t):
    return ledger.mirror_lines(returned(t), t.lines)


@query("hourly_zone_allocation", """
WITH h AS (SELECT store_id, date_trunc('hour', ingest_timestamp) AS hour_ts, CAST(count(*) * 17 AS BIGINT) AS visitors FROM v_raw GROUP BY 1, 2),
z AS (SELECT * FROM (VALUES ('ENTRANCE', 40), ('AISLES', 35), ('CHECKOUT', 25)) AS z(zone, pct))
SELECT store_id, hour_ts, visitors, zone, (visitors * pct + 50) // 100 AS zone_count FROM h, z""")
def hourly_zone_allocation(t):
    hours = t.raw.groupBy("store_id", F.date_trunc("hour", "ingest_timestamp").alias("hour_ts")).agg((F.count(F.lit(1)) * 17).alias("visitors"))
    return ledger.allocate_zones(hours, "visitors", {"ENTRANCE": 40, "AISLES": 35, "CHECKOUT": 25})


@query("zone_changes_from_pings", "SELECT event_id, event_ts, store_id, customer_ble_id, from_zone, to_zone FROM v_zone_changes")
def zone_changes_from_pings(t):
    return t.zone_changes.select("event_id", "event_ts", "store_id", "customer_ble_id", "from_zone", "to_zone")


@query("inventory_ledger", """
SELECT store_id AS node_id, product_id, event_ts, 'SALE' AS txn_type, -quantity AS quantity, 'CUSTOMER_PURCHASE' AS source FROM v_lines WHERE line_type = 'SALE'
UNION ALL SELECT store_id, product_id, event_ts, 'RETURN', quantity, CAST(receipt_id AS VARCHAR) FROM v_lines WHERE line_type = 'RETURN'
UNION ALL SELECT store_id, product_id, event_ts - INTERVAL 1 DAY, 'INBOUND_SHIPMENT', quantity, 'TRUCK' FROM v_lines WHERE line_type = 'SALE'""")
def inventory_ledger(t):
    sale, back = t.lines.where("line_type = 'SALE'"), t.lines.where("line_type = 'RETURN'")

    def moves(df, kind, quantity, source, at=F.col("event_ts")):
        return df.select(F.col("store_id").alias("node_id"), "product_id", at.alias("event_ts"), F.lit(kind).alias("txn_type"), quantity.alias("quantity"), source.alias("source"))

    q = F.col("quantity")
    return (
        moves(sale, "SALE", -q, F.lit("CUSTOMER_PURCHASE"))
        .unionByName(moves(back, "RETURN", q, F.col("receipt_id").cast("string")))
        .unionByName(moves(sale, "INBOUND_SHIPMENT", q, F.lit("TRUCK"), F.col("event_ts") - F.make_dt_interval(F.lit(1))))
    )


@query("shipment_timeline", """
WITH s AS (SELECT shipment_id, truck_id, unnest([{'status': 'SCHEDULED', 'ts': arrived - INTERVAL 3 HOUR}, {'status': 'LOADING', 'ts': arrived - INTERVAL 2 HOUR},
  {'status': 'IN_TRANSIT', 'ts': arrived - INTERVAL 1 HOUR}, {'status': 'ARRIVED', 'ts': arrived}, {'status': 'UNLOADING', 'ts': arrived + INTERVAL 1 HOUR}, {'status': 'COMPLETED', 'ts': departed}]) AS x FROM v_shipments)
SELECT shipment_id, truck_id, x.status AS status, x.ts AS event_ts, CASE WHEN x.status = 'COMPLETED' THEN x.ts END AS departure_time FROM s""")
def shipment_timeline(t):
    hours = lambda n: F.col("arrived") + F.make_dt_interval(hours=F.lit(n))
    return ledger.shipment_timeline(
        t.shipments,
        {"SCHEDULED": hours(-3), "LOADING": hours(-2), "IN_TRANSIT": hours(-1), "ARRIVED": F.col("arrived"), "UNLOADING": hours(1), "COMPLETED": F.col("departed")},
        ["shipment_id", "truck_id"],
    )


@query("load_unload", """
SELECT shipment_id, truck_id, 'LOAD' AS action, arrived AS event_ts, dc_id AS location_id, 'DC' AS location_type FROM v_shipments
UNION ALL SELECT shipment_id, truck_id, 'UNLOAD', departed, store_id, 'STORE' FROM v_shipments""")
def load_unload(t):
    return ledger.load_unload(t.shipments, ["shipment_id", "truck_id"], loaded="arrived", unloaded="departed")


@query("fulfilment_times", """
SELECT *, CASE WHEN cancelled OR waiting THEN NULL WHEN pickup THEN picked_ts ELSE shipped_ts + to_seconds(86400 + receipt_id % 172800) END AS delivered_ts,
       CASE WHEN cancelled THEN 'CANCELLED' WHEN waiting THEN 'SHIPPED' ELSE 'DELIVERED' END AS fulfilment_status FROM (
  SELECT *, CASE WHEN NOT cancelled AND NOT pickup THEN picked_ts + to_seconds(7200 + receipt_id % 7200) END AS shipped_ts FROM (
    SELECT receipt_id, event_ts, pickup, cancelled, waiting, CASE WHEN NOT cancelled THEN event_ts + to_seconds(CASE WHEN pickup THEN 14400 + receipt_id % 72000 ELSE 1800 + receipt_id % 12600 END) END AS picked_ts
    FROM (SELECT receipt_id, event_ts, receipt_id % 3 = 0 AS pickup, payment_status = 'DECLINED' AS cancelled, payment_status <> 'DECLINED' AND receipt_id % 3 <> 0 AND receipt_id % 25 = 1 AS waiting FROM v_receipts)))""")
def fulfilment_times(t):
    r = F.col("receipt_id")
    base = t.receipts.select(
        "receipt_id", "event_ts", (r % 3 == 0).alias("pickup"), (F.col("payment_status") == "DECLINED").alias("cancelled"),
        ((F.col("payment_status") != "DECLINED") & (r % 3 != 0) & (r % 25 == 1)).alias("waiting"),
    )
    return ledger.fulfilment_times(
        base, at="event_ts", pickup=F.col("pickup"), cancelled=F.col("cancelled"), waiting=F.col("waiting"),
        pick=F.when(F.col("pickup"), 14400 + r % 72000).otherwise(1800 + r % 12600), ship=7200 + r % 7200, deliver=86400 + r % 172800,
    )
