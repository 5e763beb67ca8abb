"""Joins on the fixture tables."""

from pyspark.sql import functions as F

from aisleworks.operators import gold, ranges
from aisleworks.plans.registry import query


@query("join_lines_receipts", """
SELECT r.receipt_id, count(*) AS lines, CAST(sum(l.ext_cents) AS BIGINT) AS ext_cents, max(r.total_cents) AS total_cents
FROM v_lines l JOIN v_receipts r USING (receipt_id) GROUP BY 1""")
def join_lines_receipts(t):
    joined = t.lines.select("receipt_id", "ext_cents").join(t.receipts.select("receipt_id", "total_cents"), "receipt_id")
    return joined.groupBy("receipt_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("ext_cents").alias("ext_cents"), F.max("total_cents").alias("total_cents")
    )


@query("join_star_broadcast", """
SELECT s.region, s.state, p.category, CAST(sum(l.ext_cents) AS BIGINT) AS ext_cents, CAST(sum(l.quantity) AS BIGINT) AS units
FROM v_lines l JOIN v_stores s USING (store_id) JOIN v_products p USING (product_id) GROUP BY 1, 2, 3""")
def join_star_broadcast(t):
    """Facts with dimensions; the planner broadcasts a dimension while its size allows it."""
    facts = t.lines.select("store_id", "product_id", "ext_cents", "quantity")
    star = facts.join(t.stores.select("store_id", "region", "state"), "store_id").join(
        t.products.select("product_id", "category"), "product_id"
    )
    return star.groupBy("region", "state", "category").agg(F.sum("ext_cents").alias("ext_cents"), F.sum("quantity").alias("units"))


@query("join_full_outer_counts", """
SELECT count(*) FILTER (WHERE event_type = 'view') AS created, count(*) FILTER (WHERE event_type = 'click') AS picked,
       count(*) FILTER (WHERE event_type = 'purchase') AS shipped
FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def join_full_outer_counts(t):
    """Fulfilment pipeline: counts per stage in one conditional aggregate."""
    newest = t.events.agg(F.max("ts")).scalar()
    recent = t.events.where(F.col("ts") > newest - F.make_dt_interval(hours=F.lit(24)))
    stages = {"created": "view", "picked": "click", "shipped": "purchase"}
    return recent.agg(*[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in stages.items()])


@query("join_full_outer_grid", """
WITH hours AS (
  SELECT store_id, h AS hour_ts FROM (SELECT DISTINCT store_id FROM v_raw) s,
  (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 2 HOUR)) AS h)),
counts AS (SELECT store_id, date_trunc('hour', ingest_timestamp) AS hour_ts, count(*) AS receipts FROM v_raw WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT store_id, hour_ts, coalesce(receipts, 0) AS receipts FROM hours FULL OUTER JOIN counts USING (store_id, hour_ts)""")
def join_full_outer_grid(t):
    """A two-hourly grid per store and hourly sales counts; each side has rows of its own."""
    raw = t.raw
    bounds = raw.agg(F.min("ingest_timestamp").alias("a"), F.max("ingest_timestamp").alias("b"))
    start = bounds.select(F.date_trunc("hour", "a")).scalar()
    end = bounds.select(F.date_trunc("hour", "b")).scalar()
    grid = raw.select("store_id").distinct().withColumn("hour_ts", F.explode(F.sequence(start, end, F.make_dt_interval(hours=F.lit(2)))))
    counts = raw.where("event_type = 'purchase'").groupBy("store_id", F.date_trunc("hour", "ingest_timestamp").alias("hour_ts")).agg(
        F.count(F.lit(1)).alias("receipts")
    )
    return grid.join(counts, ["store_id", "hour_ts"], "full_outer").select("store_id", "hour_ts", F.coalesce("receipts", F.lit(0)).alias("receipts"))


@query("fk_orphans", """
SELECT receipt_id, customer_id FROM v_receipts r WHERE NOT EXISTS (SELECT 1 FROM v_lines l WHERE l.receipt_id = r.receipt_id)""")
def fk_orphans(t):
    return t.receipts.join(t.lines.select("receipt_id").distinct(), "receipt_id", "left_anti").select("receipt_id", "customer_id")


LOOKBACK_SQL = """
WITH span AS (SELECT min(event_date) AS lo, max(event_date) AS hi FROM v_receipts),
snaps AS (SELECT CAST(unnest(generate_series((SELECT lo + INTERVAL 180 DAY FROM span), (SELECT CAST(hi AS TIMESTAMP) FROM span), INTERVAL 90 DAY)) AS DATE) AS snapshot_date)
"""


def snapshot_span(receipts):
    span = receipts.agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi"))
    return span.select(F.date_add("lo", 180)).scalar(), span.select("hi").scalar()


@query("join_range_lookback", LOOKBACK_SQL + """
SELECT c.customer_id, s.snapshot_date, count(r.receipt_id) AS receipts_180d, CAST(coalesce(sum(r.total_cents), 0) AS BIGINT) AS cents_180d
FROM (SELECT DISTINCT customer_id FROM v_receipts) c CROSS JOIN snaps s
LEFT JOIN v_receipts r ON r.customer_id = c.customer_id AND r.event_date >= s.snapshot_date - 180 AND r.event_date < s.snapshot_date
GROUP BY 1, 2""")
def join_range_lookback(t):
    first, last = snapshot_span(t.receipts)
    daily = t.receipts.groupBy("customer_id", "event_date").agg(F.count(F.lit(1)).alias("n"), F.sum("total_cents").alias("cents"))
    hits = ranges.explode_snapshots(daily, "event_date", first, last, every=90, behind=180).groupBy("customer_id", "snapshot_date").agg(
        F.sum("n").alias("receipts_180d"), F.sum("cents").alias("cents_180d")
    )
    grid = ranges.snapshot_grid(t.receipts.select("customer_id").distinct(), first, last, every=90)
    return grid.join(hits, ["customer_id", "snapshot_date"], "left").fillna(0)


@query("join_range_forward", LOOKBACK_SQL + """
SELECT c.customer_id, s.snapshot_date, CASE WHEN count(r.receipt_id) = 0 THEN 1 ELSE 0 END AS churned
FROM (SELECT DISTINCT customer_id FROM v_receipts) c CROSS JOIN snaps s
LEFT JOIN v_receipts r ON r.customer_id = c.customer_id AND r.event_date >= s.snapshot_date AND r.event_date < s.snapshot_date + 90
GROUP BY 1, 2""")
def join_range_forward(t):
    first, last = snapshot_span(t.receipts)
    days = t.receipts.select("customer_id", "event_date").distinct()
    bought = ranges.explode_snapshots(days, "event_date", first, last, every=90, behind=0, ahead=90).select(
        "customer_id", "snapshot_date", F.lit(0).alias("churned")
    ).distinct()
    grid = ranges.snapshot_grid(t.receipts.select("customer_id").distinct(), first, last, every=90)
    return grid.join(bought, ["customer_id", "snapshot_date"], "left").fillna(1, ["churned"])


@query("cross_snapshot_grid", LOOKBACK_SQL + """
SELECT customer_id, snapshot_date FROM (SELECT DISTINCT customer_id FROM v_receipts) CROSS JOIN snaps""")
def cross_snapshot_grid(t):
    first, last = snapshot_span(t.receipts)
    return ranges.snapshot_grid(t.receipts.select("customer_id").distinct(), first, last, every=90)


ASOF_SQL = """
SELECT p.match_key, p.purchase_id, p.purchase_ts, p.total_cents, m.touch_ts, m.impression_id, m.campaign_id, m.channel
FROM v_purchases p LEFT JOIN (
  SELECT p.purchase_id, t.*, row_number() OVER (PARTITION BY p.purchase_id ORDER BY t.touch_ts DESC, t.impression_id DESC) AS rn
  FROM v_purchases p JOIN v_touches t ON t.match_key = p.match_key AND t.touch_ts <= p.purchase_ts AND t.touch_ts >= p.purchase_ts - INTERVAL 7 DAY
) m ON m.purchase_id = p.purchase_id AND m.rn = 1"""


def last_touch(t):
    matched = ranges.asof_last(
        t.purchases.select("match_key", "purchase_id", "purchase_ts", "total_cents"), t.touches, key="match_key", at="purchase_ts",
        touch_at="touch_ts", touch_id="impression_id", carry=["campaign_id", "channel"], purchase_id="purchase_id",
    )
    return ranges.within_tolerance(
        matched, at="purchase_ts", touch_at="touch_ts",
        matched_columns=["touch_ts", "impression_id", "campaign_id", "channel"], seconds=7 * ranges.DAY_SECONDS,
    )


@query("asof_last_touch", ASOF_SQL)
def asof_last_touch(t):
    return last_touch(t)


@query("truck_lifecycle_pair", """
SELECT truck_id, dc_id, store_id, min(arrived) AS arrival_time, max(departed) AS departure_time FROM v_shipments
GROUP BY 1, 2, 3 HAVING max(departed) > min(arrived)""")
def truck_lifecycle_pair(t):
    s = t.shipments
    return gold.pair_lifecycles(
        s.withColumnRenamed("arrived", "arrival_time"), s.withColumnRenamed("departed", "departure_time"), ["truck_id", "dc_id", "store_id"]
    )


@query("nearest_by_score", """
WITH scored AS (
  SELECT a.store_id, b.dc_id, row_number() OVER (PARTITION BY a.store_id ORDER BY
    CASE WHEN a.state = b.state THEN 0 WHEN a.region = b.region THEN 1 ELSE 2 END, b.dc_id) AS rn
  FROM v_stores a, (SELECT store_id AS dc_id, state, region FROM v_stores WHERE store_id % 10 = 0) b)
SELECT store_id, dc_id FROM scored WHERE rn = 1""")
def nearest_by_score(t):
    depots = t.stores.where("store_id % 10 = 0").withColumnRenamed("store_id", "dc_id")
    return ranges.nearest_site(t.stores, depots, levels=["state", "region"], site_id="dc_id").select("store_id", "dc_id")


PRIOR_SQL = """
WITH h AS (SELECT ts AS available_ts, user_id % 10 AS loc, hour(ts) AS hr, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE event_type <> 'signup'),
t AS (SELECT event_id, ts, user_id % 10 AS loc, hour(ts) AS hr FROM events WHERE event_type = 'signup')
SELECT t.event_id, count(h.v) AS global_count, CAST(coalesce(sum(h.v), 0) AS BIGINT) AS global_sum,
       count(h.v) FILTER (WHERE h.loc = t.loc) AS loc_count, CAST(coalesce(sum(h.v) FILTER (WHERE h.loc = t.loc), 0) AS BIGINT) AS loc_sum,
       count(h.v) FILTER (WHERE h.hr = t.hr) AS hour_count, CAST(coalesce(sum(h.v) FILTER (WHERE h.hr = t.hr), 0) AS BIGINT) AS hour_sum
FROM t LEFT JOIN h ON h.available_ts < t.ts GROUP BY 1"""


@query("prior_history_join", PRIOR_SQL)
def prior_history_join(t):
    base = t.events.select(
        "event_id", "ts", (F.col("user_id") % 10).alias("loc"), F.hour("ts").alias("hr"), "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )
    found = ranges.prior_history(
        base.where("event_type = 'signup'").select("event_id", "ts", "loc", "hr"), base.where("event_type <> 'signup'"),
        target_at="ts", history_at="ts", value="v", groups={"global": [], "loc": ["loc"], "hour": ["hr"]},
    )
    return found.drop("ts", "loc", "hr")


@query("backfill_from_header", """
SELECT l.receipt_id, l.line_num, l.product_id, coalesce(CASE WHEN l.line_type = 'SALE' THEN l.event_ts END, r.event_ts) AS event_ts
FROM v_lines l LEFT JOIN v_receipts r USING (receipt_id)""")
def backfill_from_header(t):
    lines = t.lines.select("receipt_id", "line_num", "product_id", F.when(F.col("line_type") == "SALE", F.col("event_ts")).alias("line_ts"))
    head = t.receipts.select("receipt_id", F.col("event_ts").alias("header_ts"))
    return lines.join(head, "receipt_id", "left").select("receipt_id", "line_num", "product_id", F.coalesce("line_ts", "header_ts").alias("event_ts"))


@query("lookup_semijoin", """
SELECT campaign_id, count(*) AS impressions, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM v_touches
WHERE match_key IN (SELECT match_key FROM v_purchases WHERE k < 20) GROUP BY 1""")
def lookup_semijoin(t):
    buyers = t.purchases.where("k < 20").select("match_key")
    return t.touches.join(buyers, "match_key", "left_semi").groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("cost_cents").alias("cost_cents")
    )


@query("unattributed_join_map", """
WITH m AS (SELECT k AS tag, min(user_id) AS customer_id FROM v_events WHERE event_type = 'signup' AND user_id % 50 = k % 50 GROUP BY 1 HAVING count(DISTINCT user_id) = 1)
SELECT e.event_id, e.k AS tag, m.customer_id FROM v_events e LEFT JOIN m ON m.tag = e.k""")
def unattributed_join_map(t):
    """Tags that name exactly one customer; ambiguous and unknown tags stay NULL."""
    e = t.keyed_events
    known = (
        e.where("event_type = 'signup' AND user_id % 50 = k % 50").groupBy(F.col("k").alias("tag"))
        .agg(F.countDistinct("user_id").alias("_n"), F.min("user_id").alias("customer_id")).where("_n = 1").drop("_n")
    )
    return e.select("event_id", F.col("k").alias("tag")).join(known, "tag", "left").select("event_id", "tag", "customer_id")


@query("hierarchical_fallback_lookup", """
WITH rates AS (SELECT DISTINCT n_regionkey AS region, s_nationkey AS nation, s_suppkey % 20 AS city, s_suppkey % 7 AS rate FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0),
c AS (SELECT c_custkey, n_regionkey AS region, c_nationkey AS nation, c_custkey % 20 AS city FROM customer JOIN nation ON c_nationkey = n_nationkey),
l0 AS (SELECT region, nation, city, CAST(sum(rate) AS DOUBLE) / count(*) AS r FROM rates GROUP BY 1, 2, 3),
l1 AS (SELECT region, nation, CAST(sum(rate) AS DOUBLE) / count(*) AS r FROM rates GROUP BY 1, 2),
l2 AS (SELECT region, CAST(sum(rate) AS DOUBLE) / count(*) AS r FROM rates GROUP BY 1)
SELECT c_custkey, coalesce(l0.r, l1.r, l2.r, 7.5) AS rate,
       CASE WHEN l0.r IS NOT NULL THEN 0 WHEN l1.r IS NOT NULL THEN 1 WHEN l2.r IS NOT NULL THEN 2 END AS match_level
FROM c LEFT JOIN l0 USING (region, nation, city) LEFT JOIN l1 USING (region, nation) LEFT JOIN l2 USING (region)""")
def hierarchical_fallback_lookup(t):
    n = t.nation
    rates = t.supplier.where("s_suppkey % 3 = 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("region"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 20).alias("city"),
        (F.col("s_suppkey") % 7).alias("tax"),
    ).distinct()
    people = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_regionkey").alias("region"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 20).alias("city")
    )
    return ranges.hierarchical_lookup(
        people, rates, levels=[["region", "nation", "city"], ["region", "nation"], ["region"]], value="tax", default=7.5
    ).select("c_custkey", "rate", "match_level")


@query("lookup_by_array_index", """
WITH fleet AS (SELECT dc, truck, row_number() OVER (PARTITION BY dc ORDER BY truck) - 1 AS slot, count(*) OVER (PARTITION BY dc) AS n
  FROM (SELECT DISTINCT s_nationkey AS dc, s_suppkey AS truck FROM supplier))
SELECT o.receipt_id, o.customer_id % 25 AS dc, f.truck FROM v_receipts o JOIN fleet f
  ON f.dc = o.customer_id % 25 AND f.slot = (date_diff('day', DATE '1990-01-01', o.event_date) + o.customer_id % 3) % f.n""")
def lookup_by_array_index(t):
    fleet = t.supplier.select(F.col("s_nationkey").cast("bigint").alias("dc"), F.col("s_suppkey").alias("truck"))
    rows = t.receipts.select("receipt_id", (F.col("customer_id") % 25).alias("dc"), "event_date", "customer_id")
    turn = F.datediff("event_date", F.lit("1990-01-01").cast("date")) + F.col("customer_id") % 3
    return ranges.slot_lookup(rows, fleet, key="dc", member="truck", turn=turn).select("receipt_id", "dc", "truck")
