"""Attribution and campaign performance on the fixture tables."""

from pyspark.sql import functions as F

from aisleworks.operators import attribution, gold
from aisleworks.plans.bound_c_joins import last_touch
from aisleworks.plans.registry import query

PERFORMANCE_TAIL = """
SELECT campaign_id, channel, day, impressions, spend_cents, coalesce(conversions, 0) AS conversions,
       coalesce(attributed_revenue_cents, 0) AS attributed_revenue_cents,
       coalesce(CAST(conversions AS DOUBLE) / impressions, 0.0) AS conversion_rate,
       coalesce(CAST(attributed_revenue_cents AS DOUBLE) / nullif(spend_cents, 0), 0.0) AS roas
FROM spend LEFT JOIN won USING (campaign_id, channel, day)"""


@query("campaign_performance_daily", """
WITH spend AS (SELECT campaign_id, channel, CAST(touch_ts AS DATE) AS day, count(DISTINCT impression_id) AS impressions, CAST(sum(cost_cents) AS BIGINT) AS spend_cents
  FROM v_touches GROUP BY 1, 2, 3),
won AS (SELECT campaign_id, channel, CAST(touch_ts AS DATE) AS day, count(DISTINCT purchase_id) AS conversions, CAST(sum(total_cents) AS BIGINT) AS attributed_revenue_cents
  FROM v_last_touch GROUP BY 1, 2, 3)""" + PERFORMANCE_TAIL)
def campaign_performance_daily(t):
    won = last_touch(t).where("touch_ts IS NOT NULL").withColumnsRenamed(
        {"purchase_id": "attribution_id", "total_cents": "attributed_revenue_cents"}
    )
    return gold.campaign_performance(t.touches, won, ["attributed_revenue_cents"])


def labelled(t):
    j = t.journeys
    p = j["purchases"]
    both = attribution.union_purchases(p.where("is_store").drop("is_store"), p.where("NOT is_store").drop("is_store"))
    return attribution.by_journey_labelled(both, j["touches"], j["payments"], j["promotions"])


@query("union_purchases", """
SELECT purchase_key, journey_id, purchase_type, CASE WHEN purchase_type = 'STORE' THEN purchase_key END AS receipt_id,
       CASE WHEN purchase_type = 'ONLINE' THEN purchase_key END AS order_id, purchase_ts, total_cents FROM v_journey_sold""")
def union_purchases(t):
    p = t.journeys["purchases"]
    return attribution.union_purchases(p.where("is_store"), p.where("NOT is_store")).select(
        "purchase_key", "journey_id", "purchase_type", "receipt_id", "order_id", "purchase_ts", "total_cents"
    )


GOLD_SQL = """
WITH hit AS (SELECT p.purchase_key, t.touch_ts, t.impression_id, t.campaign_id, t.channel
  FROM v_journey_sold p JOIN v_journey_touches t ON t.match_key = p.match_key AND t.touch_ts <= p.purchase_ts AND t.touch_ts >= p.purchase_ts - INTERVAL 7 DAY
  QUALIFY row_number() OVER (PARTITION BY p.purchase_key ORDER BY t.touch_ts DESC, t.impression_id DESC) = 1),
judged AS (SELECT p.*, y.payment_cents, h.* EXCLUDE (purchase_key), CASE
    WHEN payment_status <> 'APPROVED' THEN 'PAYMENT_DECLINED'
    WHEN payment_cents <> total_cents OR gross_cents - discount_cents <> subtotal_cents THEN 'RECONCILIATION_FAILED'
    WHEN h.touch_ts IS NULL THEN 'UNATTRIBUTED_NO_JOURNEY' ELSE 'ATTRIBUTED' END AS attribution_status
  FROM v_journey_sold p JOIN v_journey_payments y ON y.purchase_key = p.purchase_key LEFT JOIN hit h ON h.purchase_key = p.purchase_key)
SELECT 'ATTR-' || purchase_type || '-' || CAST(purchase_key AS VARCHAR) AS attribution_id,
       CASE WHEN ok THEN CAST(match_key AS VARCHAR) END AS journey_id, attribution_status, 'LAST_TOUCH_7D' AS attribution_model, 7 AS attribution_window_days,
       CASE WHEN ok THEN touch_ts END AS touch_ts, CASE WHEN ok THEN impression_id END AS impression_id,
       CASE WHEN ok THEN campaign_id END AS campaign_id, CASE WHEN ok THEN channel END AS channel, customer_id, purchase_ts,
       CASE WHEN ok THEN CAST(floor(epoch_us(purchase_ts) / 1000000) - floor(epoch_us(touch_ts) / 1000000) AS BIGINT) END AS lag_seconds, purchase_type, purchase_key,
       gross_cents, discount_cents, subtotal_cents, tax_cents, total_cents, payment_cents, CASE WHEN ok THEN subtotal_cents ELSE 0 END AS attributed_revenue_cents
FROM (SELECT *, attribution_status = 'ATTRIBUTED' AS ok FROM judged)"""


@query("marketing_attribution_gold", GOLD_SQL)
def marketing_attribution_gold(t):
    j = t.journeys
    p = j["purchases"].join(j["payments"].select("purchase_key", "payment_status", "payment_cents"), "purchase_key")
    both = attribution.union_purchases(p.where("is_store").drop("is_store"), p.where("NOT is_store").drop("is_store"))
    return attribution.by_customer(both, j["touches"])


@query("marketing_attribution_silver", """
WITH p AS (SELECT *, journey_id IS NOT NULL AND count(*) OVER (PARTITION BY journey_id) > 1 AS shared FROM v_journey_sold),
touch AS (SELECT * FROM v_journey_touches QUALIFY row_number() OVER (PARTITION BY journey_id ORDER BY touch_ts DESC, impression_id DESC) = 1),
pj AS (SELECT journey_id, sum(promo_cents) AS c FROM v_journey_promotions WHERE journey_id IS NOT NULL GROUP BY 1),
pp AS (SELECT purchase_key, sum(promo_cents) AS c FROM v_journey_promotions GROUP BY 1),
complete AS (SELECT p.*, y.payment_cents, t.touch_ts, t.impression_id, t.campaign_id, t.channel, 'ATTRIBUTED' AS attribution_status,
    CAST(floor(epoch_us(p.purchase_ts) / 1000000) - floor(epoch_us(t.touch_ts) / 1000000) AS BIGINT) AS lag_seconds
  FROM p JOIN touch t USING (journey_id) JOIN v_journey_payments y USING (purchase_key) LEFT JOIN pj ON pj.journey_id = p.journey_id
  WHERE NOT p.shared AND y.payment_status = 'APPROVED' AND y.payment_cents = p.total_cents AND coalesce(pj.c, 0) = p.discount_cents
    AND p.gross_cents - p.discount_cents = p.subtotal_cents AND p.customer_id = t.touch_customer_id
    AND floor(epoch_us(p.purchase_ts) / 1000000) - floor(epoch_us(t.touch_ts) / 1000000) BETWEEN 0 AND 604800),
loose AS (SELECT p.*, y.payment_cents, CAST(NULL AS TIMESTAMP) AS touch_ts, CAST(NULL AS BIGINT) AS impression_id, CAST(NULL AS VARCHAR) AS campaign_id,
    CAST(NULL AS VARCHAR) AS channel, CASE WHEN p.shared THEN 'UNATTRIBUTED_SHARED_JOURNEY' ELSE 'UNATTRIBUTED_NO_JOURNEY' END AS attribution_status, CAST(NULL AS BIGINT) AS lag_seconds
  FROM p JOIN v_journey_payments y USING (purchase_key) LEFT JOIN pp ON pp.purchase_key = p.purchase_key
  WHERE (p.journey_id IS NULL OR p.shared) AND y.payment_status = 'APPROVED' AND y.payment_cents = p.total_cents AND coalesce(pp.c, 0) = p.discount_cents
    AND p.gross_cents - p.discount_cents = p.subtotal_cents)
SELECT 'ATTR-' || purchase_type || '-' || CAST(purchase_key AS VARCHAR) AS attribution_id, journey_id, attribution_status, 'LAST_TOUCH_7D' AS attribution_model,
       7 AS attribution_window_days, touch_ts, impression_id, campaign_id, channel, customer_id, purchase_ts, lag_seconds, purchase_type, purchase_key,
       gross_cents, discount_cents, subtotal_cents, tax_cents, total_cents, payment_cents,
       CASE WHEN attribution_status = 'ATTRIBUTED' THEN subtotal_cents ELSE 0 END AS attributed_revenue_cents
FROM (SELECT * FROM complete UNION ALL BY NAME SELECT * FROM loose)""")
def marketing_attribution_silver(t):
    j = t.journeys
    p = j["purchases"].withColumn("purchase_type", F.when(F.col("is_store"), "STORE").otherwise("ONLINE")).drop("is_store")
    return attribution.by_journey_strict(p, j["touches"], j["payments"], j["promotions"], report_shared=True)


@query("fn_marketing_attribution", "SELECT * FROM v_labelled")
def fn_marketing_attribution(t):
    return labelled(t)


@query("fn_attribution_window", "SELECT * FROM v_labelled WHERE campaign_id = 'CAMP3' AND lag_seconds <= 12 * 3600")
def fn_attribution_window(t):
    return attribution.in_window(labelled(t), "CAMP3", 12)


@query("attribution_reconciliation", """
SELECT attribution_id, attribution_status, purchase_ts, campaign_id, gross_cents - discount_cents - subtotal_cents AS gross_discount_net_delta,
       subtotal_cents + tax_cents - total_cents AS net_tax_total_delta, payment_cents - total_cents AS payment_total_delta FROM v_labelled
WHERE purchase_ts > (SELECT max(ts) FROM events) - INTERVAL 240 HOUR""")
def attribution_reconciliation(t):
    newest = t.events.agg(F.max("ts")).scalar()
    return attribution.reconciliation(gold.trailing_filter(labelled(t), "purchase_ts", newest, 240))


@query("attribution_status_counts", "SELECT attribution_status, count(*) AS purchases, CAST(sum(attributed_revenue_cents) AS BIGINT) AS revenue_cents FROM v_labelled GROUP BY 1")
def attribution_status_counts(t):
    return labelled(t).groupBy("attribution_status").agg(
        F.count(F.lit(1)).alias("purchases"), F.sum("attributed_revenue_cents").alias("revenue_cents")
    )


def fn_campaign_sql(hours):
    return f"""
WITH lim AS (SELECT max(ts) - INTERVAL {hours} HOUR AS since FROM events),
att AS (SELECT * FROM v_labelled WHERE attribution_status = 'ATTRIBUTED' AND purchase_ts > (SELECT since FROM lim)),
spend AS (SELECT campaign_id, channel, CAST(touch_ts AS DATE) AS day, count(DISTINCT impression_id) AS impressions, CAST(sum(cost_cents) AS BIGINT) AS spend_cents
  FROM v_journey_touches WHERE touch_ts > (SELECT since FROM lim) OR impression_id IN (SELECT impression_id FROM att) GROUP BY 1, 2, 3),
won AS (SELECT campaign_id, channel, CAST(touch_ts AS DATE) AS day, count(DISTINCT attribution_id) AS conversions,
  CAST(sum(attributed_revenue_cents) AS BIGINT) AS attributed_revenue_cents FROM att GROUP BY 1, 2, 3)"""


def campaign_lookback(t, hours):
    newest = t.events.agg(F.max("ts")).scalar()
    won = gold.trailing_filter(labelled(t).where("attribution_status = 'ATTRIBUTED'"), "purchase_ts", newest, hours)
    seen = attribution.touches_in_lookback(t.journeys["touches"], won, newest, hours)
    return gold.campaign_performance(seen, won, ["attributed_revenue_cents"])


@query("fn_campaign_performance", fn_campaign_sql(168) + PERFORMANCE_TAIL)
def fn_campaign_performance(t):
    return campaign_lookback(t, 168)


@query("campaign_funnel", fn_campaign_sql(168) + f""", perf AS ({PERFORMANCE_TAIL}), sums AS (SELECT campaign_id, CAST(sum(impressions) AS BIGINT) AS impressions,
  CAST(sum(conversions) AS BIGINT) AS conversions, CAST(sum(spend_cents) AS BIGINT) AS spend_cents, CAST(sum(attributed_revenue_cents) AS BIGINT) AS attributed_revenue_cents
  FROM perf GROUP BY 1)
SELECT *, CAST(conversions AS DOUBLE) / impressions AS conversion_rate, coalesce(CAST(attributed_revenue_cents AS DOUBLE) / nullif(spend_cents, 0), 0.0) AS roas FROM sums""")
def campaign_funnel(t):
    sums = campaign_lookback(t, 168).groupBy("campaign_id").agg(
        *[F.sum(c).alias(c) for c in ("impressions", "conversions", "spend_cents", "attributed_revenue_cents")]
    )
    return gold.with_campaign_rates(sums)


@query("marketing_cost_24h", fn_campaign_sql(24) + f""", perf AS ({PERFORMANCE_TAIL})
SELECT campaign_id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(spend_cents) AS BIGINT) AS spend_cents,
       CAST(sum(spend_cents) AS DOUBLE) / 100.0 AS cost FROM perf GROUP BY 1""")
def marketing_cost_24h(t):
    return campaign_lookback(t, 24).groupBy("campaign_id").agg(
        F.sum("impressions").alias("impressions"), F.sum("spend_cents").alias("spend_cents"),
        gold.dollars(F.sum("spend_cents")).alias("cost"),
    )
