"""Elasticity, promotion comparison, pricing and basket pairs on the fixture tables."""

from pyspark.sql import functions as F

from aisleworks.operators import gold, pricing, ranges
from aisleworks.plans.registry import query
from aisleworks.session import written

OLS_SQL = """
daily0 AS (SELECT product_id, event_date, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(unit_cents) AS DOUBLE) / count(*) / 100.0 AS price, sum(ext_cents) AS revenue FROM v_lines GROUP BY 1, 2),
chosen AS (SELECT product_id FROM daily0 GROUP BY 1 HAVING count(*) >= 20),
fit AS (SELECT product_id, count(*) AS n_observations, regr_sxx(ln(quantity), ln(price)) AS sxx, regr_sxy(ln(quantity), ln(price)) AS sxy, regr_syy(ln(quantity), ln(price)) AS syy, avg(price) AS avg_price, avg(quantity) AS avg_daily_quantity
  FROM daily0 JOIN chosen USING (product_id) WHERE quantity > 0 AND price > 0 GROUP BY 1),
ols AS (SELECT *, b - 1.96 * standard_error AS confidence_interval_lower, b + 1.96 * standard_error AS confidence_interval_upper FROM (
  SELECT *, sqrt(sse / (n_observations - 2) / sxx) AS standard_error FROM (
  SELECT *, sxy / sxx AS b, greatest(0.0, syy - sxy * sxy / sxx) AS sse, sxy * sxy / (sxx * syy) AS r_squared FROM fit)))"""


def fitted(t):
    return pricing.elasticity(pricing.product_days(t.lines, min_days=20), min_observations=30)


OLS_SELECT = """SELECT product_id, n_observations, round(sxx, 6) AS sxx, round(sse, 6) AS sse, round(b, 6) AS elasticity_coefficient, round(standard_error, 6) AS standard_error, round(r_squared, 6) AS r_squared,
  round(confidence_interval_lower, 6) AS confidence_interval_lower, round(confidence_interval_upper, 6) AS confidence_interval_upper, round(avg_price, 9) AS avg_price, round(avg_daily_quantity, 6) AS avg_daily_quantity,
  CASE WHEN b IS NULL THEN 'Insufficient Evidence' WHEN abs(b) > 1.5 THEN 'Highly Elastic' WHEN abs(b) > 1.0 THEN 'Elastic' WHEN abs(b) > 0.5 THEN 'Unit Elastic' ELSE 'Inelastic' END AS elasticity_category,
  CASE WHEN n_observations < 30 THEN 'INSUFFICIENT_SAMPLE' WHEN sxx <= 0 THEN 'INSUFFICIENT_PRICE_VARIATION' WHEN standard_error IS NULL THEN 'INVALID_STANDARD_ERROR' ELSE 'VALID_OBSERVATIONAL_ESTIMATE' END AS elasticity_evidence_status FROM ols"""


@query("ols_elasticity", f"WITH {OLS_SQL} {OLS_SELECT}")
def ols_elasticity(t):
    number = ["sxx", "sse", "elasticity_coefficient", "standard_error", "r_squared", "confidence_interval_lower", "confidence_interval_upper", "avg_price", "avg_daily_quantity"]
    return fitted(t).select("product_id", "n_observations", *[F.round(c, 9 if c == "avg_price" else 6).alias(c) for c in number], "elasticity_category", "elasticity_evidence_status")


@query("price_elasticity", f"WITH {OLS_SQL}, o AS ({OLS_SELECT}) SELECT o.product_id, product_name, category, elasticity_coefficient, elasticity_category, elasticity_evidence_status, n_observations FROM o JOIN v_products USING (product_id)")
def price_elasticity(t):
    named = fitted(t).join(t.products.select("product_id", "product_name", "category"), "product_id")
    return named.select("product_id", "product_name", "category", F.round("elasticity_coefficient", 6).alias("elasticity_coefficient"), "elasticity_category", "elasticity_evidence_status", "n_observations")


@query("evidence_status_counts", f"WITH {OLS_SQL}, o AS ({OLS_SELECT}) SELECT elasticity_evidence_status, elasticity_category, count(*) AS products FROM o GROUP BY 1, 2")
def evidence_status_counts(t):
    return fitted(t).groupBy("elasticity_evidence_status", "elasticity_category").agg(F.count(F.lit(1)).alias("products"))


LIFT_SQL = """
sales AS (SELECT store_id, p_brand AS product_id, event_date, receipt_id, quantity, ext_cents, promo_code,
  CASE WHEN promo_code IS NOT NULL THEN CAST(substr(promo_code, 4) AS DOUBLE) END AS discount_pct FROM v_lines JOIN part ON product_id = p_partkey WHERE line_type = 'SALE'),
bounds AS (SELECT store_id, min(event_date) AS first_date, max(event_date) AS last_date FROM sales GROUP BY 1),
days AS (SELECT DISTINCT store_id, promo_code, event_date FROM sales WHERE promo_code IS NOT NULL),
runs AS (SELECT *, sum(s) OVER (PARTITION BY store_id, promo_code ORDER BY event_date) AS episode FROM (
  SELECT *, CASE WHEN coalesce(event_date - lag(event_date) OVER (PARTITION BY store_id, promo_code ORDER BY event_date) > 7, true) THEN 1 ELSE 0 END AS s FROM days)),
episodes AS (SELECT store_id, promo_code, CAST(episode AS BIGINT) AS episode, min(event_date) AS start_date, max(event_date) AS end_date FROM runs GROUP BY 1, 2, 3),
kept AS (SELECT e.* FROM episodes e JOIN bounds b USING (store_id) WHERE start_date - 30 >= first_date AND end_date + 30 <= last_date),
promoted AS (SELECT s.*, k.episode, k.start_date, k.end_date FROM sales s JOIN kept k USING (store_id, promo_code) WHERE event_date BETWEEN start_date AND end_date),
found AS (SELECT store_id, promo_code, episode, product_id, start_date, end_date, count(DISTINCT receipt_id) AS promoted_receipts, count(*) AS promoted_lines, sum(discount_pct) / count(discount_pct) AS avg_discount_pct FROM promoted GROUP BY 1, 2, 3, 4, 5, 6),
daily AS (SELECT store_id, product_id, event_date, sum(quantity) AS quantity, sum(ext_cents) AS ext_cents FROM sales GROUP BY 1, 2, 3),
dailyp AS (SELECT store_id, promo_code, episode, product_id, event_date, sum(quantity) AS quantity, sum(ext_cents) AS ext_cents FROM promoted GROUP BY 1, 2, 3, 4, 5),
skip AS (SELECT DISTINCT store_id, product_id, event_date FROM sales WHERE promo_code IS NOT NULL),
cal_b AS (SELECT store_id, promo_code, episode, product_id, CAST(unnest(generate_series(CAST(start_date - 30 AS TIMESTAMP), CAST(start_date - 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS event_date FROM found),
cal_p AS (SELECT store_id, promo_code, episode, product_id, CAST(unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS event_date FROM found),
cal_a AS (SELECT store_id, promo_code, episode, product_id, CAST(unnest(generate_series(CAST(end_date + 1 AS TIMESTAMP), CAST(end_date + 30 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS event_date FROM found),
b AS (SELECT c.store_id, promo_code, episode, c.product_id, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS baseline_quantity, count(*) AS baseline_days FROM cal_b c ANTI JOIN skip k USING (store_id, product_id, event_date) LEFT JOIN daily d USING (store_id, product_id, event_date) GROUP BY 1, 2, 3, 4),
p AS (SELECT store_id, promo_code, episode, product_id, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS promo_quantity, CAST(coalesce(sum(ext_cents), 0) AS BIGINT) AS promo_cents, count(*) AS promo_days FROM cal_p LEFT JOIN dailyp USING (store_id, promo_code, episode, product_id, event_date) GROUP BY 1, 2, 3, 4),
a AS (SELECT c.store_id, promo_code, episode, c.product_id, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS post_quantity, count(*) AS post_days FROM cal_a c ANTI JOIN skip k USING (store_id, product_id, event_date) LEFT JOIN daily d USING (store_id, product_id, event_date) GROUP BY 1, 2, 3, 4),
m AS (SELECT f.*, promo_quantity, promo_cents, promo_days, coalesce(baseline_quantity, 0) AS baseline_quantity, coalesce(baseline_days, 0) AS baseline_days, coalesce(post_quantity, 0) AS post_quantity, coalesce(post_days, 0) AS post_days,
  coalesce(CAST(baseline_quantity AS DOUBLE) / nullif(baseline_days, 0), 0.0) AS bq, coalesce(CAST(promo_quantity AS DOUBLE) / nullif(promo_days, 0), 0.0) AS pq, coalesce(CAST(post_quantity AS DOUBLE) / nullif(post_days, 0), 0.0) AS aq
  FROM found f LEFT JOIN p USING (store_id, promo_code, episode, product_id) LEFT JOIN b USING (store_id, promo_code, episode, product_id) LEFT JOIN a USING (store_id, promo_code, episode, product_id)),
lift AS (SELECT *, CASE WHEN bq > 0 THEN (pq - bq) / bq * 100 END AS l, CASE WHEN bq > 0 THEN (aq - bq) / bq * 100 END AS pl FROM m)"""


def lift_inputs(t, *measures):
    """Sale lines by brand, joined once and written, and their promoted lines with episodes."""
    brand = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))
    pct = F.substring("promo_code", 4, 2)
    sales = t.lines.where("line_type = 'SALE'").join(brand, "product_id").select(
        "store_id", F.col("brand").alias("product_id"), "event_date", "receipt_id", *measures, "promo_code",
    )
    sales = written(sales, "lift-sales").withColumn("discount_pct", pct.cast("double"))
    return sales, pricing.promoted_lines(sales, gap_days=7, window_days=30)


@query("promotion_lift", f"""WITH {LIFT_SQL}
SELECT store_id, promo_code, episode, product_id, start_date, end_date, promoted_receipts, promoted_lines, round(avg_discount_pct, 6) AS avg_discount_pct, baseline_days, promo_days, post_days, promo_quantity, promo_cents,
  round(bq, 6) AS baseline_daily_quantity, round(pq, 6) AS promo_daily_quantity, round(aq, 6) AS post_daily_quantity, round(l, 6) AS observed_promo_lift_pct, round(pl, 6) AS observed_post_period_change_pct, round(l + pl, 6) AS observed_net_change_pct,
  CASE WHEN l > 50 THEN 'MUCH_HIGHER_DURING_PROMOTION' WHEN l > 20 THEN 'HIGHER_DURING_PROMOTION' WHEN l > 0 THEN 'SLIGHTLY_HIGHER_DURING_PROMOTION' ELSE 'NOT_HIGHER_DURING_PROMOTION' END AS observed_lift_category FROM lift""")
def promotion_lift(t):
    sales, promoted = lift_inputs(t, "quantity", "ext_cents")
    numbers = ["avg_discount_pct", "baseline_daily_quantity", "promo_daily_quantity", "post_daily_quantity", "observed_promo_lift_pct", "observed_post_period_change_pct", "observed_net_change_pct"]
    return pricing.promotion_lift(sales, promoted, window_days=30).select(
        "store_id", "promo_code", "episode", "product_id", "start_date", "end_date", "promoted_receipts", "promoted_lines", "baseline_days", "promo_days", "post_days",
        "promo_quantity", "promo_cents", *[F.round(c, 6).alias(c) for c in numbers], "observed_lift_category",
    )


@query("calendar_window_sales", f"WITH {LIFT_SQL} SELECT store_id, promo_code, episode, product_id, baseline_quantity, baseline_days FROM m WHERE baseline_days > 0")
def calendar_window_sales(t):
    return pricing.baseline_sales(*lift_inputs(t, "quantity"), window_days=30)


PRICE_SQL = f"""WITH {OLS_SQL}, newest AS (SELECT max(event_date) AS d FROM v_lines),
stock AS (SELECT product_id, CAST(sum(CASE WHEN line_type = 'SALE' THEN -quantity ELSE quantity END) + 900 AS BIGINT) AS total_inventory, date_diff('day', max(event_date), (SELECT d FROM newest)) AS age,
  CAST(coalesce(sum(quantity) FILTER (WHERE line_type = 'SALE' AND date_diff('day', event_date, (SELECT d FROM newest)) < 90), 0) AS DOUBLE) / 90 AS velocity FROM v_lines GROUP BY 1),
i AS (SELECT p.product_id, cost_cents / 100.0 AS cost, msrp_cents / 100.0 AS msrp, sale_cents / 100.0 AS sale_price, category AS tags, coalesce(total_inventory, 0) AS total_inventory, age, coalesce(velocity, 0.0) AS velocity,
  b, n_observations AS n, confidence_interval_lower AS lo, confidence_interval_upper AS hi, standard_error AS se, CASE WHEN p.product_id % 3 <> 0 THEN (sale_cents * (90 + p.product_id % 20) // 100) / 100.0 END AS prev,
  CASE WHEN p.product_id % 3 <> 0 THEN (SELECT d FROM newest) - CAST(p.product_id % 15 AS INTEGER) END AS prev_date
  FROM v_products p LEFT JOIN stock USING (product_id) LEFT JOIN ols USING (product_id)),
r1 AS (SELECT *, CASE WHEN age >= 60 THEN 0.25::DOUBLE WHEN age >= 30 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS am, CASE WHEN total_inventory >= 100 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS sm,
  CASE WHEN lower(tags) LIKE '%promo%' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS cm, coalesce(b < -1.0 AND n >= 30 AND lo <= b AND hi >= b AND hi < -1.0 AND se >= 0, false) AS ev FROM i),
r2 AS (SELECT *, greatest(am, sm, cm) AS markdown_factor, sale_price * (1 - greatest(am, sm, cm)) AS rule_price, CASE WHEN ev THEN cost * (abs(b) / (abs(b) - 1.0)) END AS opt, CASE WHEN velocity > 0.1 THEN total_inventory / velocity ELSE 999.0 END AS doi FROM r1),
r3 AS (SELECT *, coalesce(opt * 0.6::DOUBLE + rule_price * (1 - 0.6::DOUBLE), rule_price) AS blended, greatest(CASE WHEN total_inventory >= 100 THEN total_inventory / 100.0::DOUBLE - 1.0 ELSE 0.0 END, CASE WHEN doi >= 14 THEN doi / 14.0::DOUBLE - 1.0 ELSE 0.0 END) AS pr FROM r2),
r4 AS (SELECT *, CASE WHEN pr > 0 THEN least(0.15::DOUBLE, 0.05::DOUBLE + 0.10::DOUBLE * least(1.0::DOUBLE, pr)) ELSE 0.0 END AS um FROM r3),
r5 AS (SELECT *, blended * (1 - um) AS raw, cost * (1 + 0.15::DOUBLE) AS lo_price, msrp * 1.0::DOUBLE AS cap FROM r4),
r6 AS (SELECT *, greatest(lo_price, least(raw, cap)) AS wanted, raw < lo_price AS hit_min_margin, raw > cap AS hit_max_price FROM r5),
r7 AS (SELECT *, coalesce(abs((wanted - prev) / nullif(prev, 0)) > 0.1::DOUBLE AND date_diff('day', prev_date, (SELECT d FROM newest)) < 7, false) AS violates_max_change FROM r6),
r8 AS (SELECT *, CASE WHEN violates_max_change THEN prev ELSE wanted END AS rec FROM r7)
SELECT product_id, round(rec, 4) AS recommended_price, round((rec - sale_price) / sale_price * 100, 4) AS change_pct, markdown_factor, total_inventory, round(doi, 4) AS days_of_inventory, hit_min_margin, hit_max_price, violates_max_change,
  CASE WHEN violates_max_change THEN prev_date WHEN abs(wanted - coalesce(prev, sale_price)) > 0.005 THEN (SELECT d FROM newest) ELSE prev_date END AS effective_change_date,
  CASE WHEN ev THEN 'ELASTICITY_ASSISTED_EXPERIMENTAL' ELSE 'RULE_BASED' END AS model_type,
  round(CASE WHEN ev THEN (rec * greatest(0.0, velocity * (1 + (pow(rec / sale_price, b) - 1.0))) - sale_price * velocity) * 30 END, 4) AS projected_revenue_impact_30d,
  coalesce(nullif(concat_ws(',', CASE WHEN am = 0.25 THEN 'AGE_AGGRESSIVE' END, CASE WHEN am = 0.1 THEN 'AGE_MODERATE' END, CASE WHEN sm > 0 THEN 'INVENTORY_HIGH' END, CASE WHEN cm > 0 THEN 'SEASONAL_CLEARANCE' END,
    CASE WHEN ev THEN 'ELASTICITY_ASSISTED_EXPERIMENTAL' END, CASE WHEN um > 0 THEN 'INVENTORY_URGENCY' END, CASE WHEN hit_min_margin THEN 'CONSTRAINT_MIN_MARGIN' END, CASE WHEN hit_max_price THEN 'CONSTRAINT_MAX_PRICE' END,
    CASE WHEN violates_max_change THEN 'CONSTRAINT_MAX_CHANGE' END), ''), 'NO_CHANGE') AS reason_codes FROM r8"""


@query("dynamic_pricing", PRICE_SQL)
def dynamic_pricing(t):
    as_of = t.lines.agg(F.max("event_date")).scalar()
    age = F.datediff(as_of, "event_date")
    sale = F.col("line_type") == "SALE"
    stock = t.lines.groupBy("product_id").agg(
        (F.sum(F.when(sale, -F.col("quantity")).otherwise(F.col("quantity"))) + 900).alias("total_inventory"),
        F.datediff(as_of, F.max("event_date")).alias("days_since_last_receipt"),
        (F.coalesce(F.sum(F.when(sale & (age < 90), F.col("quantity"))), F.lit(0)) / F.lit(90)).alias("avg_daily_sales"),
    )
    kept = F.col("product_id") % 3 != 0
    inputs = (
        t.products.select(
            "product_id", gold.dollars(F.col("cost_cents")).alias("cost"), gold.dollars(F.col("msrp_cents")).alias("msrp"),
            gold.dollars(F.col("sale_cents")).alias("sale_price"), F.col("category").alias("tags"),
            F.when(kept, gold.dollars(F.expr("sale_cents * (90 + product_id % 20) div 100"))).alias("previous_price"),
            F.when(kept, F.date_sub(as_of, (F.col("product_id") % 15).cast("int"))).alias("previous_change_date"),
        )
        .join(stock, "product_id", "left").fillna(0, ["total_inventory"]).fillna(0.0, ["avg_daily_sales"])
        .join(fitted(t), "product_id", "left")
    )
    rules = pricing.PricingRules(clearance_months=tuple(range(1, 13)), clearance_tags=("promo",))
    return pricing.recommend(inputs, rules, as_of=as_of).select(
        "product_id", F.round("recommended_price", 4).alias("recommended_price"), F.round("change_pct", 4).alias("change_pct"), "markdown_factor",
        "total_inventory", F.round("days_of_inventory", 4).alias("days_of_inventory"), "hit_min_margin", "hit_max_price", "violates_max_change",
        "effective_change_date", "model_type", F.round("projected_revenue_impact_30d", 4).alias("projected_revenue_impact_30d"), "reason_codes",
    )


PAIR_SQL = """
items AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
ok AS (SELECT basket FROM items GROUP BY 1 HAVING count(*) >= 2), it AS (SELECT items.* FROM items SEMI JOIN ok USING (basket)),
n AS (SELECT count(*) AS total FROM ok), s AS (SELECT item, count(*) AS c FROM it GROUP BY 1),
p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS pair_count FROM it a JOIN it b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2)
SELECT item_a, item_b, pair_count, sa.c AS count_a, sb.c AS count_b, CAST(pair_count AS DOUBLE) / total AS support, CAST(pair_count AS DOUBLE) / sa.c AS confidence, CAST(pair_count * total AS DOUBLE) / (sa.c * sb.c) AS lift
FROM p JOIN s sa ON sa.item = item_a JOIN s sb ON sb.item = item_b CROSS JOIN n"""


def brand_lines(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item"))


@query("basket_pairs", f"WITH {PAIR_SQL}")
def basket_pairs(t):
    return pricing.basket_pairs(brand_lines(t), "basket", "item")


@query("top_n_rules", f"WITH {PAIR_SQL} ORDER BY lift DESC, support DESC, item_a, item_b LIMIT 100")
def top_n_rules(t):
    return pricing.basket_pairs(brand_lines(t), "basket", "item", top=100)


@query("rfm_segments", """
WITH s AS (SELECT * FROM v_receipts WHERE payment_status <> 'DECLINED'),
r AS (SELECT customer_id, date_diff('day', CAST(max(event_ts) AS DATE), (SELECT CAST(max(event_ts) AS DATE) FROM s)) AS recency_days, count(DISTINCT receipt_id) AS frequency, CAST(sum(total_cents) AS BIGINT) AS monetary_cents FROM s GROUP BY 1),
q AS (SELECT quantile_cont(recency_days, 0.33) AS r33, quantile_cont(recency_days, 0.67) AS r67, quantile_cont(frequency, 0.33) AS f33, quantile_cont(frequency, 0.67) AS f67, quantile_cont(monetary_cents, 0.33) AS m33, quantile_cont(monetary_cents, 0.67) AS m67 FROM r),
x AS (SELECT r.*, CASE WHEN recency_days <= r33 THEN 3 WHEN recency_days <= r67 THEN 2 ELSE 1 END AS recency_score, CASE WHEN frequency >= f67 THEN 3 WHEN frequency >= f33 THEN 2 ELSE 1 END AS frequency_score,
  CASE WHEN monetary_cents >= m67 THEN 3 WHEN monetary_cents >= m33 THEN 2 ELSE 1 END AS monetary_score FROM r, q)
SELECT *, CASE WHEN recency_score = 3 AND frequency_score = 3 AND monetary_score = 3 THEN 'Champions' WHEN frequency_score = 3 AND monetary_score >= 2 THEN 'Loyal' WHEN recency_score = 3 AND frequency_score = 1 THEN 'New'
  WHEN recency_score = 1 AND frequency_score >= 2 THEN 'At Risk' WHEN recency_score = 1 AND frequency_score = 1 THEN 'Lost' ELSE 'Regular' END AS segment FROM x""")
def rfm_segments(t):
    rfm = gold.rfm(t.receipts.where("payment_status <> 'DECLINED'"), customer="customer_id", receipt="receipt_id", at="event_ts", cents="total_cents").select(
        "customer_id", "recency_days", "frequency", "monetary_cents"
    )
    cut = lambda column, p: ranges.exact_percentiles(rfm, [], column, {f"{p}33": 0.33, f"{p}67": 0.67}).drop("n")
    limits = {p: cut(c, p) for c, p in (("recency_days", "r"), ("frequency", "f"), ("monetary_cents", "m"))}
    row = limits["r"]
    for p in ("f", "m"):
        row = row.withColumns({f"{p}{q}": limits[p].select(f"{p}{q}").scalar() for q in ("33", "67")})
    return pricing.rfm_segments(rfm, row)
