"""Data-quality checks, scalar functions and evaluation on the fixture tables."""

from pyspark.sql import functions as F

from aisleworks.functions import scalars
from aisleworks.operators import evaluation, quality
from aisleworks.plans.registry import query


def checks_sql(source, checks):
    """SELECT per check, over one source."""
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", count(*) FILTER (WHERE {cond}) AS violations FROM {source}" for name, cond in checks.items())


@query("dq_unique_keys", """
SELECT 'receipts' AS "check", count(*) AS violations FROM (SELECT receipt_id FROM v_receipts GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lines', count(*) FROM (SELECT receipt_id, line_num FROM v_lines GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'events', count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1)""")
def dq_unique_keys(t):
    return quality.report(
        quality.unique_check(t.receipts, ["receipt_id"], "receipts"), quality.unique_check(t.lines, ["receipt_id", "line_num"], "lines"),
        quality.unique_check(t.events, ["event_id"], "events"),
    )


FK_SQL = """
SELECT 'lines -> receipts' AS "check", count(*) AS violations FROM v_lines WHERE receipt_id NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'receipts -> lines', count(*) FROM v_receipts WHERE receipt_id NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'lines -> products', count(*) FROM v_lines WHERE product_id NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'lines -> stores', count(*) FROM v_lines WHERE store_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'receipts -> buyers seen online', count(*) FROM v_receipts WHERE customer_id NOT IN (SELECT user_id FROM events)"""


def fk_matrix(t):
    return quality.report(
        quality.fk_check(t.lines, "receipt_id", t.orders, "o_orderkey", "lines -> receipts"),
        quality.fk_check(t.receipts, "receipt_id", t.lineitem, "l_orderkey", "receipts -> lines"),
        quality.fk_check(t.lines, "product_id", t.part, "p_partkey", "lines -> products"),
        quality.fk_check(t.lines, "store_id", t.supplier, "s_suppkey", "lines -> stores"),
        quality.fk_check(t.receipts, "customer_id", t.events, "user_id", "receipts -> buyers seen online"),
    )


@query("dq_fk_matrix", FK_SQL)
def dq_fk_matrix(t):
    return fk_matrix(t)


@query("dq_xor_keys", """
SELECT event_id, CASE WHEN k % 3 <> 0 THEN event_id END AS receipt_id, CASE WHEN k % 4 = 0 THEN event_id END AS order_id FROM v_events WHERE (k % 3 <> 0) = (k % 4 = 0)""")
def dq_xor_keys(t):
    """Payments must name a receipt or an order, never both and never none."""
    pay = t.keyed_events.select(
        "event_id", F.when(F.col("k") % 3 != 0, F.col("event_id")).alias("receipt_id"), F.when(F.col("k") % 4 == 0, F.col("event_id")).alias("order_id")
    )
    return pay.where(F.col("receipt_id").isNotNull() == F.col("order_id").isNotNull())


HOLES_SQL = """(SELECT CASE WHEN k > 4 THEN user_id END AS user_id, CASE WHEN k % 9 = 0 THEN '  ' ELSE event_type END AS label,
  CASE WHEN k % 10 = 1 THEN 'NaN'::DOUBLE WHEN k % 10 = 2 THEN 'Infinity'::DOUBLE ELSE value END AS score, (k - 5) / 90.0::DOUBLE AS p FROM v_events)"""


def holes(t):
    k = F.col("k")
    return t.keyed_events.select(
        F.when(k > 4, F.col("user_id")).alias("user_id"), F.when(k % 9 == 0, "  ").otherwise(F.col("event_type")).alias("label"),
        F.when(k % 10 == 1, float("nan")).when(k % 10 == 2, float("inf")).otherwise(F.col("value")).alias("score"), ((k - 5) / 90.0).alias("p"),
    )


@query("dq_not_null", checks_sql(HOLES_SQL, {"user_id is null": "user_id IS NULL", "label is null": "label IS NULL"}))
def dq_not_null(t):
    return quality.row_checks(holes(t), quality.not_null_checks(holes(t), ["user_id", "label"]))


@query("dq_blank", checks_sql(HOLES_SQL, {"label is blank": "trim(label) = ''"}))
def dq_blank(t):
    return quality.row_checks(holes(t), quality.blank_checks(holes(t), ["label"]))


@query("dq_non_finite", checks_sql(HOLES_SQL, {"score is not finite": "NOT isfinite(score)"}))
def dq_non_finite(t):
    return quality.row_checks(holes(t), quality.finite_checks(holes(t), ["score"]))


@query("dq_probability_range", checks_sql(HOLES_SQL, {"p outside 0..1": "p IS NULL OR p < 0 OR p > 1"}))
def dq_probability_range(t):
    return quality.row_checks(holes(t), quality.unit_interval_checks(["p"]))


MONEY = {
    "gross - discount = net": "gross_cents - discount_cents <> subtotal_cents", "net + tax = total": "subtotal_cents + tax_cents <> total_cents",
    "paid = total": "payment_cents <> total_cents", "promotions = discount": "coalesce(promo_cents, 0) <> discount_cents",
}


@query("dq_money_identities", checks_sql(
    "(SELECT s.*, payment_cents, promo_cents FROM v_journey_sold s JOIN v_journey_payments p ON p.purchase_key = s.purchase_key LEFT JOIN v_journey_promotions o ON o.purchase_key = s.purchase_key)", MONEY))
def dq_money_identities(t):
    j = t.journeys
    promo = j["promotions"].groupBy("purchase_key").agg(F.sum("promo_cents").alias("promo_cents"))
    sold = j["purchases"].join(j["payments"].select("purchase_key", "payment_cents"), "purchase_key").join(promo, "purchase_key", "left")
    return quality.row_checks(sold, {name: F.expr(cond) for name, cond in MONEY.items()})


@query("dq_temporal", """
SELECT 'departed before arrived' AS "check", count(*) AS violations FROM v_shipments WHERE departed < arrived
UNION ALL SELECT 'outside opening hours', count(*) FROM events WHERE hour(ts) < 6 OR hour(ts) >= 22
UNION ALL SELECT 'shipped before ordered', count(*) FROM v_lines l JOIN v_receipts r USING (receipt_id) WHERE l.event_ts < r.event_ts
UNION ALL SELECT 'touch outside window', count(*) FROM v_labelled WHERE lag_seconds < 0 OR lag_seconds > 604800""")
def dq_temporal(t):
    from aisleworks.plans.bound_d_attribution import labelled

    late = t.lines.select("receipt_id", F.col("event_ts").alias("line_ts")).join(t.receipts.select("receipt_id", F.col("event_ts").alias("order_ts")), "receipt_id")
    return quality.report(
        quality.row_checks(t.shipments, {"departed before arrived": F.col("departed") < F.col("arrived")}),
        quality.row_checks(t.events, {"outside opening hours": (F.hour("ts") < 6) | (F.hour("ts") >= 22)}),
        quality.row_checks(late, {"shipped before ordered": F.col("line_ts") < F.col("order_ts")}),
        quality.row_checks(labelled(t), {"touch outside window": ~F.col("lag_seconds").between(0, 604800)}),
    )


@query("dq_pricing_order", "SELECT product_id, cost_cents, sale_cents, msrp_cents FROM v_products WHERE NOT (cost_cents < sale_cents - product_id % 7 * 6000 AND sale_cents - product_id % 7 * 6000 <= msrp_cents - product_id % 90)")
def dq_pricing_order(t):
    sale, top = F.col("sale_cents") - F.col("product_id") % 7 * 6000, F.col("msrp_cents") - F.col("product_id") % 90
    return t.products.where(~((F.col("cost_cents") < sale) & (sale <= top))).select("product_id", "cost_cents", "sale_cents", "msrp_cents")


FORECAST_SQL = """(SELECT store_id, product_id, CAST(quantity AS DOUBLE) - 2 AS predicted_units, CAST(quantity AS DOUBLE) * 0.5 AS lower_bound, CAST(quantity AS DOUBLE) * 1.5 - line_num * 2 AS upper_bound, 0.1 * (line_num - 1) AS mape,
  14 AS horizon, event_date + line_num AS forecast_date, event_date AS source_as_of FROM v_lines)"""


@query("validate_forecast", checks_sql(FORECAST_SQL, {
    "negative units": "predicted_units < 0 OR lower_bound < 0", "bounds out of order": "upper_bound < lower_bound OR predicted_units < lower_bound OR predicted_units > upper_bound",
    "negative error": "mape < 0", "no horizon": "horizon <= 0", "outside horizon": "forecast_date - source_as_of < 1 OR forecast_date - source_as_of > horizon", "source after generation": "false"}) + f"""
UNION ALL SELECT 'incomplete horizon', count(*) FROM (SELECT store_id, product_id FROM {FORECAST_SQL} GROUP BY 1, 2 HAVING count(DISTINCT forecast_date) <> 14 OR min(forecast_date - source_as_of) <> 1 OR max(forecast_date - source_as_of) <> 14)""")
def validate_forecast(t):
    q = F.col("quantity").cast("double")
    df = t.lines.select(
        "store_id", "product_id", (q - 2).alias("predicted_units"), (q * 0.5).alias("lower_bound"), (q * 1.5 - F.col("line_num") * 2).alias("upper_bound"),
        (F.lit(0.1) * (F.col("line_num") - 1)).alias("mape"), F.lit(14).alias("forecast_horizon_days"), F.date_add("event_date", F.col("line_num")).alias("forecast_date"),
        F.col("event_ts").alias("source_as_of"), F.col("event_ts").alias("generated_at"),
    )
    return quality.forecast_checks(df, ["store_id", "product_id"])


SEGMENT_SQL = """(SELECT customer_id % 5 - 1 AS cluster_id, customer_id % 50 - 1 AS recency_days, customer_id % 10 AS frequency, total_cents - 500000 AS monetary_value, total_cents AS avg_order_value,
  event_ts AS a, event_ts - to_days(CAST(customer_id % 3 AS INTEGER) - 1) AS b FROM v_receipts)"""


@query("validate_segments", checks_sql(SEGMENT_SQL, {
    "negative cluster": "cluster_id < 0", "negative recency": "recency_days < 0", "no purchases": "frequency <= 0", "no value": "monetary_value <= 0 OR avg_order_value <= 0",
    "dates out of order": "a > b", "segmented after generation": "a > b"}))
def validate_segments(t):
    c = F.col("customer_id")
    later = F.col("event_ts") - F.make_dt_interval((c % 3).cast("int") - 1)
    df = t.receipts.select(
        (c % 5 - 1).alias("cluster_id"), (c % 50 - 1).alias("recency_days"), (c % 10).alias("frequency"), (F.col("total_cents") - 500000).alias("monetary_value"),
        F.col("total_cents").alias("avg_order_value"), F.col("event_ts").alias("first_purchase_date"), later.alias("last_purchase_date"),
        F.col("event_ts").alias("segmented_at"), later.alias("generated_at"),
    )
    return quality.segment_checks(df)


SCORE_SQL = """(SELECT k % 3 AS cls, CASE WHEN k % 20 = 0 THEN 1 END AS actual, k - 3 AS win, (k - 2) / 95.0::DOUBLE AS p, k - 10 AS inv, k - 1 AS vel, ts AS a, ts + to_days(CAST(k % 4 AS INTEGER) - 1) AS b FROM v_events)"""


def scored(t):
    k = F.col("k")
    return t.keyed_events.select(
        (k % 3).alias("cls"), F.when(k % 20 == 0, 1).alias("actual"), (k - 3).alias("win"), ((k - 2) / 95.0).alias("p"), (k - 10).alias("inv"), (k - 1).alias("vel"),
        F.col("ts").alias("a"), (F.col("ts") + F.make_dt_interval((k % 4).cast("int") - 1)).alias("b"),
    )


@query("validate_churn", checks_sql(SCORE_SQL, {
    "class not 0 or 1": "cls NOT IN (0, 1)", "actual label present": "actual IS NOT NULL", "no window": "win <= 0", "predicted after generation": "a > b",
    "churn_probability outside 0..1": "p IS NULL OR p < 0 OR p > 1"}))
def validate_churn(t):
    return quality.churn_checks(scored(t).withColumnsRenamed({
        "cls": "churn_prediction", "actual": "is_churned_actual", "win": "churn_window_days", "p": "churn_probability", "a": "prediction_date", "b": "generated_at"}))


@query("validate_stockout", checks_sql(SCORE_SQL, {
    "class not 0 or 1": "cls NOT IN (0, 1)", "negative inventory": "inv < 0", "negative demand": "vel < 0", "negative days": "win < 0", "no rank": "vel <= 0",
    "inventory after prediction": "a > b", "stockout_probability outside 0..1": "p IS NULL OR p < 0 OR p > 1"}))
def validate_stockout(t):
    df = scored(t).withColumn("ranking", F.col("vel")).withColumnsRenamed({
        "cls": "stockout_predicted", "inv": "current_inventory", "vel": "demand_velocity_daily", "win": "days_of_inventory", "p": "stockout_probability", "a": "inventory_as_of", "b": "predicted_at"})
    return quality.stockout_checks(df)


@query("dq_event_contract", """
SELECT event_id, CASE WHEN k % 17 = 0 THEN 'MALFORMED' WHEN k % 13 = 0 THEN 'MALFORMED' WHEN event_type = 'signup' THEN 'UNKNOWN_EVENT' WHEN k % 7 = 0 THEN 'NULL_KEY' WHEN k % 10 = 0 THEN 'NOT_UTC' ELSE 'OK' END AS verdict FROM v_events""")
def dq_event_contract(t):
    k = F.col("k")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 10 == 0, "+02:00").otherwise("Z"))
    whole = F.format_string(
        '{"event_type":"%s","trace_id":"T%d","ingest_timestamp":"%s","payload":{"order_id":%s,"amount":%s}}',
        "event_type", "event_id", stamp, F.when(k % 7 == 0, "null").otherwise(F.col("event_id").cast("string")), F.when(k % 13 == 0, '"many"').otherwise(k.cast("string")),
    )
    body = F.when(k % 17 == 0, F.substring(whole, 1, 40)).otherwise(whole)
    raw = t.keyed_events.select("event_id", body.alias("body"))
    return quality.event_contract(raw, "body", payload="order_id bigint, amount bigint", known=["view", "click", "purchase", "error"], key="order_id").select("event_id", "verdict")


@query("dq_report", FK_SQL + " UNION ALL " + checks_sql(HOLES_SQL, {"user_id is null": "user_id IS NULL", "label is blank": "trim(label) = ''", "p outside 0..1": "p IS NULL OR p < 0 OR p > 1"}))
def dq_report(t):
    df = holes(t)
    rows = quality.row_checks(df, {**quality.not_null_checks(df, ["user_id"]), **quality.blank_checks(df, ["label"]), **quality.unit_interval_checks(["p"])})
    return quality.report(fk_matrix(t), rows)


@query("validate_output", "SELECT customer_id, receipt_id, total_cents FROM v_receipts")
def validate_output(t):
    contract = [("customer_id", "bigint", False), ("receipt_id", "bigint", False), ("total_cents", "bigint", True)]
    return quality.validate_output(t.receipts.select("receipt_id", "customer_id", "total_cents"), contract)


# --- scalar functions ---


@query("fn_string_ids", """
SELECT event_id, 'TRK' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS truck_code, CAST(regexp_extract('TRK' || lpad(CAST(user_id AS VARCHAR), 6, '0'), '(\\d+)$', 1) AS BIGINT) AS truck_number,
  upper(event_type) AS kind, substr(event_type, 1, 3) AS prefix, contains(event_type, 'i') AS has_i, regexp_matches(event_type, '^(view|click)$') AS is_touch, event_type || '-' || CAST(k AS VARCHAR) AS label, split_part(event_type || '-' || CAST(k AS VARCHAR), '-', 2) AS tail FROM v_events""")
def fn_string_ids(t):
    code = F.concat(F.lit("TRK"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    label = F.concat_ws("-", "event_type", F.col("k").cast("string"))
    return t.keyed_events.select(
        "event_id", code.alias("truck_code"), F.regexp_extract(code, r"(\d+)$", 1).cast("bigint").alias("truck_number"), F.upper("event_type").alias("kind"),
        F.substring("event_type", 1, 3).alias("prefix"), F.col("event_type").contains("i").alias("has_i"), F.col("event_type").rlike("^(view|click)$").alias("is_touch"),
        label.alias("label"), F.split(label, "-")[1].alias("tail"),
    )


@query("fn_date_parts", """
SELECT event_id, date_trunc('hour', ts) AS hour_ts, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, CAST(weekofyear(ts) AS INTEGER) AS iso_week,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day_number, CAST(ts AS DATE) + 7 AS next_week, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch_second FROM events""")
def fn_date_parts(t):
    return t.events.select(
        "event_id", F.date_trunc("hour", "ts").alias("hour_ts"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.dayofweek("ts").alias("day_of_week"),
        F.weekofyear("ts").alias("iso_week"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day_number"), F.date_add("ts", 7).alias("next_week"), F.unix_seconds("ts").alias("epoch_second"),
    )


@query("fn_money_cents", "SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents, printf('%.2f', CAST(round(value * 100) AS BIGINT) / 100.0) AS amount FROM events")
def fn_money_cents(t):
    from aisleworks.operators.silver import as_text

    c = F.round(F.col("value") * 100).cast("bigint")
    return t.events.select("event_id", c.alias("cents"), as_text(c).alias("amount"))


def md5_number(text: str) -> str:
    """40 bits of the MD5 of a text, as DuckDB states them."""
    return f"('0x' || substr(md5({text}), 1, 10))::BIGINT"


def md5_draw(text: str) -> str:
    return f"(CAST({md5_number(text)} AS DOUBLE) / 1099511627776.0::DOUBLE)"


SEED_TEXT = "CAST(event_id AS VARCHAR) || '|7"


@query("fn_seeded_draws", f"""
SELECT event_id, {md5_number(SEED_TEXT + "|pick'")} AS h, {md5_draw(SEED_TEXT + "|u'")} AS u,
  round(sqrt(-2 * ln(1 - {md5_draw(SEED_TEXT + "|g|radius'")})) * cos(2 * pi() * {md5_draw(SEED_TEXT + "|g|angle'")}), 6) AS g FROM events""")
def fn_seeded_draws(t):
    def seeded(name):
        return F.concat(F.col("event_id").cast("string"), F.lit(f"|7|{name}"))

    return t.events.select(
        "event_id", scalars.portable_number(seeded("pick")).alias("h"), scalars.portable_uniform(seeded("u")).alias("u"),
        F.round(scalars.portable_normal(seeded("g")), 6).alias("g"),
    )


DRAW_SQL = "CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR) || '|ab'), 1, 10))::BIGINT AS DOUBLE) / 1099511627776.0::DOUBLE"


@query("fn_weighted_pick", f"""
WITH d AS (SELECT DISTINCT user_id, {DRAW_SQL} AS u FROM events) SELECT user_id, u, CASE WHEN u * 100 < 50 THEN 'control' WHEN u * 100 < 80 THEN 'variant_a' ELSE 'variant_b' END AS bucket FROM d""")
def fn_weighted_pick(t):
    """Stable test-group assignment per user."""
    users = t.events.select("user_id").distinct().withColumn("u", scalars.portable_uniform(F.concat(F.col("user_id").cast("string"), F.lit("|ab"))))
    return users.withColumn("bucket", scalars.weighted_pick(F.col("u"), [("control", 50), ("variant_a", 30), ("variant_b", 20)]))


@query("fn_inverse_cdf_pick", f"SELECT DISTINCT user_id, CAST(least((u >= 0.1)::INT + (u >= 0.35)::INT + (u >= 0.8)::INT + (u >= 1.0)::INT, 3) AS INTEGER) AS pick FROM (SELECT user_id, {DRAW_SQL} AS u FROM events)")
def fn_inverse_cdf_pick(t):
    users = t.events.select("user_id").distinct().withColumn("u", scalars.portable_uniform(F.concat(F.col("user_id").cast("string"), F.lit("|ab"))))
    return users.select("user_id", scalars.inverse_cdf_pick(F.col("u"), [0.1, 0.35, 0.8, 1.0]).alias("pick"))


@query("fn_array_ops", """
WITH g AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1)
SELECT user_id, CAST(len(kinds) AS INTEGER) AS n, array_to_string(kinds, '|') AS joined, kinds[1] AS first_kind, kinds[-1] AS last_kind, list_contains(kinds, 'purchase') AS buys,
  array_to_string([upper(substr(x, 1, 1)) for x in kinds], '') AS initials FROM g""")
def fn_array_ops(t):
    kinds = t.events.groupBy("user_id").agg(F.sort_array(F.array_distinct(F.collect_set("event_type"))).alias("kinds"))
    return kinds.select(
        "user_id", F.size("kinds").alias("n"), F.array_join("kinds", "|").alias("joined"), F.element_at("kinds", 1).alias("first_kind"), F.element_at("kinds", -1).alias("last_kind"),
        F.array_contains("kinds", "purchase").alias("buys"), F.array_join(F.transform("kinds", lambda x: F.upper(F.substring(x, 1, 1))), "").alias("initials"),
    )


@query("fn_json_pack", "SELECT event_id, CAST(to_json({'kind': event_type, 'k': k, 'big': k > 50}) AS VARCHAR) AS packed, k AS unpacked FROM v_events")
def fn_json_pack(t):
    packed = F.to_json(F.struct(F.col("event_type").alias("kind"), "k", (F.col("k") > 50).alias("big")))
    return t.keyed_events.select("event_id", packed.alias("packed"), F.get_json_object(packed, "$.k").cast("bigint").alias("unpacked"))


@query("fn_tax_bps", "SELECT receipt_id, line_num, product_id, ext_cents, (ext_cents * (700 + store_id % 300) * (50 * (product_id % 3)) + 500000) // 1000000 AS tax FROM v_lines")
def fn_tax_bps(t):
    lines = t.lines.withColumns({"bps": 700 + F.col("store_id") % 300, "pct": 50 * (F.col("product_id") % 3)})
    return lines.select("receipt_id", "line_num", "product_id", "ext_cents", scalars.tax_cents("ext_cents", "bps", "pct").alias("tax"))


@query("fn_bogo_discount", "SELECT receipt_id, line_num, product_id, unit_cents * (quantity // 2) AS discount FROM v_lines")
def fn_bogo_discount(t):
    return t.lines.select("receipt_id", "line_num", "product_id", scalars.bogo_discount("unit_cents", "quantity").alias("discount"))


@query("fn_promo_eligibility", "SELECT receipt_id, line_num, product_id, month(event_date) IN (11, 12) AND ext_cents >= 2000000 AND quantity >= 10 AS eligible FROM v_lines")
def fn_promo_eligibility(t):
    ok = scalars.promo_eligible(F.month("event_date"), F.col("ext_cents"), F.col("quantity"), months=[11, 12], min_subtotal=2_000_000, min_quantity=10)
    return t.lines.select("receipt_id", "line_num", "product_id", ok.alias("eligible"))


@query("fn_dim_date", """
WITH d AS (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS date)
SELECT date, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
  CAST(isodow(date) AS INTEGER) AS iso_day_of_week, CAST(strftime(date, '%U') AS INTEGER) AS week_sunday, strftime(date, '%B') AS month_name, strftime(date, '%A') AS day_name,
  CAST(CASE WHEN month(date) >= 7 THEN year(date) ELSE year(date) - 1 END AS INTEGER) AS fiscal_year, CAST(CASE WHEN month(date) >= 7 THEN (month(date) - 7) // 3 + 1 ELSE (month(date) + 5) // 3 + 1 END AS INTEGER) AS fiscal_quarter, dayofweek(date) IN (0, 6) AS is_weekend FROM d""")
def fn_dim_date(t):
    span = t.receipts.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    return scalars.date_dimension(span, "first", "last")


@query("seeded_split", f"""
SELECT receipt_id, CASE WHEN {md5_draw("CAST(receipt_id AS VARCHAR) || '|holdout|42'")} * 100 < 20 THEN 'holdout' ELSE 'train' END AS split
FROM (SELECT o_orderkey AS receipt_id FROM orders)""")
def seeded_split(t):
    return t.receipts.select("receipt_id", scalars.seeded_split(F.col("receipt_id"), 42, 20).alias("split"))


# --- evaluation ---


@query("eval_brier", "SELECT event_type, count(*) AS n, round(avg(((k / 100.0::DOUBLE) - (k % 2)) * ((k / 100.0::DOUBLE) - (k % 2))), 9) AS brier FROM v_events GROUP BY 1")
def eval_brier(t):
    df = t.keyed_events.select("event_type", (F.col("k") / 100.0).alias("p"), (F.col("k") % 2).alias("y"))
    return evaluation.brier(df, "y", "p", ["event_type"]).withColumn("brier", F.round("brier", 9))


@query("eval_mape", """
SELECT event_type, count(*) AS n, round(avg(abs((value - k) / nullif(k, 0))), 9) AS mape, round(avg(abs(value - k)), 9) AS mae, round(sqrt(avg((value - k) * (value - k))), 9) AS rmse FROM v_events GROUP BY 1""")
def eval_mape(t):
    out = evaluation.error_metrics(t.keyed_events, "k", "value", ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 9).alias(c) for c in ("mape", "mae", "rmse")])


@query("eval_interval_coverage", """
SELECT event_type, count(*) AS n, CAST(count(*) FILTER (WHERE k BETWEEN value - 30 AND value + 20) AS DOUBLE) / count(*) AS coverage, round(avg((value + 20) - (value - 30)), 6) AS mean_width FROM v_events GROUP BY 1""")
def eval_interval_coverage(t):
    df = t.keyed_events.withColumns({"lo": F.col("value") - 30, "hi": F.col("value") + 20})
    return evaluation.interval_coverage(df, "k", "lo", "hi", ["event_type"]).withColumn("mean_width", F.round("mean_width", 6))


@query("assign_chronological_split", """
WITH d AS (SELECT DISTINCT event_date FROM v_receipts), r AS (SELECT event_date, row_number() OVER (ORDER BY event_date) AS i, count(*) OVER () AS n FROM d),
c AS (SELECT max(event_date) FILTER (WHERE i = ceil(n * 0.6::DOUBLE)) AS a, max(event_date) FILTER (WHERE i = ceil(n * (0.6::DOUBLE + 0.2::DOUBLE))) AS b FROM r)
SELECT receipt_id, CASE WHEN event_date <= a THEN 'train' WHEN event_date <= a + 30 THEN 'embargo' WHEN event_date <= b THEN 'calibration' WHEN event_date <= b + 30 THEN 'embargo' ELSE 'test' END AS split FROM v_receipts, c""")
def assign_chronological_split(t):
    a, b = evaluation.split_cutoffs(t.receipts, "event_date", train=0.6, calibration=0.2)
    return evaluation.assign_chronological_split(t.receipts, "event_date", train_until=a, calibration_until=b, embargo_days=30).select("receipt_id", "split")
