"""Models on the fixture tables: SQL-checked features, then the fits.

``dwell_prediction`` boosts for as many rounds as the surveyed job. The other fits use fewer rounds
than the library defaults allow, as the fixtures are small.
"""

from datetime import timedelta

from pyspark.sql import functions as F

from aisleworks.ml import features, models
from aisleworks.operators import evaluation, gold, ledger, quality, ranges
from aisleworks.plans.bound_c_joins import LOOKBACK_SQL, snapshot_span
from aisleworks.plans.bound_f_windows import KEYS, LEDGER_SQL, ORDER, brand_daily, store_ledger
from aisleworks.plans.registry import query
from aisleworks.session import written

ROUNDS = 10
DWELL_ROUNDS = 120

# --- churn ---


def customers(t):
    return t.table("customer").select(F.col("c_custkey").alias("customer_id"))


def spending(t):
    return t.receipts.select("customer_id", "event_date", F.col("total_cents").alias("cents"), F.col("payment_method").alias("category"))


@query("churn_features", LOOKBACK_SQL + """, everyone AS (SELECT c_custkey AS customer_id FROM customer UNION SELECT customer_id FROM v_receipts WHERE customer_id IS NOT NULL),
spent AS (SELECT customer_id, snapshot_date, count(*) AS purchases, CAST(sum(total_cents) AS BIGINT) AS spend_cents, count(DISTINCT event_date) AS active_days,
  count(DISTINCT payment_method) AS categories, CAST(sum(total_cents) AS DOUBLE) / count(*) AS avg_basket_cents, round(stddev_samp(total_cents), 2) AS basket_stddev, round(stddev_samp(total_cents) / (CAST(sum(total_cents) AS DOUBLE) / count(*)), 6) AS basket_cv
  FROM v_receipts r JOIN snaps s ON r.event_date >= s.snapshot_date - 180 AND r.event_date < s.snapshot_date GROUP BY 1, 2),
so_far AS (SELECT e.customer_id, s.snapshot_date, max(r.event_date) AS newest FROM everyone e CROSS JOIN snaps s LEFT JOIN v_receipts r ON r.customer_id = e.customer_id AND r.event_date < s.snapshot_date GROUP BY 1, 2)
SELECT customer_id, snapshot_date, CAST(coalesce(snapshot_date - newest, snapshot_date - (SELECT min(snapshot_date) FROM snaps) + 181) AS INTEGER) AS recency_days,
  coalesce(purchases, 0) AS purchases, coalesce(spend_cents, 0) AS spend_cents, coalesce(active_days, 0) AS active_days, coalesce(categories, 0) AS categories,
  coalesce(avg_basket_cents, 0) AS avg_basket_cents, coalesce(basket_stddev, 0) AS basket_stddev, coalesce(basket_cv, 0) AS basket_cv
FROM so_far LEFT JOIN spent USING (customer_id, snapshot_date)""")
def churn_features(t):
    first, last = snapshot_span(t.receipts)
    out = features.churn_rows(customers(t), spending(t), first=first, last=last, every=90, behind=180)
    return out.withColumns({"basket_stddev": F.round("basket_stddev", 2), "basket_cv": F.round("basket_cv", 6)})


@query("churn_labels", LOOKBACK_SQL + """
SELECT c.customer_id, s.snapshot_date, CASE WHEN count(r.receipt_id) = 0 THEN 1 ELSE 0 END AS churned FROM (SELECT DISTINCT customer_id FROM v_receipts) c CROSS JOIN snaps s
LEFT JOIN v_receipts r ON r.customer_id = c.customer_id AND r.event_date >= s.snapshot_date AND r.event_date < s.snapshot_date + 90 GROUP BY 1, 2""")
def churn_labels(t):
    first, last = snapshot_span(t.receipts)
    return features.churn_labels(spending(t), first=first, last=last, every=90, ahead=90)


@query("churn_scores")
def churn_scores(t):
    """Fit on early snapshots, calibrate later, score every customer at the newest; labels must be over."""
    names = ["purchases", "spend_cents", "active_days", "recency_days", "categories", "avg_basket_cents", "basket_stddev", "basket_cv"]
    first, last = snapshot_span(t.receipts)
    x = features.churn_rows(customers(t), spending(t), first=first, last=last, every=90, behind=180)
    y = features.churn_labels(spending(t), first=first, last=last, every=90, ahead=90)
    rows = x.join(y, ["customer_id", "snapshot_date"], "left").fillna(1, ["churned"]).withColumn("known", F.date_add("snapshot_date", 90)).persist()
    closed = rows.where(F.col("known") <= last)
    a, b = evaluation.split_cutoffs(closed, "known", train=0.6, calibration=0.2)
    split = evaluation.assign_chronological_split(closed, "known", train_until=a, calibration_until=b, embargo_days=90)
    newest = rows.agg(F.max("snapshot_date")).scalar()
    scored = models.calibrated_scores(
        split.where("split = 'train'"), split.where("split = 'calibration'"), rows.where(F.col("snapshot_date") == newest), names, "churned", iterations=ROUNDS
    )
    band = models.risk_band(F.col("probability"), [(0.8, "Very High"), (0.6, "High"), (0.4, "Medium")], "Low")
    return scored.select(
        "customer_id", F.col("snapshot_date").alias("prediction_date"), F.col("probability").alias("churn_probability"),
        (F.col("probability") >= 0.5).cast("int").alias("churn_prediction"), band.alias("risk_category"), F.lit(90).alias("churn_window_days"),
    )


# --- stock-out ---

STOCK_SQL = LEDGER_SQL + """, eod AS (SELECT store_id, brand, CAST(event_ts AS DATE) AS snapshot_date, balance AS on_hand FROM ledger
  QUALIFY row_number() OVER (PARTITION BY store_id, brand, CAST(event_ts AS DATE) ORDER BY event_ts DESC NULLS LAST, receipt_id DESC NULLS LAST, line_num DESC NULLS LAST, product_id DESC NULLS LAST, gross_cents DESC NULLS LAST) = 1),
dem AS (SELECT store_id, brand, CAST(event_ts AS DATE) AS snapshot_date, CAST(sum(CASE WHEN txn_type = 'SALE' THEN -quantity ELSE 0 END) AS BIGINT) AS demand FROM ledger GROUP BY 1, 2, 3),
j AS (SELECT * FROM eod JOIN dem USING (store_id, brand, snapshot_date)),
f AS (SELECT *, CAST(sum(demand) OVER (w RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS demand_7d, CAST(sum(demand) OVER (w RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS demand_14d,
  CAST(sum(demand) OVER (w RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS demand_30d, CAST(dayofweek(snapshot_date) + 1 AS INTEGER) AS day_of_week,
  CASE WHEN min(on_hand) OVER (w RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 30 DAY FOLLOWING) <= 0 THEN 1 ELSE 0 END AS stockout FROM j WINDOW w AS (PARTITION BY store_id, brand ORDER BY snapshot_date))
SELECT *, CAST(demand_30d AS DOUBLE) / 30 AS demand_velocity_daily, on_hand / nullif(CAST(demand_30d AS DOUBLE) / 30, 0) AS days_of_inventory FROM f"""


def stock_rows(t):
    return features.stockout_features(ledger.daily_close(store_ledger(t), KEYS, ORDER, at="event_ts"), KEYS, horizon=30)


@query("stockout_features", STOCK_SQL)
def stockout_features(t):
    return stock_rows(t)


@query("stockout_risk")
def stockout_risk(t):
    names = ["on_hand", "demand", "demand_7d", "demand_14d", "demand_30d", "day_of_week", "demand_velocity_daily", "days_of_inventory"]
    rows = stock_rows(t).withColumn("known", F.date_add("snapshot_date", 30)).persist()
    closed = rows.where(F.col("known") <= rows.agg(F.max("snapshot_date")).scalar())
    a, b = evaluation.split_cutoffs(closed, "known", train=0.6, calibration=0.2)
    split = evaluation.assign_chronological_split(closed, "known", train_until=a, calibration_until=b, embargo_days=30)
    newest = gold.latest_per_key(rows, KEYS, [F.desc("snapshot_date")])
    scored = models.calibrated_scores(split.where("split = 'train'"), split.where("split = 'calibration'"), newest, names, "stockout", iterations=ROUNDS)
    band = models.risk_band(F.col("probability"), [(0.7, "HIGH"), (0.4, "MEDIUM")], "LOW")
    out = scored.select(
        *KEYS, F.greatest("on_hand", F.lit(0)).alias("current_inventory"), "days_of_inventory", F.col("probability").alias("stockout_probability"),
        (F.col("probability") >= 0.5).cast("int").alias("stockout_predicted"), band.alias("risk_level"), F.col("snapshot_date").alias("inventory_as_of"),
    )
    return ranges.global_rank(out, [F.desc("stockout_probability"), F.asc("store_id"), F.asc("brand")], out="ranking")


# --- dwell ---

DWELL_SQL = """WITH s AS (SELECT shipment_id, arrived, departed, CASE WHEN store_id IS NOT NULL THEN 'STORE_' || CAST(store_id AS VARCHAR) ELSE 'DC_' || CAST(dc_id AS VARCHAR) END AS site,
  CAST(dayofweek(arrived) + 1 AS INTEGER) AS weekday, CAST((epoch(departed) - epoch(arrived)) // 60 AS BIGINT) AS m FROM v_shipments),
h AS (SELECT * FROM s WHERE departed > arrived), hd AS (SELECT CAST(departed AS DATE) AS d, site, weekday, count(*) AS n, sum(m) AS v FROM h GROUP BY 1, 2, 3), t AS (SELECT DISTINCT CAST(arrived AS DATE) AS d, site, weekday FROM s),
p AS (SELECT t.d, t.site, t.weekday, CAST(coalesce(sum(n), 0) AS BIGINT) AS all_count, CAST(coalesce(sum(v), 0) AS BIGINT) AS all_sum, CAST(coalesce(sum(n) FILTER (WHERE hd.site = t.site), 0) AS BIGINT) AS site_count, CAST(coalesce(sum(v) FILTER (WHERE hd.site = t.site), 0) AS BIGINT) AS site_sum,
  CAST(coalesce(sum(n) FILTER (WHERE hd.weekday = t.weekday), 0) AS BIGINT) AS weekday_count, CAST(coalesce(sum(v) FILTER (WHERE hd.weekday = t.weekday), 0) AS BIGINT) AS weekday_sum FROM t LEFT JOIN hd ON hd.d < t.d GROUP BY 1, 2, 3)
SELECT s.shipment_id, s.site, s.weekday, all_count, all_sum, site_count, site_sum, weekday_count, weekday_sum, CAST(all_sum AS DOUBLE) / nullif(all_count, 0) AS all_mean, CAST(site_sum AS DOUBLE) / nullif(site_count, 0) AS site_mean,
  CAST(weekday_sum AS DOUBLE) / nullif(weekday_count, 0) AS weekday_mean FROM s JOIN p ON p.d = CAST(s.arrived AS DATE) AND p.site = s.site AND p.weekday = s.weekday"""


def dwell_rows(t):
    """Stays with their features; the stays are written, as history, arrivals and features all read them."""
    s = t.shipments.select(
        "shipment_id", "arrived", "departed", gold.site_label().alias("site"), F.dayofweek("arrived").alias("weekday"),
        F.floor((F.unix_seconds("departed") - F.unix_seconds("arrived")) / 60).alias("dwell_minutes"),
    )
    s = written(s, "stays")
    return features.dwell_features(s, s.where("departed > arrived"))


@query("dwell_features", DWELL_SQL)
def dwell_features(t):
    return dwell_rows(t).drop("arrived", "departed", "dwell_minutes")


@query("dwell_prediction")
def dwell_prediction(t):
    """Fit on closed stays, purge a day at the cut, predict the stays still open."""
    numeric = ["all_mean", "site_mean", "weekday_mean", "site_count", "weekday"]
    rows = dwell_rows(t).withColumn("arrived_on", F.to_date("arrived")).persist()
    closed = rows.where("departed > arrived")
    a, b = evaluation.split_cutoffs(closed, "arrived_on", train=0.7, calibration=0.2)
    split = evaluation.assign_chronological_split(closed, "arrived_on", train_until=a, calibration_until=b, embargo_days=1)
    out = models.dwell_predictions(
        split.where("split = 'train'"), split.where("split = 'calibration'"), rows.where("departed <= arrived"), numeric, "site", "dwell_minutes", iterations=DWELL_ROUNDS
    )
    return out.select("shipment_id", "site", "predicted_dwell", "lower_bound", "upper_bound")


# --- demand ---


@query("demand_forecast")
def demand_forecast(t):
    """14 days per brand with intervals from a calibration run and errors from a test run."""
    keys, horizon = ["brand"], 14
    daily = brand_daily(t)
    newest = daily.agg(F.max("sale_date")).first()[0]  # one value; all split dates hang on it
    day = lambda back: F.lit(newest - timedelta(days=back))
    series = ledger.dense_calendar(
        daily, keys, date="sale_date", measures=["units"], end=day(0), eligible_until=day(2 * horizon), min_history_days=90, min_daily=0.5
    ).persist()
    table = ledger.rolling_columns(
        ledger.lag_columns(ledger.calendar_columns(series, "sale_date"), keys, "sale_date", "units", [1, 7, 14, 28]),
        keys, "sale_date", "units", means=[7, 14, 28], deviations=[14],
    )
    model = models.fit_demand(table.where((F.col("sale_date") <= day(2 * horizon)) & F.col("lag_28").isNotNull()), "units", iterations=ROUNDS)
    # Calibration, test and final run differ only in their origin, so they are one run.
    states = [models.history_state(series, keys, "sale_date", "units", day(back)) for back in (2 * horizon, horizon, 0)]
    runs = models.recursive_forecast(model, states[0].unionByName(states[1]).unionByName(states[2]), keys, horizon).persist()
    run = lambda back: runs.where(F.col("origin") == day(back))
    actual = series.select(*keys, F.col("sale_date").alias("forecast_date"), "units")
    residuals = run(2 * horizon).join(actual, [*keys, "forecast_date"]).groupBy("step").agg(
        F.percentile_approx(F.abs(F.col("units") - F.col("predicted_units")), F.lit(0.9), F.lit(10_000)).alias("width")
    )
    errors = evaluation.error_metrics(run(horizon).join(actual, [*keys, "forecast_date"]), "units", "predicted_units", keys).select(*keys, "mape", "rmse")
    out = run(0).join(residuals, "step").join(errors, keys, "left")
    p = F.col("predicted_units")
    return out.select(
        *keys, "forecast_date", p, F.greatest(p - F.col("width"), F.lit(0.0)).alias("lower_bound"), (p + F.col("width")).alias("upper_bound"), "mape", "rmse",
        F.lit(horizon).alias("forecast_horizon_days"), F.col("origin").alias("source_as_of"),
    )


# --- segments and baskets ---


@query("customer_segments")
def customer_segments(t):
    rfm = gold.rfm(t.receipts.where("payment_status <> 'DECLINED'"), customer="customer_id", receipt="receipt_id", at="event_ts", cents="total_cents")
    out = models.kmeans_segments(rfm.drop("first_purchase", "last_purchase"), ["recency_days", "frequency", "monetary_cents"], ks=range(4, 11))
    out = models.segment_labels(out, recency="recency_days", frequency="frequency", monetary="monetary_cents")
    return out.select("customer_id", "recency_days", "frequency", "monetary_cents", "cluster_id", "segment_label", "clusters", "silhouette")


def baskets(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items")).where(F.size("items") >= 2)


@query("market_basket")
def market_basket(t):
    return models.association_rules(baskets(t), support=0.01, confidence=0.1, top=100)


@query("product_recommendations")
def product_recommendations(t):
    return models.recommendations(models.association_rules(baskets(t), support=0.01, confidence=0.1), 5)
