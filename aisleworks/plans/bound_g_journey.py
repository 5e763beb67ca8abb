"""Journeys and anomalies on the fixture tables."""

from functools import reduce

from pyspark.sql import functions as F

from aisleworks.operators import anomaly, gold, journey, ranges
from aisleworks.plans.registry import query

KEYS = ["store_id", "customer_ble_id"]
ORDER = ["event_ts", "event_id"]
GAP = 6 * 3600

SESSION_SQL = f"""
WITH g AS (SELECT *, CASE WHEN coalesce(floor(epoch_us(event_ts) / 1000000) - floor(epoch_us(lag(event_ts) OVER w) / 1000000) > {GAP}, true) THEN 1 ELSE 0 END AS s
  FROM v_zone_changes WINDOW w AS (PARTITION BY store_id, customer_ble_id ORDER BY event_ts, event_id)),
sess AS (SELECT * EXCLUDE (s), store_id || '_' || customer_ble_id || '_' || session_id AS session_key FROM (SELECT *, CAST(sum(s) OVER (PARTITION BY store_id, customer_ble_id ORDER BY event_ts, event_id) AS BIGINT) AS session_id FROM g)),
paths AS (SELECT session_key, store_id, customer_ble_id, customer_id, min(event_ts) AS session_start, max(event_ts) AS session_end, count(*) + 1 AS path_length,
  arg_min(from_zone, (event_ts, event_id)) || ' -> ' || string_agg(to_zone, ' -> ' ORDER BY event_ts, event_id) AS path_string,
  CAST(floor(epoch_us(max(event_ts)) / 1000000) - floor(epoch_us(min(event_ts)) / 1000000) AS BIGINT) AS duration_seconds FROM sess GROUP BY 1, 2, 3, 4 HAVING count(*) + 1 >= 3)"""


def sessions(t):
    return journey.sessionize(t.zone_changes, KEYS, ORDER, timeout_seconds=GAP, hot=t.visitor_hot)


def paths(t):
    return journey.session_paths(sessions(t), [*KEYS, "customer_id"], ORDER, min_length=3)


@query("sessionize_gap", SESSION_SQL + " SELECT event_id, store_id, customer_ble_id, session_id, session_key FROM sess")
def sessionize_gap(t):
    return sessions(t).select("event_id", "store_id", "customer_ble_id", "session_id", "session_key")


@query("ordered_path", SESSION_SQL + " SELECT session_key, path_string, path_length, duration_seconds, session_start, session_end FROM paths")
def ordered_path(t):
    return paths(t).select("session_key", "path_string", "path_length", "duration_seconds", "session_start", "session_end")


DWELL_SQL = SESSION_SQL + """, nxt AS (SELECT *, lead(event_ts) OVER (PARTITION BY session_key ORDER BY event_ts, event_id) AS n FROM sess),
dwell AS (SELECT *, CAST(floor(epoch_us(n) / 1000000) - floor(epoch_us(event_ts) / 1000000) AS BIGINT) AS dwell_seconds FROM nxt)"""


@query("dwell_by_lead", DWELL_SQL + " SELECT event_id, store_id, to_zone, dwell_seconds FROM dwell WHERE dwell_seconds > 0 AND dwell_seconds < 14400")
def dwell_by_lead(t):
    return journey.dwell_times(sessions(t), KEYS, ORDER, cutoff_seconds=14400, hot=t.visitor_hot).select("event_id", "store_id", "to_zone", "dwell_seconds")


@query("zone_dwell_stats", DWELL_SQL + """ SELECT store_id, to_zone, count(*) AS visit_count, CAST(sum(dwell_seconds) AS DOUBLE) / count(*) AS avg_dwell_seconds, min(dwell_seconds) AS min_dwell_seconds,
max(dwell_seconds) AS max_dwell_seconds, quantile_cont(dwell_seconds, 0.5) AS median_dwell_seconds FROM dwell WHERE dwell_seconds > 0 AND dwell_seconds < 14400 GROUP BY 1, 2""")
def zone_dwell_stats(t):
    dwell = journey.dwell_times(sessions(t), KEYS, ORDER, cutoff_seconds=14400, hot=t.visitor_hot)
    sums = dwell.groupBy("store_id", "to_zone").agg(
        F.count(F.lit(1)).alias("visit_count"), F.avg("dwell_seconds").alias("avg_dwell_seconds"),
        F.min("dwell_seconds").alias("min_dwell_seconds"), F.max("dwell_seconds").alias("max_dwell_seconds"),
    )
    middle = ranges.exact_percentiles(dwell, ["store_id", "to_zone"], "dwell_seconds", {"median_dwell_seconds": 0.5}).drop("n")
    return sums.join(middle, ["store_id", "to_zone"])


@query("transition_matrix", """
WITH c AS (SELECT store_id, from_zone, to_zone, count(*) AS transition_count FROM v_zone_changes GROUP BY 1, 2, 3)
SELECT *, CAST(transition_count AS DOUBLE) / sum(transition_count) OVER (PARTITION BY store_id, from_zone) AS transition_probability FROM c""")
def transition_matrix(t):
    return gold.transition_matrix(t.zone_changes, ["store_id"], "from_zone", "to_zone")


FREQUENCY_SQL = SESSION_SQL + """, freq AS (SELECT store_id, path_string, path_length, count(*) AS occurrence_count, CAST(sum(duration_seconds) AS DOUBLE) / count(*) / 60.0 AS avg_session_minutes
  FROM paths GROUP BY 1, 2, 3)"""


def frequency(t):
    return paths(t).groupBy("store_id", "path_string", "path_length").agg(
        F.count(F.lit(1)).alias("occurrence_count"), (F.sum("duration_seconds") / F.count(F.lit(1)) / F.lit(60.0)).alias("avg_session_minutes")
    )


@query("path_frequency", FREQUENCY_SQL + " SELECT * FROM freq")
def path_frequency(t):
    return frequency(t)


@query("top_paths_per_store", FREQUENCY_SQL + " SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY occurrence_count DESC, path_string) AS INTEGER) AS rank FROM freq QUALIFY rank <= 20")
def top_paths_per_store(t):
    return journey.top_paths(frequency(t), 20)


ASSIGN_SQL = SESSION_SQL + """, r AS (SELECT purchase_id AS receipt_id, match_key AS customer_id, match_key % 10 AS store_id, purchase_ts, total_cents, CAST(floor(epoch_us(purchase_ts) / 1000000) AS BIGINT) AS p FROM v_purchases),
s AS (SELECT *, CAST(floor(epoch_us(session_start) / 1000000) AS BIGINT) AS a, CAST(floor(epoch_us(session_end) / 1000000) AS BIGINT) AS b FROM paths),
assigned AS (SELECT r.receipt_id, r.total_cents, s.session_key, s.store_id FROM r JOIN s USING (customer_id, store_id) WHERE p >= a AND p <= b + 300
  QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY CASE WHEN p <= b THEN 1 ELSE 0 END DESC, abs(p - b), a DESC, session_key) = 1)"""


def assigned(t, walked):
    receipts = t.purchases.select(
        F.col("purchase_id").alias("receipt_id"), F.col("match_key").alias("customer_id"), (F.col("match_key") % 10).alias("store_id"), "purchase_ts", "total_cents"
    )
    spans = walked.select("store_id", "customer_id", "session_key", "session_start", "session_end")
    return ranges.open_span(
        receipts, spans, keys=["store_id", "customer_id"], at="purchase_ts", start="session_start", end="session_end",
        span_id="session_key", point_id="receipt_id", grace_seconds=300,
    )


@query("join_interval_session", ASSIGN_SQL + " SELECT receipt_id, session_key, total_cents FROM assigned")
def join_interval_session(t):
    return assigned(t, paths(t)).select("receipt_id", "session_key", "total_cents")


METRIC_SQL = ASSIGN_SQL + """, b AS (SELECT session_key, count(DISTINCT receipt_id) AS n, sum(total_cents) AS c FROM assigned GROUP BY 1),
metrics AS (SELECT store_id, path_string, path_length, count(*) AS total_sessions, count(*) FILTER (WHERE n > 0) AS sessions_with_purchase, CAST(coalesce(sum(c), 0) AS BIGINT) AS total_revenue_cents,
  CAST(count(*) FILTER (WHERE n > 0) AS DOUBLE) / count(*) AS conversion_rate, CAST(sum(duration_seconds) AS DOUBLE) / count(*) / 60.0 AS avg_session_minutes,
  CAST(coalesce(sum(c), 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE n > 0), 0) AS avg_basket_cents FROM paths LEFT JOIN b USING (session_key) GROUP BY 1, 2, 3)"""


@query("path_metrics", METRIC_SQL + " SELECT * FROM metrics")
def path_metrics(t):
    walked = paths(t)
    return journey.path_metrics(walked, assigned(t, walked))


@query("journey_patterns", METRIC_SQL + " SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY total_sessions DESC, path_string) AS INTEGER) AS rank FROM metrics QUALIFY rank <= 20")
def journey_patterns(t):
    """Path metrics of the most frequent paths; the session count is the path frequency."""
    walked = paths(t)
    metrics = journey.path_metrics(walked, assigned(t, walked)).withColumnRenamed("total_sessions", "occurrence_count")
    return journey.top_paths(metrics, 20).withColumnRenamed("occurrence_count", "total_sessions")


# --- anomalies: hourly series over the last 720 hours ---

SINCE = "ingest_timestamp > (SELECT max(ts) FROM events) - INTERVAL 720 HOUR"
HOUR = "date_trunc('hour', ingest_timestamp) AS hour_ts"


def alert_sql(series, keys, entity_id, value, metric, entity, prefix, details):
    on = " AND ".join(f"s.{k} = f.{k}" for k in keys)
    cols = ", ".join(keys)
    return f"""
SELECT '{prefix}' || sha256({entity_id} || CAST(hour_ts AS VARCHAR)) AS alert_id, '{metric}' AS metric_type, '{entity}' AS entity_type, {entity_id} AS entity_id,
  hour_ts AS time_window, round(expected_value, 6) AS expected_value, CAST({value} AS DOUBLE) AS actual_value, round(score, 6) AS anomaly_score,
  CASE WHEN abs(score) >= 3 THEN 'critical' WHEN abs(score) >= 2 THEN 'high' WHEN abs(score) >= 1.5 THEN 'medium' ELSE 'low' END AS severity,
  CAST(to_json({details}) AS VARCHAR) AS alert_details
FROM (SELECT s.*, s.{value} - s.res AS expected_value, coalesce(CASE WHEN res > p90 THEN (res - p90) / nullif(p90 - p10, 0) WHEN res < p10 THEN (res - p10) / nullif(p90 - p10, 0) END, 0.0) AS score
  FROM (SELECT *, {value} - avg({value}) OVER (PARTITION BY {cols}) AS res FROM ({series})) s
  JOIN (SELECT {cols}, quantile_cont(res, 0.1) AS p10, quantile_cont(res, 0.9) AS p90 FROM (SELECT *, {value} - avg({value}) OVER (PARTITION BY {cols}) AS res FROM ({series})) GROUP BY {cols}) f ON {on})
WHERE abs(score) >= 1.5"""


def dev_sql(value):
    return f"'deviation_pct': round(({value} - expected_value) / nullif(expected_value, 0) * 100, 2)"


ALERT_SQL = {
    "velocity": alert_sql(
        f"SELECT store_id, {HOUR}, count(*) AS n FROM v_raw WHERE {SINCE} GROUP BY 1, 2", ["store_id"], "CAST(store_id AS VARCHAR)", "n", "transaction_velocity", "store", "txn_vel_",
        "{'anomaly_direction': CASE WHEN n > expected_value THEN 'spike' ELSE 'drop' END, " + dev_sql("n") + "}"),
    "basket": alert_sql(
        f"SELECT store_id, {HOUR}, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS basket, max(CAST(round(value * 100) AS BIGINT)) AS top FROM v_raw WHERE {SINCE} AND value > 0 GROUP BY 1, 2",
        ["store_id"], "CAST(store_id AS VARCHAR)", "basket", "basket_size", "store", "basket_",
        "{'anomaly_direction': CASE WHEN basket > expected_value THEN 'unusually_high' ELSE 'unusually_low' END, " + dev_sql("basket") + ", 'max_basket_in_window': top}"),
    "inventory": alert_sql(
        f"SELECT store_id, event_type AS product, {HOUR}, CAST(sum(k - 50) AS BIGINT) AS net, CAST(sum(abs(k - 50)) AS BIGINT) AS moved FROM v_raw WHERE {SINCE} GROUP BY 1, 2, 3",
        ["store_id", "product"], "CAST(s.store_id AS VARCHAR) || ':' || s.product".replace("s.", ""), "moved", "inventory_movement", "store_product", "inv_mov_",
        "{'net_delta': net, 'movement_type': CASE WHEN net > 0 THEN 'gain' ELSE 'loss' END, " + dev_sql("moved") + "}"),
    "payment": alert_sql(
        f"SELECT store_id, {HOUR}, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) * 100 AS rate FROM v_raw WHERE {SINCE} GROUP BY 1, 2",
        ["store_id"], "CAST(store_id AS VARCHAR)", "rate", "payment_failure_rate", "store", "pay_fail_",
        "{'total_payments': total, 'failed_payments': failed, 'failure_rate_pct': round(rate, 2)}"),
    "traffic": alert_sql(
        f"SELECT store_id, {HOUR}, CAST(sum(k % 7) AS BIGINT) AS customers FROM v_raw WHERE {SINCE} GROUP BY 1, 2", ["store_id"], "CAST(store_id AS VARCHAR)", "customers", "customer_traffic", "store", "traffic_",
        "{'anomaly_direction': CASE WHEN customers > expected_value THEN 'spike' ELSE 'drop' END, " + dev_sql("customers") + "}"),
}
ALL_SQL = "SELECT * FROM (" + " UNION ALL ".join(f"({sql})" for sql in ALERT_SQL.values()) + ")"


def hourly(t, keys, metrics, where=None):
    newest = t.events.agg(F.max("ts")).scalar()
    raw = gold.trailing_filter(t.raw, "ingest_timestamp", newest, 720)
    raw = raw.where(where) if where is not None else raw
    return raw.groupBy(*keys, F.date_trunc("hour", "ingest_timestamp").alias("hour_ts")).agg(*metrics)


def velocity(t):
    return anomaly.alerts(
        hourly(t, ["store_id"], [F.count(F.lit(1)).alias("n")]), ["store_id"], "hour_ts", "n", metric="transaction_velocity", entity="store", prefix="txn_vel_",
        details={"anomaly_direction": anomaly.direction("n", "spike", "drop"), "deviation_pct": anomaly.deviation_pct("n")},
    )


def basket(t):
    cents = F.round(F.col("value") * 100).cast("bigint")
    series = hourly(t, ["store_id"], [F.avg(cents).alias("basket"), F.max(cents).alias("top")], F.col("value") > 0)
    return anomaly.alerts(
        series, ["store_id"], "hour_ts", "basket", metric="basket_size", entity="store", prefix="basket_",
        details={"anomaly_direction": anomaly.direction("basket", "unusually_high", "unusually_low"), "deviation_pct": anomaly.deviation_pct("basket"), "max_basket_in_window": F.col("top")},
    )


def inventory(t):
    delta = F.col("k") - 50
    series = hourly(t, ["store_id", F.col("event_type").alias("product")], [F.sum(delta).alias("net"), F.sum(F.abs(delta)).alias("moved")])
    return anomaly.alerts(
        series, ["store_id", "product"], "hour_ts", "moved", metric="inventory_movement", entity="store_product", prefix="inv_mov_",
        details={"net_delta": F.col("net"), "movement_type": F.when(F.col("net") > 0, "gain").otherwise("loss"), "deviation_pct": anomaly.deviation_pct("moved")},
    )


def payment(t):
    failed = F.count_if(F.col("event_type") == "error")
    series = hourly(t, ["store_id"], [F.count(F.lit(1)).alias("total"), failed.alias("failed"), (failed / F.count(F.lit(1)) * 100).alias("rate")])
    return anomaly.alerts(
        series, ["store_id"], "hour_ts", "rate", metric="payment_failure_rate", entity="store", prefix="pay_fail_",
        details={"total_payments": F.col("total"), "failed_payments": F.col("failed"), "failure_rate_pct": F.round("rate", 2)},
    )


def traffic(t):
    return anomaly.alerts(
        hourly(t, ["store_id"], [F.sum(F.col("k") % 7).alias("customers")]), ["store_id"], "hour_ts", "customers", metric="customer_traffic", entity="store", prefix="traffic_",
        details={"anomaly_direction": anomaly.direction("customers", "spike", "drop"), "deviation_pct": anomaly.deviation_pct("customers")},
    )


def every_alert(t):
    return reduce(lambda a, b: a.unionByName(b), [f(t) for f in (velocity, basket, inventory, payment, traffic)])


query("anomaly_velocity", ALERT_SQL["velocity"])(velocity)
query("anomaly_basket", ALERT_SQL["basket"])(basket)
query("anomaly_inventory", ALERT_SQL["inventory"])(inventory)
query("anomaly_payment_failures", ALERT_SQL["payment"])(payment)
query("anomaly_traffic", ALERT_SQL["traffic"])(traffic)
query("anomaly_all", ALL_SQL)(every_alert)
query("union_anomalies", f"SELECT metric_type, severity, count(*) AS alerts FROM ({ALL_SQL}) GROUP BY 1, 2")(
    lambda t: every_alert(t).groupBy("metric_type", "severity").agg(F.count(F.lit(1)).alias("alerts"))
)


@query("anomaly_summary", f"SELECT metric_type, severity, count(*) AS anomaly_count FROM ({ALL_SQL}) WHERE severity IN ('critical', 'high') GROUP BY 1, 2")
def anomaly_summary(t):
    return every_alert(t).where("severity IN ('critical', 'high')").groupBy("metric_type", "severity").agg(F.count(F.lit(1)).alias("anomaly_count"))


@query("anomaly_alert_rollup", f"SELECT count(*) AS alerts, count(DISTINCT severity) AS severities, max(time_window) AS latest FROM ({ALL_SQL})")
def anomaly_alert_rollup(t):
    return every_alert(t).agg(F.count(F.lit(1)).alias("alerts"), F.countDistinct("severity").alias("severities"), F.max("time_window").alias("latest"))


@query("severity_sort", f"""
SELECT alert_id, severity, anomaly_score, CAST(r AS INTEGER) AS severity_rank FROM (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r FROM ({ALL_SQL}))
ORDER BY r, abs(anomaly_score) DESC, alert_id""")
def severity_sort(t):
    """Worst alerts first, by rank of the severity and not by its spelling."""
    return (
        every_alert(t).select("alert_id", "severity", "anomaly_score", anomaly.severity_rank(F.col("severity")).cast("int").alias("severity_rank"))
        .orderBy("severity_rank", F.desc(F.abs("anomaly_score")), "alert_id")
    )


SERIES = f"SELECT store_id, {HOUR}, count(*) AS n FROM v_raw WHERE {SINCE} GROUP BY 1, 2"


@query("series_decompose_anomalies", f"""
WITH d AS (SELECT *, n - avg(n) OVER (PARTITION BY store_id) AS dev FROM ({SERIES})),
r AS (SELECT *, dev - avg(dev) OVER (PARTITION BY store_id, hour(hour_ts)) AS res FROM d),
f AS (SELECT store_id, quantile_cont(res, 0.1) AS p10, quantile_cont(res, 0.9) AS p90 FROM r GROUP BY 1),
s AS (SELECT r.*, coalesce(CASE WHEN res > p90 THEN (res - p90) / nullif(p90 - p10, 0) WHEN res < p10 THEN (res - p10) / nullif(p90 - p10, 0) END, 0.0) AS score FROM r JOIN f USING (store_id))
SELECT store_id, hour_ts, n, round(n - res, 6) AS expected_value, round(score, 6) AS anomaly_score, CASE WHEN score >= 1.5 THEN 1 WHEN score <= -1.5 THEN -1 ELSE 0 END AS anomaly FROM s""")
def series_decompose_anomalies(t):
    series = hourly(t, ["store_id"], [F.count(F.lit(1)).alias("n")])
    out = anomaly.decompose(series, ["store_id"], "hour_ts", "n", seasonal=True)
    return out.select("store_id", "hour_ts", "n", F.round("expected_value", 6).alias("expected_value"), F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly")


@query("series_anomaly", ALERT_SQL["velocity"].replace("SELECT 'txn_vel_'", "SELECT 'txn_vel_'", 1))
def series_anomaly(t):
    """The table-valued form: one call per metric, alerts come back as rows."""
    return velocity(t)
