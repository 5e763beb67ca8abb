"""Structured Streaming runs over the fixture files, checked against the batch statements."""

from pyspark.sql import functions as F

from aisleworks.plans.bound_a_sources import BUNDLE_SQL, bundle
from aisleworks.plans.bound_e_gold import CENTS, SALES
from aisleworks.plans.registry import query
from aisleworks.session import scratch_path
from aisleworks.sources import envelope
from aisleworks.streaming import operators, runs

DELAY = "1 day"


def events(t):
    return runs.stream_table(t.spark, t.dir, "events").select(
        "*", F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.col("user_id") % 10).alias("store_id")
    )


#: Loads of ``over_shuffled_arrivals`` reach over the whole table, so rows are late by its length.
DISORDER, PARTS = "400 days", 3


def over_shuffled_arrivals(t, columns, name, build):
    """What ``build`` makes of events that arrive in loads by a hash; the last load only ends the stream.

    The files are written with the table's own partitions; nothing passes through one task. The
    stream stops after each load and goes on from its checkpoint, so a load is one batch however
    many files it has, and the number of batches does not grow with the table.
    """
    folder, run = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, name)
    rows = t.keyed_events.select("event_id", "ts", *columns)
    types = {f.name: f.dataType for f in rows.schema}
    end = {"event_id": F.lit(-1), "ts": F.expr("TIMESTAMP '2200-01-01 00:00:00'"), "event_type": F.lit("end"), "k": F.lit(0)}
    last = t.spark.range(1).select(*[end.get(c, F.lit(None)).cast(types[c]).alias(c) for c in rows.columns])
    for load in (*(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(PARTS)) == part) for part in range(PARTS)), last):
        load.write.mode("append").parquet(folder)
        stream = build(runs.stream_folder(t.spark, folder))
        table = runs.drain(stream, root=run)
    return runs.appended(t.spark, table, stream.schema)


@query("source_file_stream", "SELECT event_id, ts, user_id, event_type FROM events")
def source_file_stream(t):
    return runs.collect_append(events(t).select("event_id", "ts", "user_id", "event_type"), "file-stream")


@query("stream_route_by_type", """
SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'unknown_event' END AS sink, count(*) AS events FROM events GROUP BY 1""")
def stream_route_by_type(t):
    routed = envelope.with_route(events(t), ["view", "click", "purchase"]).select("event_id", "event_type", "sink")
    table = runs.drain(routed, name="routed", partition_by=["sink"])
    return t.spark.read.parquet(table).groupBy("sink").agg(F.count(F.lit(1)).alias("events"))


@query("stream_event_bundle", BUNDLE_SQL)
def stream_event_bundle(t):
    return runs.collect_append(bundle(events(t)), "bundle")


@query("stream_incremental_load", "SELECT event_id, ts, event_type, value FROM events")
def stream_incremental_load(t):
    """Every event arrives twice; the merge keeps one."""
    feed = events(t).select("event_id", "ts", "event_type", "value")
    target = scratch_path(t.spark, "merged")
    runs.drain(feed.unionByName(feed), name="merge", each=operators.merge_writer(target, ["event_id"]))
    return t.spark.read.parquet(target).drop("batch_id")


@query("stream_dedupe", "SELECT event_id, ts, event_type FROM events")
def stream_dedupe(t):
    feed = events(t).select("event_id", "ts", "event_type")
    return runs.collect_append(operators.deduplicated(feed.unionByName(feed), ["event_id"], "ts", delay=DELAY), "dedupe")


@query("stream_tumbling_sales", f"""
SELECT store_id, time_bucket(INTERVAL '15 minutes', ingest_timestamp) + INTERVAL '15 minutes' AS window_end, count(*) AS receipts, CAST(sum({CENTS}) AS BIGINT) AS cents {SALES} GROUP BY 1, 2""")
def stream_tumbling_sales(t):
    sales = events(t).where("event_type = 'purchase'").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    windows = operators.tumbling(
        sales, ["store_id"], "ts", width="15 minutes", delay=DELAY, metrics=[F.count(F.lit(1)).alias("receipts"), F.sum("cents").alias("cents")]
    )
    return runs.collect_update(windows, ["store_id", "window_end"], "tumbling")


@query("stream_sliding_zone", """
WITH x AS (SELECT store_id, event_type AS zone, k % 7 AS c, k AS dwell, unnest(generate_series(date_trunc('minute', ingest_timestamp) + INTERVAL 1 MINUTE, date_trunc('minute', ingest_timestamp) + INTERVAL 5 MINUTE, INTERVAL 1 MINUTE)) AS window_end FROM v_raw)
SELECT store_id, zone, window_end, CAST(sum(c) AS BIGINT) AS customers, CAST(sum(dwell) AS DOUBLE) / count(*) AS avg_dwell FROM x GROUP BY 1, 2, 3 HAVING sum(c) > 6 OR CAST(sum(dwell) AS DOUBLE) / count(*) > 90""")
def stream_sliding_zone(t):
    traffic = events(t).select("ts", "store_id", F.col("event_type").alias("zone"), (F.col("k") % 7).alias("c"), "k")
    windows = operators.sliding(
        traffic, ["store_id", "zone"], "ts", width="5 minutes", slide="1 minute", delay=DELAY,
        metrics=[F.sum("c").alias("customers"), F.avg("k").alias("avg_dwell")],
    )
    return runs.collect_update(windows, ["store_id", "zone", "window_end"], "sliding").where("customers > 6 OR avg_dwell > 90")


@query("stream_session", """
WITH g AS (SELECT user_id, ts, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) THEN 1 ELSE 0 END AS s, event_id FROM events),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS events FROM n GROUP BY user_id, i""")
def stream_session(t):
    return runs.collect_complete(operators.sessions(events(t), ["user_id"], "ts", gap="6 hours", delay=DELAY), "session")


@query("stream_stream_truck_join", """
SELECT o_orderkey AS shipment_id, o_orderdate AS arrived, l_linenumber AS line_num, l_partkey AS product_id, l_shipdate AS departed, l_quantity AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 90 DAY""")
def stream_stream_truck_join(t):
    arrivals = runs.stream_table(t.spark, t.dir, "orders").select(F.col("o_orderkey").alias("shipment_id"), F.col("o_orderdate").alias("arrived"))
    departures = runs.stream_table(t.spark, t.dir, "lineitem").select(
        F.col("l_orderkey").alias("shipment_id"), F.col("l_shipdate").alias("departed"), F.col("l_linenumber").alias("line_num"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"),
    )
    joined = operators.interval_join(arrivals, departures, ["shipment_id"], left_at="arrived", right_at="departed", within="90 days", delay=DELAY)
    return runs.collect_append(joined, "truck-join")


@query("stream_attribution", """
SELECT p.match_key, p.purchase_id, l.impression_id FROM v_purchases p LEFT JOIN v_last_touch l ON l.purchase_id = p.purchase_id""")
def stream_attribution(t):
    """Touches and purchases arrive in several batches, in no order of time."""
    def build(arrivals):
        kind = F.col("event_type")
        feed = arrivals.select(F.when(kind == "end", -1).otherwise(F.col("user_id")).alias("match_key"), "ts", F.col("event_id").alias("id"), "event_type")
        return operators.last_touch(feed.where(kind.isin("view", "click", "end")), feed.where(kind == "purchase"), delay=DISORDER)
    return over_shuffled_arrivals(t, ["user_id", "event_type"], "attribution", build)


CROWDED, DWELT = 6, 90


@query("stream_alerts", f"""
WITH moves AS (SELECT user_id, store_id, ingest_timestamp AS ts, event_type = 'click' AS leaves FROM v_raw WHERE event_type IN ('view', 'click') AND user_id IS NOT NULL),
ordered AS (SELECT *, lag(leaves) OVER w AS before, min(CASE WHEN leaves THEN ts END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS departed
  FROM moves WINDOW w AS (PARTITION BY user_id ORDER BY ts, NOT leaves)),
stays AS (SELECT store_id, CAST(user_id AS VARCHAR) AS subject, ts AS arrived, departed FROM ordered WHERE NOT leaves AND coalesce(before, true)),
traffic AS (SELECT store_id, event_type AS subject, k % 7 AS c, k, unnest(generate_series(date_trunc('minute', ingest_timestamp) + INTERVAL 1 MINUTE, date_trunc('minute', ingest_timestamp) + INTERVAL 5 MINUTE, INTERVAL 1 MINUTE)) AS window_end FROM v_raw),
single AS (SELECT store_id, CAST(event_id AS VARCHAR) AS subject, ingest_timestamp AS raised_at, event_type, k, value FROM v_raw)
SELECT store_id, subject, 'stockout' AS rule, raised_at, CAST(k % 4 AS DOUBLE) AS measure FROM single WHERE event_type = 'error'
UNION ALL SELECT store_id, subject, 'reorder_urgent', raised_at, CAST(k % 40 AS DOUBLE) FROM single WHERE event_type = 'signup' AND k % 40 < 5
UNION ALL SELECT store_id, subject, 'high_value_receipt', raised_at, value FROM single WHERE event_type = 'purchase' AND value > 20
UNION ALL SELECT store_id, subject, 'truck_dwell_breach', departed, (epoch_us(departed) - epoch_us(arrived)) / 60000000.0 FROM stays WHERE departed > arrived + INTERVAL 90 MINUTE
UNION ALL SELECT store_id, subject, 'truck_overdue', arrived + INTERVAL 90 MINUTE, 90.0 FROM stays WHERE departed IS NULL OR departed > arrived + INTERVAL 90 MINUTE
UNION ALL SELECT store_id, subject, 'zone_overcrowded', window_end, CAST(sum(c) AS DOUBLE) FROM traffic GROUP BY store_id, subject, window_end HAVING sum(c) > {CROWDED} OR CAST(sum(k) AS DOUBLE) / count(*) > {DWELT}""")
def stream_alerts(t):
    """All rules in one query over one feed that arrives in several batches, in no order of time.

    Views and clicks of a user stand for arrivals and departures of a truck.
    """
    return over_shuffled_arrivals(t, ["user_id", "event_type", "k", "value"], "alerts", all_alerts)


def all_alerts(arrivals):
    feed = arrivals.withColumn("store_id", F.col("user_id") % 10)
    kind, k = F.col("event_type"), F.col("k")
    single = operators.rule_alerts(
        feed, {"stockout": kind == "error", "reorder_urgent": (kind == "signup") & (k % 40 < 5), "high_value_receipt": (kind == "purchase") & (F.col("value") > 20)},
        ["store_id", F.col("event_id").cast("string").alias("subject"), F.col("ts").alias("raised_at"), "k", "value"],
    )
    measure = F.when(F.col("rule") == "stockout", k % 4).when(F.col("rule") == "reorder_urgent", k % 40).otherwise(F.col("value"))
    moves = feed.where(kind.isin("view", "click", "end")).withColumn("user_id", F.when(kind == "end", -1).otherwise(F.col("user_id")))
    stays = operators.stay_alerts(moves, "user_id", "store_id", at="ts", leaves=kind == "click", minutes=90, delay=DISORDER)
    crowds = operators.sliding(
        feed, ["store_id", "event_type"], "ts", width="5 minutes", slide="1 minute", delay=DISORDER,
        metrics=[F.sum(k % 7).alias("customers"), F.avg("k").alias("avg_dwell")],
    ).where((F.col("customers") > CROWDED) | (F.col("avg_dwell") > DWELT))
    return single.select("store_id", "subject", "rule", "raised_at", measure.cast("double").alias("measure")).unionByName(
        stays.select(F.col("site").alias("store_id"), "subject", F.concat(F.lit("truck_"), "rule").alias("rule"), "raised_at", "measure")
    ).unionByName(crowds.select(
        "store_id", F.col("event_type").alias("subject"), F.lit("zone_overcrowded").alias("rule"), F.col("window_end").alias("raised_at"), F.col("customers").cast("double").alias("measure")
    ))


@query("stream_upsert_sink", "SELECT user_id, count(*) AS events, CAST(sum(k) AS BIGINT) AS k_sum FROM v_events GROUP BY 1")
def stream_upsert_sink(t):
    """Update-mode aggregate into batch folders that a replay overwrites."""
    counts = events(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("k_sum"))
    return runs.collect_update(counts, ["user_id"], "upsert")


@query("stream_late_quarantine", """
SELECT event_id, ts, CASE WHEN k % 2 = 1 AND ts < (SELECT max(ts) FROM v_events WHERE k % 2 = 0) - INTERVAL 1 DAY THEN 'quarantine' ELSE 'main' END AS sink FROM v_events""")
def stream_late_quarantine(t):
    """Two loads of many files arrive one after the other; the second repeats the whole month.

    The stream stops after the first and goes on from its checkpoint, so each load is one batch.
    """
    folder, root, run = (scratch_path(t.spark, name) for name in ("arrivals", "quarantine", "late"))
    for rest in (0, 1):
        t.keyed_events.where(F.col("k") % 2 == rest).select("event_id", "ts").write.mode("append").parquet(folder)
        runs.drain(runs.stream_folder(t.spark, folder), each=operators.quarantine_writer(root, "ts", delay="1 DAY"), root=run)
    return t.spark.read.parquet(f"{root}/rows").drop("batch_id")


@query("stream_running_balance", """
SELECT store_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN -(k % 5) ELSE k % 3 END AS quantity,
  CAST(20 + sum(CASE WHEN event_type = 'purchase' THEN -(k % 5) ELSE k % 3 END) OVER (PARTITION BY store_id ORDER BY ts, event_id) AS BIGINT) AS balance FROM v_raw JOIN events USING (event_id)""".replace(
    "event_type", "r_type").replace("FROM v_raw JOIN events USING (event_id)", "FROM (SELECT store_id, event_id, ingest_timestamp AS ts, event_type AS r_type, k FROM v_raw)"))
def stream_running_balance(t):
    """Movements arrive in several batches, in no order of time."""
    def build(arrivals):
        moves = arrivals.select(
            F.when(F.col("event_type") == "end", -100).otherwise(F.col("user_id") % 10).alias("store_id"), "ts", "event_id",
            F.when(F.col("event_type") == "purchase", -(F.col("k") % 5)).otherwise(F.col("k") % 3).alias("quantity"),
        )
        return operators.running_balance(moves, ["store_id"], at="ts", tie="event_id", opening=20, delay=DISORDER)
    return over_shuffled_arrivals(t, ["user_id", "event_type", "k"], "balance", build).where("store_id IS NULL OR store_id > -100")
