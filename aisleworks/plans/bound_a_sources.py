"""Scans, sources and sinks on the fixture tables."""

from pyspark.sql import functions as F

from aisleworks.plans.registry import query
from aisleworks.session import scratch_path
from aisleworks.sources import envelope, files, publish


@query("scan_parquet_union", """
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS o_orderpriority,
       CAST(o_orderdate AS DATE) AS event_date FROM orders""")
def scan_parquet_union(t):
    """Two part folders of one table, the older one without the priority column."""
    root = scratch_path(t.spark, "parts")
    o = t.orders
    old = o.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    new = o.where("o_orderstatus <> 'O'").select("o_totalprice", "o_orderpriority", "o_orderkey", "o_custkey", "o_orderdate")
    old.write.parquet(f"{root}/part=1")
    new.write.parquet(f"{root}/part=2")
    df = files.scan_parquet_union(t.spark, [f"{root}/part=1", f"{root}/part=2"], date_from="o_orderdate")
    return df.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "event_date")


@query("cast_id_columns", """
SELECT c_custkey, TRY_CAST(split_part(c_name, '#', 2) AS BIGINT) AS number,
       TRY_CAST(c_mktsegment AS BIGINT) AS segment_number, c_acctbal FROM customer""")
def cast_id_columns(t):
    raw = t.customer.select(
        "c_custkey", F.split("c_name", "#")[1].alias("number"), F.col("c_mktsegment").alias("segment_number"), "c_acctbal"
    )
    return files.cast_columns(raw, {"number": "bigint", "segment_number": "bigint", "absent": "bigint"})


@query("resolve_columns", "SELECT c_custkey AS customer_id, c_nationkey AS nation_id, c_acctbal AS balance FROM customer")
def resolve_columns(t):
    return files.resolve_columns(
        t.customer,
        {"customer_id": ["ID", "C_CUSTKEY"], "nation_id": ["C_NationKey", "nation"], "balance": ["c_acctbal"]},
    )


@query("legacy_rename_coalesce", """
SELECT o_orderkey AS receipt_id,
       coalesce(CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice) END, o_totalprice) AS total,
       coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, o_orderdate) AS event_ts FROM orders""")
def legacy_rename_coalesce(t):
    raw = t.orders.select(
        F.col("o_orderkey").alias("ReceiptId"), F.col("o_totalprice").alias("TotalAmount"),
        F.when(F.col("o_orderstatus") == "F", F.round("o_totalprice")).alias("total"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("event_ts"),
        F.col("o_orderdate").alias("loaded_at"),
    )
    return files.rename_legacy(
        raw, {"ReceiptId": "receipt_id", "TotalAmount": "total"}, backfill={"event_ts": F.col("loaded_at")}
    ).drop("loaded_at")


@query("parse_envelope", """
SELECT event_id, event_type, 'T' || CAST(event_id AS VARCHAR) AS trace_id, ts AS ingest_timestamp,
       k AS amount, value AS score, CASE WHEN k % 2 = 0 THEN 'even' END AS parity FROM v_events""")
def parse_envelope(t):
    raw = t.keyed_events.select(
        "event_id",
        F.to_json(F.struct(
            "event_type", F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("trace_id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ingest_timestamp"),
            F.struct(F.col("k").alias("amount"), F.col("value").alias("score"),
                     F.when(F.col("k") % 2 == 0, "even").alias("parity")).alias("payload"),
        )).alias("body"),
    )
    parsed = envelope.parse_envelope(raw, "body", "amount bigint, score double, parity string", keep=["event_id"])
    return parsed.select("event_id", "event_type", "trace_id", "ingest_timestamp", "amount", "score", "parity")


@query("route_by_type", """
SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'unknown_event' END AS sink,
       event_type, count(*) AS events, CAST(sum(k) AS BIGINT) AS k_sum FROM v_events GROUP BY 1, 2""")
def route_by_type(t):
    path = scratch_path(t.spark, "routed")
    envelope.write_routed(t.keyed_events, path, ["view", "click", "purchase"])
    return t.spark.read.parquet(path).groupBy("sink", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("k").alias("k_sum")
    )


BUNDLE_SQL = """
WITH slots AS (
  SELECT event_id, 'receipt_created' AS event_type, value AS amount, k AS units FROM v_events WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, 'payment_processed', value, k FROM v_events WHERE event_type = 'purchase' AND k % 2 = 0
  UNION ALL SELECT event_id, 'customer_entered', value, k FROM v_events)
SELECT event_id, event_type, 'C' || CAST(event_id AS VARCHAR) AS correlation_id, units FROM slots"""


def bundle(df):
    """A sale fans out to a receipt, maybe a payment, and every event to a visit."""
    payload = F.struct(F.col("value").alias("amount"), F.col("k").alias("units"))
    sale = F.col("event_type") == "purchase"
    built = envelope.explode_bundle(
        df,
        {
            "receipt_created": (sale, payload),
            "payment_processed": (sale & (F.col("k") % 2 == 0), payload),
            "customer_entered": (F.lit(True), payload),
        },
        keep=["event_id"],
        envelope={"correlation_id": F.concat(F.lit("C"), F.col("event_id").cast("string"))},
    )
    return envelope.parse_envelope(built, "body", "amount double, units bigint", keep=["event_id"]).select(
        "event_id", "event_type", "correlation_id", "units"
    )


@query("explode_event_bundle", BUNDLE_SQL)
def explode_event_bundle(t):
    return bundle(t.keyed_events)


@query("publish_staged", """
SELECT 'by_status' AS table_name, 'PROMOTED' AS status, count(DISTINCT o_orderstatus) AS row_count FROM orders
UNION ALL SELECT 'by_day', 'PROMOTED', count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders""")
def publish_staged(t):
    frames = {
        "by_status": t.receipts.groupBy("payment_status").agg(F.sum("total_cents").alias("total_cents")),
        "by_day": t.receipts.groupBy("event_date").agg(F.sum("total_cents").alias("total_cents")),
    }
    root = scratch_path(t.spark, "published")
    return publish.publish(t.spark, root, "run-1", frames).select("table_name", "status", "row_count")


@query("publication_audit", """
WITH log AS (
  SELECT 'run-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_type AS table_name, k AS row_count,
         CASE WHEN k < 20 THEN 'FAILED' WHEN k < 50 THEN 'STAGED' ELSE 'PROMOTED' END AS status, ts, event_id FROM v_events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, table_name ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1)
SELECT run_id, count(*) AS tables, CAST(sum(CASE WHEN status = 'PROMOTED' THEN row_count ELSE 0 END) AS BIGINT) AS rows_promoted,
       count(*) FILTER (WHERE status = 'FAILED') AS failed_tables,
       CASE WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'FAILED' ELSE 'PROMOTED' END AS state
FROM latest GROUP BY run_id""")
def publication_audit(t):
    log = t.keyed_events.select(
        F.concat(F.lit("run-"), F.to_date("ts").cast("string")).alias("run_id"), F.col("event_type").alias("table_name"),
        F.col("k").alias("row_count"),
        F.when(F.col("k") < 20, "FAILED").when(F.col("k") < 50, "STAGED").otherwise("PROMOTED").alias("status"),
        F.col("ts").alias("generated_at"), "event_id",
    )
    return publish.run_report(log, ["generated_at", "event_id"])


@query("insert_only_merge", """
WITH existing AS (SELECT * FROM v_receipts WHERE event_date < DATE '1998-01-01')
SELECT receipt_id, customer_id, total_cents FROM v_receipts r
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.receipt_id = r.receipt_id)""")
def insert_only_merge(t):
    """Late copies of stored receipts arrive together with new ones, each twice."""
    incoming = t.receipts.unionByName(t.receipts)
    stored = t.receipts.where(F.col("event_date") < F.lit("1998-01-01").cast("date"))
    return files.insert_only_merge(incoming, stored, ["receipt_id"]).select("receipt_id", "customer_id", "total_cents")


@query("compact_cluster", """
SELECT l_suppkey, l_shipdate, count(*) AS lines, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS cents
FROM lineitem GROUP BY 1, 2""")
def compact_cluster(t):
    path = scratch_path(t.spark, "clustered")
    files.compact_clustered(
        t.lineitem, path, ["l_suppkey", "l_shipdate"], rows_per_file=20_000, spread=["l_orderkey", "l_partkey"]
    )
    return t.spark.read.parquet(path).groupBy("l_suppkey", "l_shipdate").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.round(F.col("l_extendedprice") * 100)).cast("bigint").alias("cents")
    )


@query("retention_filter", """
SELECT event_id, ts, event_type FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def retention_filter(t):
    newest = t.events.agg(F.max("ts")).scalar()
    return files.retain(t.events, "ts", 7, newest).select("event_id", "ts", "event_type")


@query("anti_existing", """
SELECT customer_id, count(*) AS receipts FROM v_receipts r
WHERE customer_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY 1""")
def anti_existing(t):
    known = t.events.where("event_type = 'signup'").select(F.col("user_id").alias("customer_id"))
    return files.without_existing(t.receipts, known, ["customer_id"]).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("receipts")
    )


@query("distinct_exact_then_key", """
SELECT receipt_id, line_num, count(*) AS variants FROM (SELECT DISTINCT * FROM v_lines)
GROUP BY 1, 2 HAVING count(*) = 1""")
def distinct_exact_then_key(t):
    """Lines whose key is free of conflicts once exact copies are gone."""
    twice = t.lines.unionByName(t.lines)
    return twice.distinct().groupBy("receipt_id", "line_num").agg(F.count(F.lit(1)).alias("variants")).where("variants = 1")


@query("dq_conflicting_duplicates", """
SELECT receipt_id, line_num, count(*) AS variants FROM (SELECT DISTINCT * FROM v_lines)
GROUP BY 1, 2 HAVING count(*) > 1""")
def dq_conflicting_duplicates(t):
    return files.conflicting_keys(t.lines, ["receipt_id", "line_num"])


@query("published_vs_source_diff", """
WITH a AS (SELECT store_id, line_type, quantity FROM v_lines),
     b AS (SELECT store_id, 'SALE' AS line_type, quantity FROM v_lines),
     u AS (SELECT *, 1 AS l, 0 AS r FROM a UNION ALL SELECT *, 0, 1 FROM b)
SELECT store_id, line_type, quantity, CAST(sum(l) AS BIGINT) AS left_count, CAST(sum(r) AS BIGINT) AS right_count
FROM u GROUP BY 1, 2, 3 HAVING sum(l) <> sum(r)""")
def published_vs_source_diff(t):
    """A published copy that lost the returns flag, against its source."""
    source = t.lines.select("store_id", "line_type", "quantity")
    return files.multiset_difference(source, source.withColumn("line_type", F.lit("SALE")))
