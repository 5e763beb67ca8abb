"""The given Parquet tables and the retail views derived from them.

Each view exists twice: as a DataFrame here and as SQL text for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.session import prepare


def utc_timestamps(df: DataFrame) -> DataFrame:
    """Zone-less Parquet timestamps as UTC instants (watermarks and epochs need them)."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name)
            if isinstance(f.dataType, T.TimestampNTZType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def whole(column) -> F.Column:
    """Half-up rounding of a non-negative double without a detour over decimals."""
    return F.floor(column + 0.5)


def cents(column) -> F.Column:
    return whole(column * 100)


class Tables:
    """Lazy access to one fixture folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return utc_timestamps(self.spark.read.parquet(f"{self.dir}/{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def receipts(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").alias("receipt_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("event_ts"),
            F.to_date("o_orderdate").alias("event_date"),
            cents(F.col("o_totalprice")).alias("total_cents"),
            F.col("o_orderpriority").alias("payment_method"),
            F.when(F.col("o_orderstatus") == "F", "APPROVED")
            .when(F.col("o_orderstatus") == "P", "DECLINED")
            .otherwise("PENDING").alias("payment_status"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        gross = cents(F.col("l_extendedprice"))
        net = whole(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100)
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("receipt_id"),
            F.col("l_linenumber").alias("line_num"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("store_id"),
            F.col("l_shipdate").alias("event_ts"),
            F.to_date("l_shipdate").alias("event_date"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            whole(F.col("l_extendedprice") * 100 / F.col("l_quantity")).alias("unit_cents"),
            gross.alias("gross_cents"),
            net.alias("ext_cents"),
            (gross - net).alias("discount_cents"),
            whole(net * F.col("l_tax")).alias("tax_cents"),
            F.when(
                F.col("l_discount") > 0,
                F.concat(F.lit("PCT"), F.lpad(cents(F.col("l_discount")).cast("string"), 2, "0")),
            ).alias("promo_code"),
            F.when(F.col("l_returnflag") == "R", "RETURN").otherwise("SALE").alias("line_type"),
        )

    @cached_property
    def sales(self) -> DataFrame:
        """Lines with the customer of their receipt."""
        return self.lines.join(self.receipts.select("receipt_id", "customer_id"), "receipt_id")

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("department"),
            F.col("p_type").alias("category"),
            cents(F.col("p_retailprice")).alias("msrp_cents"),
            whole(F.col("p_retailprice") * 90).alias("sale_cents"),
            whole(F.col("p_retailprice") * 60).alias("cost_cents"),
        )

    @cached_property
    def stores(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"),
                F.col("n_name").alias("state"), F.col("r_name").alias("region"),
            )
        )

    @cached_property
    def keyed_events(self) -> DataFrame:
        """Events with the number held in their JSON property bag."""
        return self.table("events").select(
            "event_id", "ts", "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    @cached_property
    def raw(self) -> DataFrame:
        """Events under the column names of the live feed."""
        return self.keyed_events.select(
            "event_id", F.col("ts").alias("ingest_timestamp"),
            F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("trace_id"), "user_id",
            (F.col("user_id") % 10).alias("store_id"), (F.col("user_id") % 5).alias("dc_id"),
            F.col("k").alias("product_id"), "k", "event_type", "value",
        )

    @cached_property
    def touches(self) -> DataFrame:
        return self.keyed_events.where(F.col("event_type").isin("view", "click")).select(
            F.col("user_id").alias("match_key"), F.col("ts").alias("touch_ts"),
            F.col("event_id").alias("impression_id"), F.col("event_type").alias("channel"),
            F.concat(F.lit("CAMP"), (F.col("k") % 10).cast("string")).alias("campaign_id"),
            cents(F.col("value")).alias("cost_cents"),
        )

    @cached_property
    def purchases(self) -> DataFrame:
        return self.keyed_events.where(F.col("event_type") == "purchase").select(
            F.col("user_id").alias("match_key"), F.col("ts").alias("purchase_ts"),
            F.col("event_id").alias("purchase_id"), cents(F.col("value")).alias("total_cents"),
            F.col("k"),
        )

    @cached_property
    def journeys(self) -> dict[str, DataFrame]:
        """Touches, purchases, payments and promotions linked by a journey (user and day).

        Purchases with k % 19 = 3 have no journey; some payments and sums are broken on purpose.
        """
        e = self.keyed_events.withColumn(
            "journey_id", F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
        ).withColumn("gross_cents", cents(F.col("value")) + 1000)
        touches = e.where(F.col("event_type").isin("view", "click")).select(
            "journey_id", F.col("user_id").alias("match_key"), F.col("ts").alias("touch_ts"),
            F.col("event_id").alias("impression_id"),
            F.concat(F.lit("CAMP"), (F.col("k") % 10).cast("string")).alias("campaign_id"),
            F.col("event_type").alias("channel"), cents(F.col("value")).alias("cost_cents"),
            F.when(F.col("k") % 11 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("touch_customer_id"),
        )
        k = F.col("k")
        sold = (
            e.where("event_type = 'purchase'")
            .withColumn("journey_id", F.when(k % 19 != 3, F.col("journey_id")))
            .withColumn("discount_cents", k)
            .withColumn("subtotal_cents", F.col("gross_cents") - k + F.when(k % 17 == 0, 1).otherwise(0))
            .withColumn("tax_cents", F.expr("subtotal_cents * 8 div 100"))
            .withColumn("total_cents", F.col("subtotal_cents") + F.col("tax_cents"))
        )
        purchases = sold.select(
            F.col("event_id").alias("purchase_key"), "journey_id", F.col("user_id").alias("match_key"),
            F.col("user_id").alias("customer_id"), F.col("ts").alias("purchase_ts"), "gross_cents", "discount_cents",
            "subtotal_cents", "tax_cents", "total_cents", (k % 2 == 0).alias("is_store"),
        )
        payments = sold.select(
            F.col("event_id").alias("purchase_key"), "journey_id", F.col("ts").alias("payment_ts"),
            F.col("event_id").alias("transaction_id"),
            F.when(k % 10 == 0, "DECLINED").otherwise("APPROVED").alias("payment_status"),
            (F.col("total_cents") + F.when(k % 13 == 0, 1).otherwise(0)).alias("payment_cents"),
        )
        promotions = sold.where("k > 0").select(
            F.col("event_id").alias("purchase_key"), "journey_id",
            F.when(k % 7 == 0, k - 1).otherwise(k).alias("promo_cents"),
        )
        return {"touches": touches, "purchases": purchases, "payments": payments, "promotions": promotions}

    @cached_property
    def pings(self) -> DataFrame:
        """Events as sensor pings: the event type is the zone, the user carries a tag."""
        return self.table("events").select(
            "event_id", F.col("ts").alias("event_ts"), (F.col("user_id") % 10).alias("store_id"),
            F.concat(F.lit("BLE"), F.col("user_id").cast("string")).alias("customer_ble_id"),
            F.col("user_id").alias("customer_id"), F.col("event_type").alias("zone"),
        )

    @cached_property
    def visitor_hot(self):
        """Hot visitors, counted once for all ordered steps on pings and zone changes."""
        from aisleworks.operators.ordered import find_hot_keys

        return find_hot_keys(self.pings, ["store_id", "customer_ble_id"], "event_ts")

    @cached_property
    def zone_changes(self) -> DataFrame:
        from aisleworks.operators.journey import zone_changes_from_pings

        return zone_changes_from_pings(
            self.pings, ["store_id", "customer_ble_id"], ["event_ts", "event_id"], "zone", hot=self.visitor_hot
        )

    @cached_property
    def inventory_txn(self) -> DataFrame:
        brand = self.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))
        return self.lines.join(brand, "product_id").select(
            "store_id", "brand", "event_ts", "receipt_id", "line_num", "product_id", "gross_cents",
            F.when(F.col("line_type") == "SALE", -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity"),
            F.col("line_type").alias("txn_type"),
        )

    @cached_property
    def shipments(self) -> DataFrame:
        left = self.table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("departed"))
        o, c = self.table("orders"), self.table("customer")
        return (
            o.join(left, o.o_orderkey == left.l_orderkey)
            .join(c, o.o_custkey == c.c_custkey)
            .select(
                F.col("o_orderkey").alias("shipment_id"),
                F.concat(F.lit("TRK"), (F.col("o_custkey") % 100).cast("string")).alias("truck_id"),
                (F.col("c_nationkey") % 5).cast("bigint").alias("dc_id"),
                F.when(F.col("c_nationkey") % 7 != 0, F.col("c_nationkey").cast("bigint")).alias("store_id"),
                F.col("o_orderdate").alias("arrived"), "departed",
            )
        )


VIEW_SQL: dict[str, str] = {
    "v_receipts": """
        SELECT o_orderkey AS receipt_id, o_custkey AS customer_id, o_orderdate AS event_ts,
               CAST(o_orderdate AS DATE) AS event_date, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
               o_orderpriority AS payment_method,
               CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'DECLINED' ELSE 'PENDING' END AS payment_status
        FROM orders""",
    "v_lines": """
        SELECT receipt_id, line_num, product_id, store_id, event_ts, CAST(event_ts AS DATE) AS event_date,
               quantity, unit_cents, gross_cents, ext_cents, gross_cents - ext_cents AS discount_cents,
               CAST(round(ext_cents * tax) AS BIGINT) AS tax_cents, promo_code, line_type
        FROM (SELECT l_orderkey AS receipt_id, l_linenumber AS line_num, l_partkey AS product_id,
                     l_suppkey AS store_id, l_shipdate AS event_ts, CAST(l_quantity AS BIGINT) AS quantity,
                     CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit_cents,
                     CAST(round(l_extendedprice * 100) AS BIGINT) AS gross_cents,
                     CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS ext_cents, l_tax AS tax,
                     CASE WHEN l_discount > 0
                          THEN 'PCT' || lpad(CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR), 2, '0') END AS promo_code,
                     CASE WHEN l_returnflag = 'R' THEN 'RETURN' ELSE 'SALE' END AS line_type
              FROM lineitem)""",
    "v_sales": "SELECT l.*, r.customer_id FROM v_lines l JOIN v_receipts r USING (receipt_id)",
    "v_products": """
        SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS department, p_type AS category,
               CAST(round(p_retailprice * 100) AS BIGINT) AS msrp_cents,
               CAST(round(p_retailprice * 90) AS BIGINT) AS sale_cents,
               CAST(round(p_retailprice * 60) AS BIGINT) AS cost_cents
        FROM part""",
    "v_stores": """
        SELECT s_suppkey AS store_id, s_name AS store_name, n_name AS state, r_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_events": """
        SELECT event_id, ts, user_id, event_type, value,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "v_raw": """
        SELECT event_id, ts AS ingest_timestamp, 'T' || CAST(event_id AS VARCHAR) AS trace_id, user_id,
               user_id % 10 AS store_id, user_id % 5 AS dc_id, k AS product_id, k, event_type, value FROM v_events""",
    "v_touches": """
        SELECT user_id AS match_key, ts AS touch_ts, event_id AS impression_id, event_type AS channel,
               'CAMP' || CAST(k % 10 AS VARCHAR) AS campaign_id, CAST(round(value * 100) AS BIGINT) AS cost_cents
        FROM v_events WHERE event_type IN ('view', 'click')""",
    "v_purchases": """
        SELECT user_id AS match_key, ts AS purchase_ts, event_id AS purchase_id,
               CAST(round(value * 100) AS BIGINT) AS total_cents, k
        FROM v_events WHERE event_type = 'purchase'""",
    "v_journey_touches": """
        SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS journey_id, user_id AS match_key, ts AS touch_ts,
               event_id AS impression_id, 'CAMP' || CAST(k % 10 AS VARCHAR) AS campaign_id, event_type AS channel,
               CAST(round(value * 100) AS BIGINT) AS cost_cents, CASE WHEN k % 11 = 0 THEN user_id + 1 ELSE user_id END AS touch_customer_id
        FROM v_events WHERE event_type IN ('view', 'click')""",
    "v_journey_sold": """
        SELECT *, subtotal_cents + tax_cents AS total_cents FROM (
          SELECT *, subtotal_cents * 8 // 100 AS tax_cents FROM (
            SELECT event_id AS purchase_key, CASE WHEN k % 19 <> 3 THEN CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) END AS journey_id,
                   user_id AS match_key, user_id AS customer_id, ts AS purchase_ts, CAST(round(value * 100) AS BIGINT) + 1000 AS gross_cents,
                   k AS discount_cents, CAST(round(value * 100) AS BIGINT) + 1000 - k + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS subtotal_cents,
                   CASE WHEN k % 2 = 0 THEN 'STORE' ELSE 'ONLINE' END AS purchase_type, k
            FROM v_events WHERE event_type = 'purchase'))""",
    "v_journey_payments": """
        SELECT purchase_key, journey_id, purchase_ts AS payment_ts, CASE WHEN k % 10 = 0 THEN 'DECLINED' ELSE 'APPROVED' END AS payment_status,
               total_cents + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS payment_cents FROM v_journey_sold""",
    "v_journey_promotions": """
        SELECT purchase_key, journey_id, CASE WHEN k % 7 = 0 THEN k - 1 ELSE k END AS promo_cents FROM v_journey_sold WHERE k > 0""",
    "v_labelled": """
        SELECT 'ATTR-' || purchase_type || '-' || CAST(purchase_key AS VARCHAR) AS attribution_id, journey_id, attribution_status,
               'LAST_TOUCH_7D' AS attribution_model, 7 AS attribution_window_days, touch_ts, impression_id, campaign_id, channel, customer_id,
               purchase_ts, lag_seconds, purchase_type, purchase_key, gross_cents, discount_cents, subtotal_cents, tax_cents, total_cents, payment_cents,
               CASE WHEN attribution_status = 'ATTRIBUTED' THEN subtotal_cents ELSE 0 END AS attributed_revenue_cents
        FROM (SELECT *, CASE
            WHEN NOT coalesce(lag_seconds BETWEEN 0 AND 604800, false) THEN 'OUTSIDE_WINDOW'
            WHEN NOT coalesce(payment_status = 'APPROVED' AND payment_cents = total_cents, false) THEN 'RECONCILIATION_FAILED'
            WHEN coalesce(promo_cents, 0) <> discount_cents THEN 'PROMOTION_MISMATCH'
            WHEN NOT (gross_cents - discount_cents = subtotal_cents AND subtotal_cents + tax_cents = total_cents) THEN 'MONEY_MISMATCH'
            ELSE 'ATTRIBUTED' END AS attribution_status
          FROM (SELECT p.*, t.touch_ts, t.impression_id, t.campaign_id, t.channel, y.payment_status, y.payment_cents, o.promo_cents,
                  CAST(floor(epoch_us(p.purchase_ts) / 1000000) - floor(epoch_us(t.touch_ts) / 1000000) AS BIGINT) AS lag_seconds
            FROM (SELECT * FROM v_journey_sold WHERE journey_id IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY journey_id, purchase_type ORDER BY purchase_ts DESC, purchase_key DESC) = 1) p
            LEFT JOIN (SELECT * FROM v_journey_touches QUALIFY row_number() OVER (PARTITION BY journey_id ORDER BY touch_ts DESC, impression_id DESC) = 1) t USING (journey_id)
            LEFT JOIN (SELECT * FROM v_journey_payments WHERE journey_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY journey_id ORDER BY payment_ts DESC, purchase_key DESC) = 1) y USING (journey_id)
            LEFT JOIN (SELECT journey_id, CAST(sum(promo_cents) AS BIGINT) AS promo_cents FROM v_journey_promotions WHERE journey_id IS NOT NULL GROUP BY 1) o USING (journey_id)))""",
    "v_last_touch": """
        SELECT p.match_key, p.purchase_id, p.purchase_ts, p.total_cents, t.touch_ts, t.impression_id, t.campaign_id, t.channel
        FROM v_purchases p JOIN v_touches t ON t.match_key = p.match_key AND t.touch_ts <= p.purchase_ts AND t.touch_ts >= p.purchase_ts - INTERVAL 7 DAY
        QUALIFY row_number() OVER (PARTITION BY p.purchase_id ORDER BY t.touch_ts DESC, t.impression_id DESC) = 1""",
    "v_pings": """
        SELECT event_id, ts AS event_ts, user_id % 10 AS store_id, 'BLE' || CAST(user_id AS VARCHAR) AS customer_ble_id,
               user_id AS customer_id, event_type AS zone FROM events""",
    "v_zone_changes": """
        SELECT * FROM (
          SELECT event_id, event_ts, store_id, customer_ble_id, customer_id,
                 lag(zone) OVER (PARTITION BY store_id, customer_ble_id ORDER BY event_ts, event_id) AS from_zone,
                 zone AS to_zone FROM v_pings)
        WHERE from_zone IS NOT NULL AND from_zone <> to_zone""",
    "v_inventory_txn": """
        SELECT store_id, p_brand AS brand, event_ts, receipt_id, line_num, product_id, gross_cents,
               CASE WHEN line_type = 'SALE' THEN -quantity ELSE quantity END AS quantity, line_type AS txn_type
        FROM v_lines JOIN part ON product_id = p_partkey""",
    "v_shipments": """
        SELECT o_orderkey AS shipment_id, 'TRK' || CAST(o_custkey % 100 AS VARCHAR) AS truck_id,
               CAST(c_nationkey % 5 AS BIGINT) AS dc_id,
               CASE WHEN c_nationkey % 7 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS store_id,
               o_orderdate AS arrived, departed
        FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS departed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
        JOIN customer ON c_custkey = o_custkey""",
}
