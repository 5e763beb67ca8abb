"""Edge cases on hand-built frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aisleworks.ml import features
from aisleworks.operators import attribution, evaluation, pricing, quality, ranges
from aisleworks.operators.ordered import find_hot_keys, ordered
from aisleworks.sources import envelope, files, publish
from aisleworks.session import scratch_path

DAY = dt.datetime(2024, 1, 10, 12)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("hot", [False, True])
def test_ordered_columns_match_python(spark, hot, request):
    if hot:
        request.getfixturevalue("hot_keys")
    data = [(k, t, t * 7 % 5) for k in ("a", "b") for t in range(40 if k == "a" else 2)]
    df = spark.createDataFrame(data, "k string, t bigint, v bigint").repartition(7)
    assert (find_hot_keys(df, ["k"], "t").spans is not None) == hot
    v = F.col("v")
    out = ordered(df, ["k"], ["t"], running={"s": v}, previous={"p": v}, following={"n": v}, latest={"l": F.when(v > 2, v)})
    want = []
    for key in ("a", "b"):
        values = [x for k, _, x in data if k == key]
        last = None
        for i, x in enumerate(values):
            last = x if x > 2 else last
            want.append((key, i, x, sum(values[: i + 1]), values[i - 1] if i else None, values[i + 1] if i + 1 < len(values) else None, last))
    assert rows(out.select("k", "t", "v", "s", "p", "n", "l"), "k", "t") == want


def last_touch(spark, touches, purchases):
    t = spark.createDataFrame(touches, "k string, touch_ts timestamp, tid bigint")
    p = spark.createDataFrame(purchases, "k string, at timestamp, pid bigint")
    found = ranges.asof_last(p, t, key="k", at="at", touch_at="touch_ts", touch_id="tid", purchase_id="pid")
    return ranges.within_tolerance(found, at="at", touch_at="touch_ts", matched_columns=["touch_ts", "tid"], seconds=7 * 86400)


def test_last_touch_edges(spark):
    h = lambda n: DAY + dt.timedelta(hours=n)
    touches = [("tie", h(-1), 3), ("tie", h(-1), 9), ("newer", h(-5), 1), ("newer", h(-2), 2), ("after", h(1), 4), ("old", h(-7 * 24) - dt.timedelta(seconds=1), 5), ("edge", h(-7 * 24), 6), ("same", h(0), 7)]
    purchases = [(k, h(0), i) for i, k in enumerate(["tie", "newer", "after", "old", "edge", "same", "none"])]
    got = {r["k"]: r["tid"] for r in last_touch(spark, touches, purchases).collect()}
    assert got == {"tie": 9, "newer": 2, "after": None, "old": None, "edge": 6, "same": 7, "none": None}


def test_global_rank_spans_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    out = ranges.global_rank(df, [F.desc("v"), F.asc("id")], partitions=6)
    want = sorted(((r, i % 7) for r, i in enumerate(range(500))), key=lambda x: (-x[1], x[0]))
    assert [r[0] for r in rows(out.select("id", "rank"), "rank")] == [i for i, _ in want]


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), (F.col("id") % 11).alias("v"))
    runs = [rows(ordered(df.repartition(n), ["k"], ["t"], running={"s": F.col("v")}), "k", "t") for n in (1, 64)]
    assert runs[0] == runs[1]


def test_merge_rejects_conflicts_and_nulls(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "id int, v string")
    assert rows(files.insert_only_merge(new, old, ["id"]), "id") == [(2, "c")]
    with pytest.raises(ValueError, match="share a dedupe key"):
        files.insert_only_merge(new.union(spark.createDataFrame([(2, "d")], new.schema)), old, ["id"])
    with pytest.raises(ValueError, match="NULL"):
        files.insert_only_merge(spark.createDataFrame([(None, "x")], new.schema), old, ["id"])
    with pytest.raises(ValueError, match="missing"):
        files.insert_only_merge(new, old, ["nope"])


def test_resolve_column_names_what_exists(spark):
    df = spark.createDataFrame([(1,)], "StoreID int")
    assert files.resolve_column(df, "store_id", "storeid") == "StoreID"
    with pytest.raises(ValueError, match="StoreID"):
        files.resolve_column(df, "absent")


def test_compaction_keeps_rows_and_splits_a_hot_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("c"), "id")
    path = scratch_path(spark, "compact")
    assert files.compact_clustered(df, path, ["c"], rows_per_file=100, spread=["id"]) == 10
    back = spark.read.parquet(path)
    assert files.multiset_difference(df, back).isEmpty()
    hot = back.where("c = 1").select(F.col("_metadata.file_path").alias("f")).distinct().count()
    assert hot >= 5


@pytest.mark.parametrize("fault", [("stage", "b"), ("validate", "b"), ("promote", "a,b")])
def test_failed_publication_keeps_the_old_version(spark, fault):
    root = scratch_path(spark, "publish")
    one, two = spark.range(3), spark.range(5)
    publish.publish(spark, root, "r1", {"a": one, "b": one})

    def boom(step, table):
        if (step, table) == fault:
            raise OSError("injected")

    with pytest.raises(publish.PublicationError):
        publish.publish(spark, root, "r2", {"a": two, "b": two}, on_step=boom)
    assert [publish.current(spark, root, n).count() for n in "ab"] == [3, 3]
    states = {(r["run_id"], r["status"]) for r in publish.read_log(spark, root).collect()}
    assert states == {("r1", "PROMOTED"), ("r2", "FAILED")}
    publish.publish(spark, root, "r3", {"a": two, "b": two})
    assert publish.current(spark, root, "a").count() == 5


def test_publication_checks_the_contract(spark):
    root = scratch_path(spark, "publish")
    with pytest.raises(publish.PublicationError, match="schema"):
        publish.publish(spark, root, "r1", {"a": spark.range(3)}, contracts={"a": spark.createDataFrame([], "id string").schema})


def test_strict_routing_raises(spark):
    df = spark.createDataFrame([("view",), ("odd",)], "event_type string")
    with pytest.raises(ValueError):
        envelope.write_routed(df, scratch_path(spark, "route"), ["view"], strict=True)


def test_output_contract(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, v string")
    assert quality.validate_output(df, [("v", "string", True), ("id", "bigint", False)]).columns == ["v", "id"]
    with pytest.raises(quality.ContractError, match="NULL"):
        quality.validate_output(df, [("v", "string", False), ("id", "bigint", False)])
    with pytest.raises(quality.ContractError, match="missing"):
        quality.validate_output(df, [("w", "string", True), ("id", "bigint", False), ("v", "string", True)])


def test_two_purchases_on_one_journey_fail(spark):
    cols = "purchase_key bigint, journey_id string, customer_id bigint, purchase_ts timestamp, gross_cents bigint, discount_cents bigint, subtotal_cents bigint, tax_cents bigint, total_cents bigint, purchase_type string"
    bought = spark.createDataFrame([(i, "j", 1, DAY, 10, 0, 10, 1, 11, "STORE") for i in (1, 2)], cols)
    with pytest.raises(ValueError, match="share one"):
        attribution.by_journey_strict(bought, None, None, None)


def test_never_sold_product_gets_no_age_markdown(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 10.0, 8.0, None, 0, None, 0.0, None, None)],
        "product_id int, cost double, msrp double, sale_price double, tags string, total_inventory bigint, days_since_last_receipt int, avg_daily_sales double, previous_price double, previous_change_date date",
    ).withColumns({c: F.lit(None).cast("double") for c in ("elasticity_coefficient", "confidence_interval_lower", "confidence_interval_upper", "standard_error")})
    df = df.withColumns({"n_observations": F.lit(None).cast("bigint"), "elasticity_evidence_status": F.lit(None).cast("string"), "analysis_design": F.lit(None).cast("string")})
    out = pricing.recommend(df, pricing.PricingRules(), as_of=F.lit(dt.date(2024, 6, 1))).first()
    assert out["markdown_factor"] == 0.0 and "AGE" not in out["reason_codes"]


def test_chronological_split_has_an_embargo(spark):
    df = spark.range(100).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("d"))
    a, b = evaluation.split_cutoffs(df, "d", train=0.6, calibration=0.2)
    out = evaluation.assign_chronological_split(df, "d", train_until=a, calibration_until=b, embargo_days=5)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 60, "embargo": 10, "calibration": 15, "test": 15}


def test_churn_rows_hold_lapsed_customers(spark):
    day = dt.date(2024, 1, 1)
    sales = spark.createDataFrame(
        [(1, day, 500, "a"), (2, day, 100, "a"), (2, day + dt.timedelta(260), 300, "b"), (4, day + dt.timedelta(360), 50, "a")],
        "customer_id long, event_date date, cents long, category string",
    )
    customers = spark.createDataFrame([(1,), (2,), (3,)], "customer_id long")
    first, last = F.lit(day + dt.timedelta(180)), F.lit(day + dt.timedelta(360))
    got = {
        (r.customer_id, (r.snapshot_date - day).days): (r.purchases, r.spend_cents, r.recency_days, r.avg_basket_cents)
        for r in features.churn_rows(customers, sales, first=first, last=last, every=90, behind=180).collect()
    }
    assert got == {
        (1, 180): (1, 500, 180, 500.0), (1, 270): (0, 0, 270, 0.0), (1, 360): (0, 0, 360, 0.0),
        (2, 180): (1, 100, 180, 100.0), (2, 270): (1, 300, 10, 300.0), (2, 360): (1, 300, 100, 300.0),
        (3, 180): (0, 0, 181, 0.0), (3, 270): (0, 0, 271, 0.0), (3, 360): (0, 0, 361, 0.0),
        (4, 180): (0, 0, 181, 0.0), (4, 270): (0, 0, 271, 0.0), (4, 360): (0, 0, 361, 0.0),
    }


def test_purchases_that_share_a_journey_are_reported(spark):
    from aisleworks.operators import attribution

    day = dt.datetime(2024, 3, 2)
    sold = spark.createDataFrame(
        [(1, "A", 5, day, 100, 0, 100, 0, 100), (2, "B", 5, day, 70, 0, 70, 0, 70), (3, "B", 5, day, 30, 0, 30, 0, 30), (4, None, 5, day, 9, 0, 9, 0, 9)],
        "purchase_key long, journey_id string, customer_id long, purchase_ts timestamp, gross_cents long, discount_cents long, subtotal_cents long, tax_cents long, total_cents long",
    ).selectExpr("*", "'STORE' AS purchase_type")
    touches = spark.createDataFrame([(j, i, "C", "x", 5, day - dt.timedelta(days=1)) for i, j in enumerate("AB")], "journey_id string, impression_id long, campaign_id string, channel string, touch_customer_id long, touch_ts timestamp")
    payments = sold.selectExpr("purchase_key", "journey_id", "'APPROVED' AS payment_status", "total_cents AS payment_cents", "purchase_ts AS payment_ts", "purchase_key AS transaction_id")
    promotions = spark.createDataFrame([], "journey_id string, purchase_key long, promo_cents long")
    with pytest.raises(ValueError):
        attribution.by_journey_strict(sold, touches, payments, promotions)
    got = attribution.by_journey_strict(sold, touches, payments, promotions, report_shared=True).collect()
    shared = "UNATTRIBUTED_SHARED_JOURNEY"
    assert {r.purchase_key: (r.attribution_status, r.attributed_revenue_cents) for r in got} == {
        1: ("ATTRIBUTED", 100), 2: (shared, 0), 3: (shared, 0), 4: ("UNATTRIBUTED_NO_JOURNEY", 0),
    }


def test_segment_labels_by_thirds(spark):
    from aisleworks.ml import models

    rows = [(0, 5, 90 + i, 900) for i in range(30)] + [(1, 100, 40 + i % 9, 400) for i in range(40)] + [(2, 300, 1, 5) for _ in range(40)] + [(3, 5, 1, 5) for _ in range(5)]
    df = spark.createDataFrame(rows, "cluster_id int, recency int, frequency int, monetary int")
    got = models.segment_labels(df, recency="recency", frequency="frequency", monetary="monetary")
    assert {(r.cluster_id, r.segment_label) for r in got.collect()} == {(0, "Champions"), (1, "Potential Loyalists"), (2, "Lost"), (3, "New Customers")}
    assert got.count() == len(rows)


def test_dwell_prediction_boosts_for_all_rounds(spark, monkeypatch):
    """The surveyed job fits 120 trees; every open stay gets a prediction within its bounds."""
    import __spark_entry__ as entry
    from aisleworks.ml import models
    from aisleworks.sources.fixtures import Tables

    trees = []

    class Recorded(models.Pipeline):
        def fit(self, dataset):
            fitted = super().fit(dataset)
            trees.append(fitted.stages[-1].getNumTrees)
            return fitted

    monkeypatch.setattr(models, "Pipeline", Recorded)
    folder = "/root/testdata/sf0.001"
    got = entry.queries()["dwell_prediction"](spark, folder).collect()
    assert trees == [120] and spark.sparkContext.getCheckpointDir()
    still_open = Tables(spark, folder).shipments.where("departed <= arrived").collect()
    assert sorted(r.shipment_id for r in got) == sorted(r.shipment_id for r in still_open)
    assert all(0 <= r.lower_bound <= r.predicted_dwell <= r.upper_bound for r in got)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_baseline_windows_unroll_no_calendar(spark):
    """The days around an episode come from range frames: nothing is exploded, lines are shuffled a few times."""
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["calendar_window_sales"](spark, "/root/testdata/sf0.001"))
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") <= 8


def test_promotion_lift_sends_no_probes(spark):
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["promotion_lift"](spark, "/root/testdata/sf0.001"))
    assert "Generate" not in plan and "_row" not in plan and plan.count("Exchange hashpartitioning") <= 8


def test_stockout_risk_counts_grains_without_expanding_rows(spark):
    from pyspark.sql import functions as F

    from aisleworks.operators import kpi

    rows = [(1, 1, 3, "HIGH", 0.9, 2.0, 1.0), (1, 1, 3, "LOW", 0.3, 4.0, None), (1, 2, 3, "LOW", 0.1, 6.0, 3.0), (None, 2, 3, "HIGH", 0.7, 8.0, 5.0), (None, 2, 3, "HIGH", 0.7, 8.0, 5.0)]
    df = spark.createDataFrame(rows, "store_id int, product_id int, forecast_horizon_days int, risk_level string, stockout_probability double, days_of_inventory double, demand_velocity_daily double")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    out = kpi.stockout_risk(df.withColumn("inventory_as_of", at), at)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    (got,) = out.collect()
    assert (got.risk_sku_count, got.high_risk_skus, got.avg_stockout_probability, got.avg_days_of_inventory, got.avg_demand_velocity) == (3, 2, 0.54, 5.6, 3.5)


def test_dealt_rows_bound_what_a_task_groups(spark, monkeypatch):
    from aisleworks.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 10)
    df = ordered.dealt(spark.range(500).selectExpr("id % 400 AS k", "id"), ["k"])
    assert df.rdd.getNumPartitions() == 50
    assert sorted(r["n"] for r in df.groupBy("k").agg({"id": "count"}).toDF("k", "n").collect()) == [1] * 300 + [2] * 100


def test_forecast_keys_are_grouped_on_tasks_by_rows(spark, monkeypatch):
    import datetime as dt

    from aisleworks.operators import ordered, quality

    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 10)
    day = dt.date(2024, 1, 1)
    rows = [(k, day + dt.timedelta(days=s), day, day, 14, 1.0, 0.5, 2.0, 0.1) for k in range(20) for s in range(1, 15) if (k, s) != (3, 7)]
    df = spark.createDataFrame(rows, "k int, forecast_date date, source_as_of date, generated_at date, forecast_horizon_days int, predicted_units double, lower_bound double, upper_bound double, mape double")
    out = quality.forecast_checks(df, ["k"])
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["check"]: r["violations"] for r in out.collect() if r["violations"]} == {"incomplete horizon": 1}
