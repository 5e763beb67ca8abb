"""Replay safety and late data."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.errors import AnalysisException

from aisleworks.session import scratch_path
from aisleworks.streaming import operators


def test_merge_writer_is_idempotent(spark):
    target = scratch_path(spark, "merge")
    write = operators.merge_writer(target, ["id"])
    first, second = spark.range(5), spark.range(3, 8)
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        write(batch, number)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(8))


def test_merge_writer_raises_other_errors(spark):
    """Only a target that is not there yet is a first batch; one without batch numbers is an error."""
    target = scratch_path(spark, "merge")
    spark.range(5).write.parquet(target)
    with pytest.raises(AnalysisException):
        operators.merge_writer(target, ["id"])(spark.range(3), 1)


def test_quarantine_uses_earlier_batches_only(spark):
    root = scratch_path(spark, "late")
    write = operators.quarantine_writer(root, "ts", delay="1 HOUR")
    at = lambda hour: dt.datetime(2024, 1, 1, hour)
    frame = lambda hours: spark.createDataFrame([(at(h),) for h in hours], "ts timestamp")
    write(frame([1, 10]), 0)
    write(frame([2, 9, 12]), 1)
    write(frame([2, 9, 12]), 1)
    got = {(r["ts"].hour, r["sink"]) for r in spark.read.parquet(f"{root}/rows").collect()}
    assert got == {(1, "main"), (10, "main"), (2, "quarantine"), (9, "main"), (12, "main")}


def test_last_touch_state_over_two_batches():
    none = pd.DataFrame({"at": [], "id": []})
    batch = lambda *rows: pd.DataFrame(rows, columns=["kind", "at", "id"])
    matched, kept = operators.match_last_touch(none, batch(("touch", 10, 1), ("touch", 20, 2), ("purchase", 15, 100)))
    assert matched["impression_id"].tolist() == [1]
    matched, _ = operators.match_last_touch(kept, batch(("purchase", 12, 101), ("purchase", 25, 102)))
    assert dict(zip(matched["purchase_id"], matched["impression_id"])) == {101: 1, 102: 2}


def test_high_water_load_skips_what_it_has_seen(spark):
    source = spark.createDataFrame([(1,), (5,), (9,)], "at bigint")
    fresh, _ = operators.high_water_load(source, "at", 5)
    assert [r["at"] for r in fresh.collect()] == [9]


class Watermarked:
    """A folder that receives one file a batch, and a query that is stopped after every batch."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.root = spark, schema, scratch_path(spark, "batches")
        spark.createDataFrame([], schema).write.parquet(f"{self.root}/in")

    def run(self, build, batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
            feed = self.spark.readStream.schema(self.spark.read.parquet(f"{self.root}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
            started = (
                build(feed).writeStream.outputMode("append").option("checkpointLocation", f"{self.root}/mark").trigger(availableNow=True)
                .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{self.root}/out/batch={i}")).start()
            )
            started.awaitTermination()
            assert started.exception() is None
        return self.spark.read.parquet(f"{self.root}/out").drop("batch")


HOUR = lambda h: dt.datetime(2024, 3, 1) + dt.timedelta(hours=h)
END = HOUR(24 * 365)


def test_touches_after_their_purchase_and_expiry(spark):
    """One batch a run, restarted on the checkpoint each time."""
    rows = [
        [("purchase", 1, HOUR(10), 100), ("touch", 1, HOUR(12), 3), ("purchase", 2, HOUR(1), 200)],
        [("touch", 1, HOUR(9), 1), ("touch", 1, HOUR(8), 2), ("touch", 2, HOUR(1), 7), ("touch", 2, HOUR(1), 5)],
        [("purchase", 1, HOUR(12) + dt.timedelta(days=7), 101), ("purchase", 1, HOUR(13) + dt.timedelta(days=7), 102), ("purchase", 3, HOUR(40), 300)],
        [("touch", -1, END, 0)],
    ]
    def build(feed):
        return operators.last_touch(feed.where("kind = 'touch'"), feed.where("kind = 'purchase'"), delay="2 days")
    got = Watermarked(spark, "kind string, match_key long, ts timestamp, id long").run(build, rows).collect()
    assert {(r.match_key, r.purchase_id, r.impression_id) for r in got} == {(1, 100, 1), (2, 200, 7), (1, 101, 3), (1, 102, None), (3, 300, None)}
    assert len(got) == 5


def test_late_movements_get_their_place(spark):
    rows = [
        [(1, HOUR(5), 50, 4), (1, HOUR(1), 10, -3)],
        [(1, HOUR(3), 30, 2), (2, HOUR(2), 20, 1), (1, HOUR(3), 29, 7)],
        [(1, HOUR(4), 40, -1), (1, HOUR(100), 60, 5)],
        [(-1, END, 0, 0)],
    ]
    def build(feed):
        return operators.running_balance(feed, ["k"], at="ts", tie="id", opening=20, delay="6 hours")
    got = Watermarked(spark, "k long, ts timestamp, id long, quantity long").run(build, rows).where("k > 0").collect()
    want, balance = {}, {1: 20, 2: 20}
    for k, ts, i, q in sorted((r for batch in rows[:-1] for r in batch), key=lambda r: (r[0], r[1], r[2])):
        balance[k] += q
        want[k, i] = (ts, q, balance[k])
    assert {(r.k, r.id): (r.ts, r.quantity, r.balance) for r in got} == want and len(got) == len(want)


def test_stays_over_batches(spark):
    """Breaches, repeats, ties, a truck that never leaves; one batch a run, restarted each time."""
    at = lambda m: HOUR(0) + dt.timedelta(minutes=m)
    rows = [
        [("a", 1, at(200), True), ("b", 2, at(10), False), ("c", 3, at(0), False), ("e", None, at(0), False), (None, 1, at(0), False)],
        [("a", 1, at(0), False), ("a", 9, at(50), False), ("b", 2, at(100), True), ("c", 3, at(90), True), ("d", 4, at(5), True), ("c", 3, None, True)],
        [("a", 1, at(300), False), ("a", 1, at(300), True), ("b", 2, at(100), False), ("b", 2, at(100), True), ("d", 4, at(5), False), ("e", 5, at(2000), True)],
        [("a", 1, at(3000), True), ("b", 2, at(190), True)],
        [("end", -1, END, False)],
    ]
    def build(feed):
        from pyspark.sql import functions as F

        return operators.stay_alerts(feed, "truck", "site", at="ts", leaves=F.col("leaves"), minutes=90, delay="40 hours")
    got = Watermarked(spark, "truck string, site int, ts timestamp, leaves boolean").run(build, rows).collect()
    assert sorted((r.subject, r.site or 0, r.rule, r.raised_at, r.measure) for r in got) == sorted([
        ("a", 1, "overdue", at(90), 90.0), ("a", 1, "dwell_breach", at(200), 200.0),
        ("a", 1, "overdue", at(390), 90.0), ("a", 1, "dwell_breach", at(3000), 2700.0),
        ("d", 4, "overdue", at(95), 90.0), ("e", 0, "overdue", at(90), 90.0), ("e", 0, "dwell_breach", at(2000), 2000.0),
    ])


def many_files(spark):
    """Events in twelve partitions, so that each load is written as twelve files; some have no user."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    n, kinds = F.col("id"), F.array(*map(F.lit, ("view", "click", "purchase", "error")))
    rows = spark.range(600).repartition(12).select(
        n.alias("event_id"), (F.lit(HOUR(0)) + F.make_dt_interval(F.lit(0), n % 97, n % 7)).alias("ts"),
        F.when(n % 11 > 0, n % 23).alias("user_id"), kinds[F.pmod(F.hash("id"), F.lit(4))].alias("event_type"), F.lit(5.0).alias("value"), (n % 9).alias("k"),
    )
    return SimpleNamespace(spark=spark, keyed_events=rows)


@pytest.fixture
def batches(spark, monkeypatch):
    """The tables that streams wrote, as lists of their batch folders."""
    from aisleworks.streaming import runs

    tables, drain = set(), runs.drain
    monkeypatch.setattr(runs, "drain", lambda *a, **kw: tables.add(table := drain(*a, **kw)) or table)
    yield lambda: [[f for f in __import__("os").listdir(t) if f.startswith("batch_id=")] for t in tables]


def test_attribution_batches_do_not_grow_with_files(spark, batches):
    from aisleworks.plans import bound_m_streams

    t = many_files(spark)
    got = {r.purchase_id: (r.match_key, r.impression_id) for r in bound_m_streams.stream_attribution(t).collect()}
    rows = t.keyed_events.collect()
    want = {}
    for p in (r for r in rows if r.event_type == "purchase"):
        touches = [(r.ts, r.event_id) for r in rows if r.event_type in ("view", "click") and r.user_id is not None and r.user_id == p.user_id and p.ts - dt.timedelta(days=7) <= r.ts <= p.ts]
        want[p.event_id] = (p.user_id, max(touches)[1] if touches else None)
    assert got == want
    assert [len(b) <= 2 * (bound_m_streams.PARTS + 1) for b in batches()] == [True]


def test_balances_of_rows_without_store_and_batches(spark, batches):
    from aisleworks.plans import bound_m_streams

    t = many_files(spark)
    got = {r.event_id: (r.store_id, r.balance) for r in bound_m_streams.stream_running_balance(t).collect()}
    balance, want = {}, {}
    for r in sorted(t.keyed_events.collect(), key=lambda r: (r.ts, r.event_id)):
        store = None if r.user_id is None else r.user_id % 10
        balance[store] = balance.get(store, 20) + (-(r.k % 5) if r.event_type == "purchase" else r.k % 3)
        want[r.event_id] = (store, balance[store])
    assert got == want
    assert [len(b) <= 2 * (bound_m_streams.PARTS + 1) for b in batches()] == [True]


def test_alert_batches_do_not_grow_with_files(spark, batches):
    from aisleworks.plans import bound_m_streams

    t = many_files(spark)
    got = [r for r in bound_m_streams.stream_alerts(t).collect() if r.rule == "stockout"]
    assert sorted(r.subject for r in got) == sorted(str(r.event_id) for r in t.keyed_events.collect() if r.event_type == "error")
    assert [len(b) <= 2 * (bound_m_streams.PARTS + 1) for b in batches()] == [True]
