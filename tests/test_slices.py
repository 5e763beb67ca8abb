"""Slices of hot keys by quantiles of the whole order, prior history in one pass."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from aisleworks.operators import ranges
from aisleworks.operators.ordered import HOT, SLICE, find_hot_keys, ordered
from aisleworks.session import HOT_KEY_ROWS

LIMIT = 100
SHAPES = {
    "ten seconds and one outlier": lambda i: 1_700_000_000_000_000 + i * 1000 if i else 0,
    "one instant": lambda i: 1_700_000_000_000_000,
    "even": lambda i: i * 1_000_000,
}


@pytest.fixture
def small_slices(spark):
    spark.conf.set(HOT_KEY_ROWS, str(LIMIT))
    yield
    spark.conf.unset(HOT_KEY_ROWS)


def steps(df, hot):
    v = F.col("v")
    return ordered(
        df, ["k"], ["at", "id"], running={"s": v}, previous={"p": v}, following={"n": v}, latest={"l": F.when(v % 7 == 0, v)}, hot=hot, keep_slices=hot.spans is not None
    )


@pytest.mark.parametrize("shape", SHAPES)
def test_no_slice_is_large_and_results_are_those_of_the_plain_window(spark, small_slices, shape):
    rows = [("hot", SHAPES[shape](i), i, i * 31 % 101) for i in range(10_000)] + [(f"cold{i % 50}", i, i, i) for i in range(500)] + [(None, i, i, i) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, at bigint, id bigint, v bigint").repartition(8)
    hot = find_hot_keys(df, ["k"])
    assert sorted(str(r[0]) for r in hot.spans.collect()) == ["None", "hot"] and hot.rows == 10_150
    sliced = steps(df, hot).cache()
    sizes = [r["count"] for r in sliced.where(HOT).groupBy("k", SLICE).count().collect()]
    assert max(sizes) <= 4 * LIMIT and len(sizes) >= 100
    spark.conf.unset(HOT_KEY_ROWS)
    plain = steps(df, find_hot_keys(df, ["k"]))
    assert sliced.drop(SLICE, HOT).exceptAll(plain).isEmpty() and sliced.count() == plain.count()
    sliced.unpersist()


def test_chained_steps_keep_their_slices(spark, small_slices):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"), F.col("id"), (F.col("id") % 11).alias("v"))
    hot = find_hot_keys(df, ["k"])
    one = ordered(df, ["k"], ["at", "id"], previous={"p": F.col("v")}, hot=hot, keep_slices=True)
    two = ordered(one, ["k"], ["at", "id"], running={"s": F.coalesce(F.col("p"), F.lit(0))}, hot=hot)
    seen = {0: [0], 1: [0]}
    for i in range(3000):
        seen[i % 2].append(i % 11)
    got = {(r.k, r.at): r.s for r in two.collect()}
    for k in (0, 1):
        total = 0
        for j, at in enumerate(range(k, 3000, 2)):
            total += seen[k][j]
            assert got[k, at] == total


def history_case(seed, n=400):
    rnd = random.Random(seed)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.choice([0, 0, 0, rnd.randrange(1000)]))
    target = [(i, rnd.choice([at(), at(), None]), rnd.choice("ab"), rnd.randrange(3)) for i in range(n)]
    past = [(rnd.choice([at(), at(), None]), rnd.choice("abc"), rnd.randrange(3), rnd.choice([None, 1, 5])) for _ in range(n)]
    return target, past


@pytest.mark.parametrize("limit", [3, 50, 100_000])
def test_prior_history_as_brute_force(spark, limit):
    spark.conf.set(HOT_KEY_ROWS, str(limit))
    try:
        target, past = history_case(limit)
        got = ranges.prior_history(
            spark.createDataFrame(target, "id int, at timestamp, g string, h int"), spark.createDataFrame(past, "since timestamp, g string, h int, v long"),
            target_at="at", history_at="since", value="v", groups={"all": [], "g": ["g"], "gh": ["g", "h"]},
        ).collect()
    finally:
        spark.conf.unset(HOT_KEY_ROWS)
    want = {}
    for i, at, g, h in target:
        before = [(x, y, v) for since, x, y, v in past if since is not None and at is not None and since < at and v is not None]
        parts = before, [b for b in before if b[0] == g], [b for b in before if b[:2] == (g, h)]
        want[i] = tuple(x for p in parts for x in (len(p), sum(b[2] for b in p)))
    assert {r.id: (r.all_count, r.all_sum, r.g_count, r.g_sum, r.gh_count, r.gh_sum) for r in got} == want


def test_prior_history_on_empty_sides(spark):
    target, past = history_case(1, 20)
    t, h = spark.createDataFrame(target, "id int, at timestamp, g string, h int"), spark.createDataFrame(past, "since timestamp, g string, h int, v long")
    settings = dict(target_at="at", history_at="since", value="v", groups={"all": [], "g": ["g"]})
    assert ranges.prior_history(t.limit(0), h, **settings).isEmpty()
    assert {(r.all_count, r.g_sum) for r in ranges.prior_history(t, h.limit(0), **settings).collect()} == {(0, 0)}


def test_dwell_history_orders_each_time_and_site_once(spark):
    """Equal arrivals share one row of the ordered pass; open stays, null sites and null times count as before."""
    from aisleworks.ml import features

    day = lambda d: None if d is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    draw = random.Random(3)
    stays = [(i, draw.choice([*range(12), None]), draw.choice([*range(4, 16), None]), draw.choice(["a", "b", None])) for i in range(400)]
    rows = [(i, day(a), day(d), s, None if a is None else a % 7, None if None in (a, d) else (d - a) * 10) for i, a, d, s in stays]
    df = spark.createDataFrame(rows, "shipment_id long, arrived timestamp, departed timestamp, site string, weekday int, dwell_minutes long")
    found = features.dwell_features(df, df.where("departed > arrived"))
    (folder,) = {f.rsplit("/", 1)[0] for f in found.inputFiles() if "/dwell-history-" in f}
    assert spark.read.parquet(folder).count() == len({r[1:2] + r[3:5] for r in rows})
    done = [r for r in rows if None not in (r[1], r[2]) and r[2] > r[1]]
    for r in (got := found.collect()):
        past = [h for h in done if r.arrived is not None and h[2] < r.arrived]
        for p, own in (("all", past), ("site", [h for h in past if h[3] == r.site]), ("weekday", [h for h in past if h[4] == r.weekday])):
            total = sum(h[5] for h in own)
            assert (r[f"{p}_count"], r[f"{p}_sum"], r[f"{p}_mean"]) == (len(own), total, total / len(own) if own else None)
    assert sorted(r.shipment_id for r in got) == list(range(400))


@pytest.mark.parametrize("hot", [False, True])
def test_open_span_as_all_pairs(spark, hot):
    """One visitor has all receipts in one hour; sessions end between, next to and on receipts."""
    if hot:
        spark.conf.set(HOT_KEY_ROWS, str(LIMIT))
    draw = random.Random(5)
    base = dt.datetime(2024, 3, 1, 9)
    at = lambda s: base + dt.timedelta(seconds=s)
    spans = [(1, 7, f"s{i}", at(i * 12), at(i * 12 + draw.randrange(8))) for i in range(300)]
    spans += [(s, c, f"s{s}-{c}-{i}", at(i * 900), at(i * 900 + 300)) for s in (1, 2) for c in (8, 9) for i in range(5)] + [(None, 7, "none", at(0), at(9))]
    points = [(1, 7, i, at(draw.randrange(3600))) for i in range(2000)]
    points += [(s, c, 10_000 + 1000 * s + 100 * c + i, at(draw.randrange(5000))) for s in (1, 2) for c in (8, 9) for i in range(50)] + [(None, 7, 99_999, at(3)), (3, 3, 99_998, at(3))]
    a = spark.createDataFrame(points, "store long, customer long, receipt long, at timestamp").repartition(7)
    b = spark.createDataFrame(spans, "store long, customer long, session string, started timestamp, ended timestamp").repartition(5)
    found = ranges.open_span(a, b, keys=["store", "customer"], at="at", start="started", end="ended", span_id="session", point_id="receipt", grace_seconds=2)
    got = {r.receipt: r.session for r in found.collect()}
    spark.conf.unset(HOT_KEY_ROWS)
    want = {}
    for store, customer, receipt, when in points:
        open_now = [(e >= when, -abs((when - e).total_seconds()), s, k) for st, c, k, s, e in spans if (st, c) == (store, customer) and store is not None and s <= when <= e + dt.timedelta(seconds=2)]
        if open_now:
            want[receipt] = max(open_now)[3]
    assert got == want and len(want) > 1000
    assert ranges.open_span(a.limit(0), b, keys=["store", "customer"], at="at", start="started", end="ended", span_id="session", point_id="receipt").count() == 0
