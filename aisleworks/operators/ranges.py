"""As-of, interval and look-back joins without pair blow-ups, and rankings over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.operators.ordered import SLICE, find_hot_keys, in_slices, ordered
from aisleworks.session import checkpointed, hot_key_rows

DAY_SECONDS = 86_400


def lag_seconds(later: str, earlier: str) -> Column:
    return F.unix_seconds(later) - F.unix_seconds(earlier)


def asof_last(
    purchases: DataFrame, touches: DataFrame, *, key: str, at: str, touch_at: str, touch_id: str,
    carry: Sequence[str] = (), purchase_id: str, until: str | None = None,
) -> DataFrame:
    """Each purchase with the latest touch at or before it (ties: the largest touch id).

    Both sides are unioned and ordered once per key; no touch-purchase pairs are formed.
    Purchases without an earlier touch keep NULLs. Touch times come back as ``touch_at``. With
    ``until``, a carried column of unix seconds, only purchases up to then are returned.
    """
    touch = F.struct(F.col(touch_at).alias(touch_at), F.col(touch_id).alias(touch_id), *carry)
    left = touches.select(
        F.col(key).alias("_key"), F.col(touch_at).alias("_t"), F.lit(0).alias("_kind"),
        F.col(touch_id).cast("string").alias("_tie"), F.col(touch_id).alias("_id"), touch.alias("_touch"),
    )
    right = purchases.select(
        F.col(key).alias("_key"), F.col(at).alias("_t"), F.lit(1).alias("_kind"),
        F.col(purchase_id).cast("string").alias("_tie"), F.struct(*purchases.columns).alias("_row"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    seen = ordered(both, ["_key"], ["_t", "_kind", "_id", "_tie"], latest={"_last": F.when(F.col("_kind") == 0, F.col("_touch"))})
    if until:  # on the union's own time: Spark 4.1 loses fields of _row that a condition reads through the slices
        seen = seen.where(F.unix_seconds("_t") <= F.col(f"_last.{until}"))
    return seen.where("_kind = 1").select(
        "_row.*", *[F.col(f"_last.{c}").alias(c) for c in (touch_at, touch_id, *carry)]
    )


def within_tolerance(matched: DataFrame, *, at: str, touch_at: str, matched_columns: Sequence[str], seconds: int) -> DataFrame:
    """Drop matches older than the tolerance; the boundary itself still counts."""
    fresh = F.unix_micros(at) - F.unix_micros(touch_at) <= seconds * 1_000_000
    return matched.select(
        *[F.when(fresh, F.col(c)).alias(c) if c in matched_columns else F.col(c) for c in matched.columns]
    )


def explode_snapshots(
    df: DataFrame, date: str, first: Column, last: Column, *, every: int, behind: int, ahead: int = 0, out: str = "snapshot_date"
) -> DataFrame:
    """Give every dated row the snapshots whose window holds it.

    Snapshots lie every ``every`` days from ``first`` to ``last``. A row belongs to snapshot
    ``s`` when ``s - behind <= date < s`` (look-back, ``ahead == 0``) or, with ``ahead``,
    when ``s <= date < s + ahead``. The copies per row are bounded by the window length
    over ``every``, whatever the key distribution, and group-by afterwards combines
    map-side, so no key-by-key join is needed.
    """
    base, end = F.unix_date(first), F.unix_date(last)
    day = F.unix_date(date)
    if ahead:
        low, high = day - (ahead - 1), day
    else:
        low, high = day + 1, day + behind
    step_low = F.greatest(F.lit(0), F.ceil((low - base) / F.lit(every)).cast("int"))
    step_high = F.floor((F.least(high, end) - base) / F.lit(every)).cast("int")
    steps = F.when(step_high >= step_low, F.sequence(step_low, step_high)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("_step", F.explode(steps)).withColumn(
        out, F.date_from_unix_date(base + F.col("_step") * every)
    ).drop("_step")


def snapshot_grid(entities: DataFrame, first: Column, last: Column, *, every: int, out: str = "snapshot_date") -> DataFrame:
    """Every entity at every snapshot date."""
    return entities.withColumn(out, F.explode(F.sequence(first, last, F.make_dt_interval(F.lit(every)))))


def open_span(
    points: DataFrame, spans: DataFrame, *, keys: Sequence[str], at: str, start: str, end: str, span_id: str, point_id: str, grace_seconds: int = 0,
) -> DataFrame:
    """Each point with the span of the same keys that is open then, or ended at most ``grace_seconds`` before.

    Starts, ends and points go by in one ordered union that carries the last span begun, so no
    pairs are formed and a hot key is cut into slices wherever its rows lie. The spans of one key
    must not overlap (sessions do not): the last one begun is then the one that holds the point,
    or else the one that ended last. All times count in whole seconds. Points without a span, and
    rows with a null key, are left out.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    place = F.struct(*keys)
    second = F.date_trunc("second", start).cast(spans.schema[start].dataType)
    begun = spans.where(known).select(place.alias("_place"), second.alias("_start"), (F.unix_seconds(end) + grace_seconds).alias("_until"), *[c for c in spans.columns if c not in keys])
    found = asof_last(
        points.where(known).withColumn("_place", place), begun, key="_place", at=at, touch_at="_start", touch_id=span_id, purchase_id=point_id,
        carry=["_until", *[c for c in spans.columns if c not in (*keys, span_id)]], until="_until",
    )
    return found.drop("_place", "_start", "_until")


def prior_history(
    targets: DataFrame, history: DataFrame, *, target_at: str, history_at: str, value: str,
    groups: dict[str, Sequence[str]], count: str | None = None,
) -> DataFrame:
    """Per target the count and sum of ``value`` over history strictly before it.

    ``count`` names the number of rows that a history row stands for, where rows were summed up.

    ``groups`` maps an output prefix to the columns both sides must share (none for the
    global history; NULL group values pair with each other). The union of both sides is sorted
    by time once and cut into slices of at most ``spark.aisleworks.hotKeyRows`` rows, whatever
    the keys and however many rows fall on one instant. History is pre-summed per (slice, group)
    and summed up over the slices before; those sums stand as first rows in their slice, where
    one window per grain resolves the rest exactly. All grains share the sorted table and one
    exchange by slice. History without a time counts for nobody, targets without one have none.
    """
    shared = sorted({c for cols in groups.values() for c in cols})
    each = F.when(F.col(value).isNotNull(), F.col(count) if count else F.lit(1)).cast("bigint")
    both = targets.select(
        F.col(target_at).alias("_t"), F.lit(0).alias("_kind"), *shared, F.struct(*targets.columns).alias("_row")
    ).unionByName(
        history.where(F.col(history_at).isNotNull()).select(F.col(history_at).alias("_t"), F.lit(1).alias("_kind"), *shared, F.col(value).alias("_v"), each.alias("_c")),
        allowMissingColumns=True,
    )
    rows = in_slices(both, ["_t", "_kind"], hot_key_rows(targets.sparkSession))
    body = rows
    for prefix, cols in groups.items():
        sums = rows.groupBy(SLICE, *cols).agg(F.sum("_c").alias("_n"), F.sum("_v").alias("_s"))
        before = Window.partitionBy(*cols).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        body = body.unionByName(
            sums.select(SLICE, F.lit(-1).alias("_kind"), *cols, F.sum("_n").over(before).alias(f"_n_{prefix}"), F.sum("_s").over(before).alias(f"_s_{prefix}")),
            allowMissingColumns=True,
        )
    body = body.repartition(SLICE)
    zero = F.lit(0).cast("bigint")
    added = []
    for prefix, cols in groups.items():
        w = Window.partitionBy(SLICE, *cols).orderBy(F.col("_kind") >= 0, "_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added += [
            F.sum(F.coalesce(f"_n_{prefix}", "_c", zero)).over(w).alias(f"{prefix}_count"),
            F.sum(F.coalesce(f"_s_{prefix}", "_v", zero)).over(w).alias(f"{prefix}_sum"),
        ]
    return body.select("_kind", "_row", *added).where("_kind = 0").select("_row.*", *[f"{p}_{s}" for p in groups for s in ("count", "sum")])


def global_rank(df: DataFrame, order: Sequence[Column], *, partitions: int | None = None, out: str = "rank") -> DataFrame:
    """1-based rank of every row in the whole table, without a one-task window.

    The rows are range-partitioned on a total order and the partition number is fixed by a
    reliable checkpoint, so counts and ranks see the same ranges even when an executor is
    lost in between. The broadcast side has one row per range.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(
        df.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id())
    )
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select(
        F.col("_range").alias("_r"),
        F.coalesce(
            F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_rn", inner)
        .join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
        .withColumn(out, F.col("_offset") + F.col("_rn"))
        .drop("_range", "_r", "_offset", "_rn")
    )


def nearest_site(places: DataFrame, sites: DataFrame, *, levels: Sequence[str], site_id: str) -> DataFrame:
    """The site sharing the finest level with each place (ties: lowest id), else the lowest id of all.

    Same answer as scoring all pairs, from one minimum per level.
    """
    out = places
    for level in levels:
        best = sites.groupBy(level).agg(F.min(site_id).alias(f"_{level}"))
        out = out.join(best, level, "left")
    anywhere = sites.agg(F.min(site_id)).scalar()
    out = out.withColumn(site_id, F.coalesce(*[F.col(f"_{level}") for level in levels], anywhere))
    return out.drop(*[f"_{level}" for level in levels])


def hierarchical_lookup(
    rows: DataFrame, rates: DataFrame, *, levels: Sequence[Sequence[str]], value: str, default: float, out: str = "rate"
) -> DataFrame:
    """Exact rate, else the average of the next coarser level that has one, else the default.

    ``levels`` run from fine to coarse; averages are taken over the distinct rate rows.
    """
    result = rows
    for i, cols in enumerate(levels):
        level = rates.groupBy(*cols).agg((F.sum(value) / F.count(value)).alias(f"_rate{i}"))
        result = result.join(level, list(cols), "left")
    found = [F.col(f"_rate{i}") for i in range(len(levels))]
    matched = F.when(found[0].isNotNull(), 0)
    for i, c in enumerate(found[1:], start=1):
        matched = matched.when(c.isNotNull(), i)
    return result.withColumn(out, F.coalesce(*found, F.lit(default))).withColumn("match_level", matched).drop(
        *[f"_rate{i}" for i in range(len(levels))]
    )


def slot_lookup(rows: DataFrame, fleet: DataFrame, *, key: str, member: str, turn: Column) -> DataFrame:
    """Member number ``turn mod fleet size`` of the key's fleet, members in ascending order."""
    w = Window.partitionBy(key)
    slots = fleet.select(key, member).distinct().withColumn(
        "_slot", F.row_number().over(w.orderBy(member)) - 1
    ).withColumn("_size", F.count(F.lit(1)).over(w))
    sizes = slots.select(key, "_size").distinct()
    return (
        rows.join(sizes, key)
        .withColumn("_slot", F.pmod(turn, F.col("_size")))
        .join(slots.drop("_size"), [key, "_slot"])
        .drop("_slot", "_size")
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Interpolated percentiles per group from value counts.

    The table is first reduced to one row per distinct value; the cumulative count is cut
    into slices for large groups. ``value`` must be an integer column.
    """
    group = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    counts = base.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    hot = find_hot_keys(counts, group, value)
    placed = ordered(counts, group, [value], running={"_upto": F.col("_n")}, hot=hot)
    if hot.spans is None:
        ranked = placed.withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
    else:
        ranked = placed.join(counts.groupBy(*group).agg(F.sum("_n").alias("_total")), group)
    picks = []
    for name, p in percents.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        holds = lambda edge: (edge >= F.col("_upto") - F.col("_n")) & (edge < F.col("_upto"))
        picks += [
            F.max(F.when(holds(F.floor(position)), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(holds(F.ceil(position)), F.col(value))).alias(f"_hi_{name}"),
        ]
    picked = ranked.groupBy(*group, "_total").agg(*picks)
    out = []
    for name, p in percents.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        out.append(
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (position - F.floor(position))).alias(name)
        )
    return picked.select(*keys, F.col("_total").alias("n"), *out)
