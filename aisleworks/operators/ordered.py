"""Ordered per-key work (lag, lead, running sum, last value) that survives hot keys.

A plain window sends all rows of a key to one task. ``find_hot_keys`` therefore counts rows
per key first (map-side combined, a narrow scan). While no key has more than
``spark.aisleworks.hotKeyRows`` rows the plain window is used. Otherwise only the rows of the
hot keys are range-partitioned on (keys, the whole order tuple): Spark's sampled range bounds are
the quantiles, so a key splits wherever its rows are, also among rows that tie on the leading
column. Sorted partitions are cut into slices of at most the limit and written once; the window
runs per (key, slice), and one summary row per slice carries totals and edge rows over to the
next slice. Other keys keep the plain window.

Broadcast bounds: the limit in force is ``L = max(hotKeyRows, N / MAX_HOT_KEYS)`` for ``N`` input
rows, so at most ``MAX_HOT_KEYS`` keys are hot, and they have at most ``2 * MAX_HOT_KEYS`` slices
and one more per sorted partition, however large or skewed the data is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.session import hot_key_rows, written

SLICE, HOT = "_slice", "_hot"
MAX_HOT_KEYS = 50_000
ROWS_PER_TASK = 500_000  # rows that one task sorts (of hot keys, where the limit is smaller) or groups


@dataclass(frozen=True)
class HotKeys:
    """Result of the row count per key; ``spans`` (the hot keys) is None when no key is hot."""

    keys: tuple[str, ...]
    spans: DataFrame | None
    limit: int = 0
    rows: int = 0

    def of(self, df: DataFrame, *, hot: bool) -> DataFrame:
        """The rows of the hot keys, or all others."""
        match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(self.spans[f"_k{i}"]) for i, k in enumerate(self.keys)])
        return df.join(F.broadcast(self.spans), match, "left_semi" if hot else "left_anti")


def find_hot_keys(df: DataFrame, keys: Sequence[str], at: str | None = None) -> HotKeys:
    """Count rows per key now. Valid for every later subset of ``df`` on the same keys.

    Runs one job over the key columns; what it keeps is written once. ``at`` names the leading
    order column for the reader only: slices come from the whole order tuple.
    """
    least, seen = hot_key_rows(df.sparkSession), Observation()
    per_key = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
    large = written(per_key.observe(seen, F.sum("_n").alias("rows")).where(F.col("_n") > least), "hot-keys")
    limit = max(least, -(-(seen.get["rows"] or 0) // MAX_HOT_KEYS))
    spans = large.where(F.col("_n") > limit)
    rows = spans.agg(F.sum("_n")).first()[0]
    return HotKeys(tuple(keys), spans.drop("_n") if rows else None, limit, rows or 0)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` on as many tasks by ``keys`` as its rows ask for, so that what one task groups is bounded.

    For keys about as many as rows, where a combine before the shuffle only fills memory. Counts the
    rows first; a plain scan takes that from the footers.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // ROWS_PER_TASK)), *keys)


def in_slices(df: DataFrame, order: Sequence[str], limit: int, tasks: int | None = None, name: str = SLICE) -> DataFrame:
    """``df`` sorted on ``order`` over all tasks and written, with slice numbers that rise with it.

    A slice has at most ``limit`` rows. Rows that tie on the whole tuple are parted by a hash of
    the row.
    """
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    by = [*order, F.xxhash64(*hashed)]
    ranged = df.repartitionByRange(tasks, *by) if tasks else df.repartitionByRange(*by)
    placed = ranged.sortWithinPartitions(*by).withColumn(name, F.floor(F.monotonically_increasing_id() / F.lit(limit)).cast("bigint"))
    return written(placed, "slices")


def slice_hot_keys(df: DataFrame, hot: HotKeys, order: Sequence[str]) -> DataFrame:
    """The rows of the hot keys with ``_slice``; see ``in_slices``."""
    tasks = -(-hot.rows // max(hot.limit, ROWS_PER_TASK))
    tasks = max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return in_slices(hot.of(df, hot=True), [*hot.keys, *order], hot.limit, tasks)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    running: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    hot: HotKeys | None = None,
    keep_slices: bool = False,
) -> DataFrame:
    """Add ordered columns per key.

    ``running``   sum of the expression over all rows up to and with the current one
    ``previous``  the expression's value on the row before (NULL on the first)
    ``following`` the expression's value on the row after (NULL on the last)
    ``latest``    the last non-NULL value up to and with the current row

    ``order`` must be a total order within a key for repeatable results. Several steps on
    one set of keys and one order share one ``hot`` and pass the slices on with ``keep_slices``.
    """
    running, previous = running or {}, previous or {}
    following, latest = following or {}, latest or {}
    hot = hot or find_hot_keys(df, keys, order[0])
    if hot.spans is None:
        return _plain(df, keys, order, running, previous, following, latest)
    return _sliced(df, keys, order, running, previous, following, latest, hot, keep_slices)


def _plain(df, keys, order, running, previous, following, latest) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {n: F.sum(e).over(upto) for n, e in running.items()}
    added |= {n: F.last(e, ignorenulls=True).over(upto) for n, e in latest.items()}
    added |= {n: F.lag(e).over(w) for n, e in previous.items()}
    added |= {n: F.lead(e).over(w) for n, e in following.items()}
    kept = [c for c in df.columns if c not in added]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])


def _sliced(df, keys, order, running, previous, following, latest, hot, keep_slices) -> DataFrame:
    names = [c for c in df.columns if c not in (SLICE, HOT)]
    if SLICE in df.columns:  # a chained step: fix its input, which is read three times here
        df = written(df, "ordered")
        cold, sliced = df.where(~F.col(HOT)), df.where(F.col(HOT)).drop(HOT)
    else:
        cold, sliced = hot.of(df, hot=False), slice_hot_keys(df, hot, order)
    cold = _plain(cold.select(*names), keys, order, running, previous, following, latest)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    inner = [F.sum(e).over(upto).alias(f"_r_{n}") for n, e in running.items()]
    inner += [F.last(e, ignorenulls=True).over(upto).alias(f"_l_{n}") for n, e in latest.items()]
    if previous:
        inner.append(F.lag(_pack(previous)).over(w).alias("_before"))
    if following:
        inner.append(F.lead(_pack(following)).over(w).alias("_after"))
    body = sliced.select("*", *inner)

    place = F.struct(*order)
    sums = [F.sum(e).alias(f"_cr_{n}") for n, e in running.items()]
    sums += [F.max_by(e, F.when(e.isNotNull(), place)).alias(f"_cl_{n}") for n, e in latest.items()]
    if previous:
        sums.append(F.max_by(_pack(previous), place).alias("_cbefore"))
    if following:
        sums.append(F.min_by(_pack(following), place).alias("_cafter"))
    edge = sliced.groupBy(*keys, SLICE).agg(*sums)
    across = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_cr_{n}").over(earlier).alias(f"_cr_{n}") for n in running]
    carried += [F.last(f"_cl_{n}", ignorenulls=True).over(earlier).alias(f"_cl_{n}") for n in latest]
    if previous:
        carried.append(F.lag("_cbefore").over(across).alias("_cbefore"))
    if following:
        carried.append(F.lead("_cafter").over(across).alias("_cafter"))
    edge = edge.select(
        *[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], F.col(SLICE).alias("_es"), *carried
    )

    match = body[SLICE] == edge["_es"]
    for i, k in enumerate(keys):
        match = match & body[k].eqNullSafe(edge[f"_e{i}"])
    joined = body.join(F.broadcast(edge), match, "left")
    added = {}
    for n in running:
        total = F.col(f"_r_{n}") + F.col(f"_cr_{n}")
        added[n] = F.coalesce(total, F.col(f"_r_{n}"), F.col(f"_cr_{n}"))
    for n in latest:
        added[n] = F.coalesce(f"_l_{n}", f"_cl_{n}")
    for n in previous:
        added[n] = F.coalesce("_before", "_cbefore")[n]
    for n in following:
        added[n] = F.coalesce("_after", "_cafter")[n]
    kept = [F.col(c) for c in names if c not in added]
    done = joined.select(*kept, *[c.alias(n) for n, c in added.items()], *([SLICE, F.lit(True).alias(HOT)] if keep_slices else []))
    if keep_slices:
        cold = cold.select("*", F.lit(-1).cast("bigint").alias(SLICE), F.lit(False).alias(HOT))
    return cold.unionByName(done)


def _pack(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])
