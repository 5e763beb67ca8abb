"""Shared helpers: scratch tables, Arrow slices, text hashing, bounded groups and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.session import scratch_path

#: Arrow slices handled at once inside a task, in bytes of text.
SLICE_BYTES = 4 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: One task is enough for so many rows of ids and hashes, or rows with texts.
TASK_ROWS, TASK_TEXTS = 1 << 16, 1 << 12


def materialised(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fewer_tasks(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` in at most one task for every ``each`` of its ``rows`` (their number, or about that).

    Each task that writes leaves a file, and on local file systems a file costs three processes
    started beside the executor. Small tables need none from every partition of a shuffle; large
    ones keep their tasks.
    """
    return df.coalesce(max(1, -(-rows // each)))


def by_merge(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` as a side of a join that is merged if it may have more than ``each`` rows.

    The planner sizes a scratch table by its compressed files, and what is exploded or mapped by
    the table before; below its limit for broadcasts such a table can still be more than the
    driver holds. What has few ``rows`` (their number, or a bound) is left to the planner.
    """
    return df if rows <= each else df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete written tables (from ``materialised``) that nothing reads any more.

    Only for tables whose readers are written themselves: then no lineage leads back to them.
    """
    for table in tables:
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if "/aisleworks/" not in folder:
                raise ValueError(f"{folder} is no scratch table")
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def scan_settings(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches by bytes, so that very long texts do not pile up in one batch."""
    df.sparkSession.conf.set(_ARROW_BYTES, str(16 << 20))
    return df


def map_arrow(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    return scan_settings(df).mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes per slice; one value is never cut."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.zeros(n, dtype=np.int64)
        got = pc.binary_length(values)
        sizes[:] = pc.fill_null(got, 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def encoded(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if v is None else v for v in batch.column(column).cast(pa.binary()).to_pylist()]


# --- hashing of byte ranges ------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        up = np.full(size, _MULT, dtype=np.uint64)
        down = np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for many ranges, from one running polynomial sum."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def word_ranges(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of many texts.

    Returns the joined bytes, word starts and ends in them, and the first word of each text
    (with one more entry at the end).
    """
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    space = is_space(data)
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    return data, starts, ends, np.searchsorted(starts, edges)


# --- groups of bounded size --------------------------------------------------------------------


def bounded_groups(members: DataFrame, keys: list[str], ident: str, block: int) -> DataFrame:
    """Groups of at least two members, cut into pairs of blocks.

    A key with ``n`` members is dealt into ``ceil(n / block)`` blocks; every pair of blocks
    (and each block with itself) becomes one row with the array ``members`` of structs. Two
    members of one key meet in at least one row, and no row holds more than about two blocks,
    however large the group is. Singletons go before anything is collected. ``first`` and
    ``second`` name the blocks: two members of one block also meet in rows with ``first !=
    second``, where they need not be looked at. The sizes are merged with the members: members
    come from an explode, which the planner does not count.
    """
    sizes = (
        members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .withColumn("_g", F.ceil(F.col("_n") / block).cast("int")).drop("_n")
    )
    payload = [c for c in members.columns if c not in keys]
    own = F.pmod(F.xxhash64(F.lit(97), F.col(ident)), F.col("_g")).cast("int")
    dealt = (
        members.join(sizes.hint("merge"), keys)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
        .withColumn("first", F.least("_own", "_other")).withColumn("second", F.greatest("_own", "_other"))
    )
    return dealt.groupBy(*keys, "first", "second").agg(
        F.collect_list(F.struct(*[F.col(c) for c in payload], F.col("_own").alias("block"))).alias("members")
    )


def forest(near: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: each row's smallest connected row index."""
    n = len(near)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        reached = near[i] & (root < 0)
        while reached.any():
            root[reached] = i
            reached = near[reached].any(axis=0) & (root < 0)
    return root


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """Connected components: (node, component) for every node with an edge.

    ``component`` is the smallest node reachable. Alternates large-star and small-star steps;
    every round is a written table, so nothing is collected and a lost executor costs one round;
    the table of the round before goes. No round has more edges than the one before it: those of
    at most ``TASK_ROWS`` need no exchange and are one task. ``rows`` is about how many edges come.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = materialised(now if rows is None else fewer_tasks(now, rows), "edges")
    seen, left = None, now.count()
    while True:
        few = (lambda df: df.coalesce(1)) if left <= TASK_ROWS else (lambda df: df)
        both = few(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(by_merge(low, left), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = few(
            large.join(by_merge(smallest, left), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(smallest.withColumnRenamed("m", "v")).where("u <> v")
        ).distinct()
        before, now = now, materialised(fewer_tasks(small, left), "edges")
        discard(before)
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen, left = mark, mark[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))




def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}".lower() in have:
            name = f"_{name}"
        out.append(f"_{name}")
    return out
