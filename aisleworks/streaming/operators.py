"""Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from aisleworks.sources.files import insert_only_merge


def deduplicated(stream: DataFrame, keys: Sequence[str], at: str, *, delay: str) -> DataFrame:
    """First row per key; the keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, keys: Sequence[str], at: str, *, width: str, delay: str, metrics: Sequence[Column]) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("_w"), *keys).agg(*metrics).withColumn(
        "window_end", F.col("_w.end")
    ).drop("_w")


def sliding(stream: DataFrame, keys: Sequence[str], at: str, *, width: str, slide: str, delay: str, metrics: Sequence[Column]) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width, slide).alias("_w"), *keys).agg(*metrics).withColumn(
        "window_end", F.col("_w.end")
    ).drop("_w")


def sessions(stream: DataFrame, keys: Sequence[str], at: str, *, gap: str, delay: str) -> DataFrame:
    """Visitor sessions; unlike the batch operator a gap equal to the timeout ends a session."""
    return (
        stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("_s"), *keys)
        .agg(F.count(F.lit(1)).alias("events"), F.max(at).alias("last_event"))
        .select(*keys, F.col("_s.start").alias("session_start"), "last_event", "events")
    )


def interval_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, left_at: str, right_at: str, within: str, delay: str
) -> DataFrame:
    """Right rows that follow a left row of the same key within the interval (inner)."""
    a = left.withWatermark(left_at, delay)
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys]).withWatermark(right_at, delay)
    match = (F.col(right_at) > F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {within}"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, match).drop(*[f"_{k}" for k in keys])


def rule_alerts(stream: DataFrame, rules: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """One pass over the stream; a row raises an alert per rule it fulfils."""
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return stream.select(*keep, F.explode(hits).alias("rule"))


#: Keys are dealt to so many states: a call of Python handles all keys of one, not one key.
BUCKETS = 1024


def _kept(frame: pd.DataFrame) -> bytes:
    """A frame as one binary state value."""
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _with_kept(kept: bytes | None, chunks: Iterator[pd.DataFrame], types: dict[str, str], state: GroupState) -> pd.DataFrame:
    """The rows held in the state and those that came, in the given columns."""
    parts = [pd.DataFrame({n: [] for n in types}).astype(types) if kept is None else pa.ipc.open_stream(kept).read_pandas()]
    if not state.hasTimedOut:
        parts += [chunk[list(types)].astype(types) for chunk in chunks]
    parts = [p for p in parts if len(p)] or parts[:1]
    return pd.concat(parts, ignore_index=True)


ALERT = "subject string, site string, rule string, raised_us bigint, measure double"


def stay_alerts(
    moves: DataFrame, subject: str, site: str, *, at: str, leaves: Column, minutes: float = 90.0, delay: str = "1 day", buckets: int = BUCKETS
) -> DataFrame:
    """Alerts on stays of more than ``minutes``: (subject, site, rule, raised_at, measure).

    ``moves`` are arrivals and departures (``leaves`` is true) of a subject, a truck say, in any
    order within ``delay``. A stay begins with an arrival while none is open and ends with the
    next departure after it; further arrivals meanwhile, and departures with nothing open, change
    nothing, and at one instant departures come first. ``overdue`` is raised by a timer when the
    stay has lasted ``minutes`` without a departure, so for subjects that never leave as well;
    ``dwell_breach`` at the departure, its measure being the minutes stayed. The site is the
    arrival's, as text. Rows without subject, time or direction are left out.

    Decisions wait for the watermark, so the order of arrival does not matter. The state holds, for
    the subjects of one of ``buckets`` hash values, the open stays and the moves that the watermark
    has not passed; a subject that has left has nothing there.
    """
    limit = int(minutes * 60_000_000)
    timed = moves.select(F.col(subject).cast("string").alias("_subject"), F.col(site).cast("string").alias("_site"), leaves.alias("_leaves"), at).withWatermark(at, delay)
    timed = timed.withColumn("_us", F.unix_micros(at)).where("_subject IS NOT NULL AND _us IS NOT NULL AND _leaves IS NOT NULL").select(
        "*", F.lit(False).alias("_open"), F.lit(False).alias("_raised"), F.pmod(F.xxhash64("_subject"), F.lit(buckets)).alias("_bucket")
    )
    types = {"_subject": "object", "_site": "object", "_us": "int64", "_leaves": "bool", "_open": "bool", "_raised": "bool"}

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _with_kept(state.get[0] if state.exists else None, chunks, types, state)
        mark = state.getCurrentWatermarkMs() * 1000
        is_ready = rows["_open"] | (rows["_us"] < mark)
        ready, rest = rows[is_ready], rows[~is_ready]
        # An open stay comes before all moves of its subject.
        who = pd.factorize(ready["_subject"])[0]
        order = np.lexsort((ready["_site"].fillna("").to_numpy(dtype=str), ~ready["_leaves"], ready["_us"], ~ready["_open"], who))
        ready, who = ready.iloc[order], who[order]
        gone = ready["_leaves"].to_numpy()
        follows = np.concatenate(([False], (who[1:] == who[:-1]) & ~gone[:-1]))[: len(gone)]  # open before each row
        opens, ends = ~gone & ~follows, gone & follows
        stays = ready[opens]
        starts, raised = stays["_us"].to_numpy(), stays["_raised"].to_numpy()
        until, ended = np.full(len(starts), mark - 1), np.zeros(len(starts), dtype=bool)
        which = (np.cumsum(opens) - 1)[ends]
        until[which], ended[which] = ready["_us"].to_numpy()[ends], True
        stayed = until - starts
        late, done = np.flatnonzero((stayed > limit) & ~raised), np.flatnonzero((stayed > limit) & ended)
        both = stays.iloc[np.concatenate((late, done))]
        yield pd.DataFrame({
            "subject": both["_subject"].to_numpy(), "site": both["_site"].to_numpy(), "rule": ["overdue"] * len(late) + ["dwell_breach"] * len(done),
            "raised_us": np.concatenate((starts[late] + limit, until[done])), "measure": np.concatenate((np.full(len(late), float(minutes)), stayed[done] / 60e6)),
        })
        still = stays[~ended].assign(_open=True, _raised=(raised | (stayed > limit))[~ended])
        if not len(still) and not len(rest):
            state.remove()
            return
        state.update((_kept(pd.concat([part for part in (still, rest) if len(part)], ignore_index=True)),))
        waits = still.loc[~still["_raised"], "_us"] + (limit + 1)
        wake = [int(times.min()) for times in (rest["_us"], waits) if len(times)]
        if wake:
            _wake_at(state, min(wake))

    return timed.groupBy("_bucket").applyInPandasWithState(
        step, ALERT, "kept binary", "append", GroupStateTimeout.EventTimeTimeout,
    ).select("subject", F.col("site").cast(moves.schema[site].dataType).alias("site"), "rule", F.timestamp_micros("raised_us").alias("raised_at"), "measure")


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What batches before ``batch_id`` stored; None where nothing is stored yet. Other errors are raised."""
    try:
        return spark.read.parquet(path).where(F.col("batch_id") < batch_id)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def merge_writer(target: str, keys: Sequence[str]):
    """foreachBatch writer that stores every key once.

    A batch looks only at what earlier batches stored and overwrites its own folder, so a
    replay gives the same table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = _earlier(batch.sparkSession, target, batch_id)
        insert_only_merge(batch, batch.limit(0) if stored is None else stored, keys).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return write


def high_water_load(source: DataFrame, at: str, mark) -> tuple[DataFrame, Column]:
    """Batch form: rows newer than the stored mark, and the next mark.

    Rows that arrive with a time at or below the mark are not seen again; the streaming form
    works on file offsets instead and has no such gap.
    """
    fresh = source if mark is None else source.where(F.col(at) > F.lit(mark))
    return fresh, fresh.agg(F.max(at)).scalar()


def quarantine_writer(root: str, at: str, *, delay: str):
    """foreachBatch writer that splits off rows older than the mark of earlier batches.

    The batch is evaluated once; its mark is read from the one column of what it stored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = _earlier(spark, f"{root}/marks", batch_id)
        mark = None if marks is None else marks.agg(F.max("mark")).first()[0]
        limit = F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(at) < limit, F.lit(False)) if mark is not None else F.lit(False)
        folder = f"{root}/rows/batch_id={batch_id}"
        batch.withColumn("sink", F.when(late, "quarantine").otherwise("main")).write.mode("overwrite").parquet(folder)
        spark.read.schema(batch.schema).parquet(folder).agg(F.max(at).alias("mark")).write.mode("overwrite").parquet(f"{root}/marks/batch_id={batch_id}")

    return write


TOUCH_WINDOW = 7 * 86_400 * 1_000_000  # microseconds
OUTPUT_ROWS = 100_000  # rows that a state function hands over at a time


def _matched(touches: pd.DataFrame, bought: pd.DataFrame, by: Sequence[str] = ()) -> pd.DataFrame:
    """Purchases (at, id) with the newest touch (at, id) of the window before them, per value of ``by``; ties go to the larger id."""
    return pd.merge_asof(
        bought.rename(columns={"id": "purchase_id"}).astype("int64").sort_values("at"),
        touches.astype("int64").sort_values(["at", "id"]).rename(columns={"id": "impression_id"}).astype({"impression_id": "Int64"}),
        on="at", by=list(by) or None, tolerance=TOUCH_WINDOW,
    )


def match_last_touch(known: pd.DataFrame, batch: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """One customer's purchases with their last touch, and the touches worth keeping.

    Touches stay for two windows behind the newest one, so a purchase may arrive up to a
    window late and still find its touch.
    """
    touch = batch["kind"] == "touch"
    touches = pd.concat([known, batch.loc[touch, ["at", "id"]]]).astype("int64").sort_values(["at", "id"])
    matched = _matched(touches, batch.loc[~touch, ["at", "id"]])
    kept = touches[touches["at"] >= touches["at"].max() - 2 * TOUCH_WINDOW] if len(touches) else touches
    return matched, kept


def _wake_at(state: GroupState, micros: int | None) -> None:
    """Ask for a call once the watermark is past ``micros``; nothing to wait for removes the state."""
    if micros is None:
        state.remove()
    else:
        state.setTimeoutTimestamp(max(micros // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def last_touch(touches: DataFrame, purchases: DataFrame, *, at: str = "ts", delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Streaming last touch within seven days, per purchase; equal to the batch form.

    Both inputs have match_key, ``at`` (timestamp) and id; they may arrive in any order within
    ``delay``. A purchase waits in the state until the watermark has passed it: only then every
    touch before it is known. A touch is forgotten once no purchase can need it any more. A state
    serves the customers of one of ``buckets`` hash values, and one with nothing left is removed.
    Purchases without a key match nothing and are given out at once. Rows later than the watermark
    are dropped by Spark (``quarantine_writer`` keeps them). To end a stream, send one row under a
    key of its own with a time beyond ``delay``.
    """
    both = touches.select("match_key", at, "id", F.lit(True).alias("_touch")).unionByName(purchases.select("match_key", at, "id", F.lit(False).alias("_touch")))
    timed = both.withWatermark(at, delay).where("match_key IS NOT NULL").select(
        F.col("match_key").alias("key"), F.unix_micros(at).alias("at"), "id", "_touch", F.pmod(F.xxhash64("match_key"), F.lit(buckets)).alias("_bucket"), F.col(at).alias("_time")
    )
    types = {"key": "int64", "at": "int64", "id": "int64", "_touch": "bool"}

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _with_kept(state.get[0] if state.exists else None, chunks, types, state)
        mark = state.getCurrentWatermarkMs() * 1000
        known, bought = (rows[rows["_touch"] == touch] for touch in (True, False))
        ready = bought["at"] < mark
        matched = _matched(known[["key", "at", "id"]], bought.loc[ready, ["key", "at", "id"]], ["key"])
        bought = bought[~ready]
        # The oldest purchase that can still come, or that waits, looks back one window.
        needed = bought.groupby("key")["at"].min().reindex(known["key"]).fillna(mark).clip(upper=mark)
        known = known[known["at"].to_numpy() >= needed.to_numpy() - TOUCH_WINDOW]
        if len(bought):
            ends = int(bought["at"].min())
        else:
            ends = int(known["at"].min()) + TOUCH_WINDOW if len(known) else None
        if len(bought) or len(known):
            state.update((_kept(pd.concat([part for part in (known, bought) if len(part)], ignore_index=True)),))
        _wake_at(state, ends)
        yield matched.rename(columns={"key": "match_key"})[["match_key", "purchase_id", "impression_id"]]

    found = timed.groupBy("_bucket").applyInPandasWithState(
        step, "match_key bigint, purchase_id bigint, impression_id bigint", "kept binary", "append", GroupStateTimeout.EventTimeTimeout,
    )
    lone = purchases.where("match_key IS NULL").select("match_key", F.col("id").alias("purchase_id"), F.lit(None).cast("bigint").alias("impression_id"))
    return found.unionByName(lone)


def running_balance(stream: DataFrame, keys: Sequence[str], *, at: str, tie: str, opening: int, delay: str = "1 day") -> DataFrame:
    """Balance after each movement, in the order of (``at``, ``tie``), whatever the order of arrival.

    The state of a key is the balance of all movements behind the watermark and the movements
    before it, in one binary value, which are given out, sorted, only once the watermark has passed
    them. ``tie`` is a bigint. Movements later than the watermark are dropped by Spark, never added
    at a wrong place.
    """
    names = [*keys, at, tie, "quantity"]
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    output = ", ".join(f"{n} {fields[n]}" for n in [*keys, tie]) + ", quantity bigint, _us bigint, balance bigint"
    types = dict.fromkeys(("_us", tie, "quantity"), "int64")

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        balance, kept = state.get if state.exists else (opening, None)
        rows = _with_kept(kept, chunks, types, state)
        ready = rows["_us"] < state.getCurrentWatermarkMs() * 1000
        out, rest = rows[ready].sort_values(["_us", tie], kind="stable"), rows[~ready]
        out["balance"] = balance + out["quantity"].cumsum()
        state.update((int(out["balance"].iloc[-1]) if len(out) else balance, _kept(rest) if len(rest) else None))
        if len(rest):
            _wake_at(state, int(rest["_us"].min()))
        for name, value in zip(keys, key):
            out[name] = value
        for first in range(0, len(out), OUTPUT_ROWS):
            yield out.iloc[first : first + OUTPUT_ROWS][[*keys, tie, "quantity", "_us", "balance"]]

    timed = stream.select(*names).withWatermark(at, delay).withColumn("_us", F.unix_micros(at))
    return timed.groupBy(*keys).applyInPandasWithState(
        step, output, "balance bigint, kept binary", "append", GroupStateTimeout.EventTimeTimeout
    ).select(*keys, F.timestamp_micros("_us").alias(at), tie, "quantity", "balance")
