"""Passages that several documents share, wherever they stand in lines.

Words (ASCII lower case) are cut into content-defined units. Of every ``WINDOW`` consecutive words
the one with the smallest hash is an anchor; a unit reaches from an anchor to ``TAIL`` words
behind the next one. Anchors depend on the words around them only, so a run of words that two
documents share, whatever its lines and surroundings, has the same units inside: at least one in
every run of ``2 * WINDOW - 1 + TAIL`` words, and on average more than half of a run of 50. Equal
units (96 hash bits and the length) of different documents are one class; overlapping repeated
units of a document are one span, and spans of at least ``LEAST`` words count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm.common import _powers, discard, encoded, fewer_tasks, map_arrow, materialised, mix, range_hashes, slices, text_of, word_ranges

WINDOW, TAIL, LEAST = 21, 8, 16


def anchors(weight: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest weight (the leftmost) of all windows that lie in one text."""
    if len(weight) < window:
        return np.empty(0, dtype=np.int64)
    start = np.arange(len(weight) - window + 1)
    text = np.searchsorted(first, np.arange(len(weight)), side="right")
    start = start[text[start] == text[start + window - 1]]
    chosen = np.zeros(len(weight), dtype=bool)
    view = np.lib.stride_tricks.sliding_window_view(weight, window)
    for a in range(0, len(start), 1 << 16):
        part = start[a : a + (1 << 16)]
        chosen[part + view[part].argmin(axis=1)] = True
    return np.flatnonzero(chosen)


def units(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Units of many texts: (text, first word, words, hash, second hash)."""
    data, starts, ends, first = word_ranges([t.lower() for t in texts])
    n = len(starts)
    word = range_hashes(data, starts, ends)
    after = np.append(word[1:], np.zeros(1, dtype=np.uint64))[:n]
    after[(first[1:] - 1)[np.diff(first) > 0]] = 0
    at = anchors(mix(word + after * np.uint64(0x9E3779B97F4A7C15)), first[1:-1])
    text = np.searchsorted(first[1:], at, side="right")
    begin, end = at[:-1], at[1:] + TAIL
    whole = (text[:-1] == text[1:]) & (end <= first[1:][text[:-1]]) if len(at) else np.empty(0, dtype=bool)
    begin, end, text = begin[whole], end[whole], text[:-1][whole]
    up, down = _powers(n + 1)
    names = []
    for values in (word, mix(word + np.uint64(1))):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=sums[1:])
        names.append(mix((sums[end] - sums[begin]) * down[begin]))
    return text, begin - first[text], end - begin, names[0].view(np.int64), (names[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def passages(docs: DataFrame, id_column: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Spans of words that other documents hold too.

    Columns: the id, text_hash, start (word number), n_words, keeper_id (the smallest id among the
    keepers of the span's units) and kept (this document is the first that holds them). Documents
    are ordered by id, then text; a null id comes first. Rows that repeat id and text are one
    document. Null and empty texts, and texts of fewer words than a unit, have no spans; an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    schema = T.StructType([
        T.StructField("_id", docs.schema[id_column].dataType), T.StructField("text_hash", T.LongType()), T.StructField("start", T.IntegerType()),
        T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("c", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            text, start, n, h, c = units(encoded(batch, "_text"))
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(take), batch.column("text_hash").take(take), pa.array(start.astype("i4")), pa.array(n.astype("i4")), pa.array(h), pa.array(c)],
                names=[f.name for f in schema],
            )

    rows = docs.select(F.col(id_column).alias("_id"), text_of().alias("_text")).withColumn("text_hash", F.xxhash64("_text"))
    found = materialised(map_arrow(rows, run, schema), "units")
    total = found.count()
    place = F.struct("_id", "text_hash")
    # Most units occur once: their hashes alone are counted, and only the units of the others go on.
    # Sort-merge at every size: both sides grow with the corpus; skewed units are split at run time.
    several = found.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
    again = materialised(fewer_tasks(found.join(several.hint("merge"), "h", "left_semi"), total), "repeated-units")
    discard(found)
    classes = again.groupBy("h", "c", "n").agg(F.min(place).alias("keeper"), F.max(place).alias("last")).where("NOT keeper <=> last").drop("last")
    met = again.join(materialised(fewer_tasks(classes, total), "unit-classes").hint("merge"), ["h", "c", "n"]).select(
        "_id", "text_hash", "start", (F.col("start") + F.col("n")).alias("end"), F.col("keeper._id").alias("keeper_id"), place.eqNullSafe(F.col("keeper")).alias("kept")
    )
    own = W.partitionBy("_id", "text_hash", "kept").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach, 0).otherwise(1)
    spans = met.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(own.rowsBetween(W.unboundedPreceding, 0)))
    merged = spans.groupBy("_id", "text_hash", "kept", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("keeper_id").alias("keeper_id"))
    n_words = (F.col("end") - F.col("start")).cast("long")
    return merged.where(n_words >= least).select(F.col("_id").alias(id_column), "text_hash", "start", n_words.alias("n_words"), "keeper_id", "kept")
