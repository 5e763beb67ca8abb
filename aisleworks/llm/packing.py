"""Packing of tokenised documents into fixed windows, mixed to target token proportions.

Sources are queues of tokens. They are served by deficit round-robin: in round ``r`` source
``s`` may send until its total reaches ``r * quantum_s``. Quanta are fixed-point numbers with
``FRACTION`` parts a token; what a round leaves over stays in the source's deficit and comes
in a later round. The quanta of one round add up to one window, so every window holds the
target proportions as long as its sources last; when a queue is empty, the following round
simply starts earlier and the others fill the window. Rounds are concatenated and cut into
windows of ``window`` tokens: only the last window has padding.

The state after round ``r`` has a closed form, ``min(total_s, r * quantum_s // FRACTION)``,
so every document finds its place from its own offset in its source: deficits carry over all
windows and partitions without any task seeing more than its own rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from aisleworks.llm.common import encoded, is_space, map_arrow, materialised, range_hashes, slices, text_of

WINDOW = 2048
FRACTION = 1 << 12
#: Distinct pieces of text whose ids one Python worker remembers.
MEMORY = 600_000
#: Pieces longer than this many bytes are encoded each time.
LONG_PIECE = 200

_STATE: dict[str, object] = {}
#: White space beyond ASCII (UTF-8), the start of special tokens: such texts are encoded as a whole.
_UNUSUAL = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")
_LEADS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3", b"<|")


def _unusual(text: bytes) -> bool:
    return any(lead in text for lead in _LEADS) and _UNUSUAL.search(text) is not None


def _distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each piece's bytes, and a piece for every number; pieces lie end to end.

    Pieces are grouped by a hash, then every byte is compared with that of the group's first
    piece; a piece that differs gets a number by its bytes.
    """
    if not len(starts):
        return starts, starts
    ends = np.append(starts[1:], len(data))
    code, distinct = pd.factorize(range_hashes(data, starts, ends))
    where = np.empty(len(distinct), dtype=np.int64)
    where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    length = ends - starts
    shift = starts[where][code] - starts
    other = np.minimum(np.arange(len(data)) + np.repeat(shift, length), len(data) - 1)
    differs = np.add.reduceat(data[other] != data, starts, dtype=np.int64) > 0
    differs |= length != length[where][code]
    if differs.any():
        raw, extra, more = data.tobytes(), {}, []
        for i in np.flatnonzero(differs).tolist():
            piece = raw[starts[i] : ends[i]]
            if piece not in extra:
                extra[piece] = len(where) + len(more)
                more.append(i)
            code[i] = extra[piece]
        where = np.append(where, more)
    return code, where


class Encoder(dict):
    """Ids of whole texts, as the tokenizer file gives them.

    A byte-level BPE never merges across the pre-tokens of its pattern, and a run of other
    characters with the one space before it always begins and ends on such edges. Texts are
    cut there; the mapping from pieces, byte for byte, to their ids is remembered up to
    ``MEMORY`` pieces. The pieces are encoded with the same vocabulary in rank form, which gives
    the same ids several times faster; unusual texts go through the tokenizer file as a whole.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pieces = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(self.pieces.encode_ordinary(piece.decode("utf-8", "replace")), dtype="<u4").tobytes()
        if len(piece) <= LONG_PIECE and len(self) < MEMORY:
            self[piece] = ids
        return ids

    def _cuts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        space = is_space(data)
        first = np.zeros(len(data), dtype=bool)
        first[edges[:-1][edges[:-1] < edges[1:]]] = True
        last = np.zeros(len(data), dtype=bool)
        last[(edges[1:] - 1)[edges[:-1] < edges[1:]]] = True
        after_space = np.zeros(len(data), dtype=bool)
        after_space[1:] = space[:-1]
        after_space &= ~first
        before_word = np.zeros(len(data), dtype=bool)
        before_word[:-1] = ~space[1:]
        before_word &= ~last
        after_blank = np.zeros(len(data), dtype=bool)
        after_blank[1:] = data[:-1] == 32
        return np.flatnonzero(first | (space & (~after_space | before_word)) | (~space & after_space & ~after_blank))

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        plain = [b"" if _unusual(t) else t for t in texts]
        raw = b"".join(plain)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in plain]))).astype(np.int64)
        data = np.frombuffer(raw, dtype=np.uint8)
        starts = self._cuts(data, edges) if raw else np.empty(0, dtype=np.int64)
        code, where = _distinct(data, starts)
        ends = np.append(starts[1:], len(raw))
        found = [self[raw[a:b]] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        sizes = np.fromiter((len(x) >> 2 for x in found), dtype=np.int64, count=len(found))
        begin, each = np.cumsum(sizes) - sizes, sizes[code]
        total = np.concatenate(([0], np.cumsum(each)))
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.arange(total[-1]) + np.repeat(begin[code] - total[:-1], each)]
        bounds = total[np.searchsorted(starts, edges)].tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for i, (text, kept) in enumerate(zip(texts, plain)):
            if len(text) != len(kept):
                got = self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
                out[i] = np.array(got, dtype="<u4")
        return out


def encoder(vocabulary: str, ranks: str, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = f"{vocabulary}|{ranks}"
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = Encoder(vocabulary, ranks, pattern)
    return _STATE[key]


def token_queues(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, end_id: int, carry: list[str]) -> DataFrame:
    """Ids of every document with its place in its source's queue within one scan task.

    ``part`` and ``local`` (tokens of the same source before it in the same task) stand in the
    written table, so later steps do not depend on how it is split again.
    """
    schema = T.StructType([
        *[T.StructField(c, docs.schema[c].dataType) for c in carry],
        T.StructField("source", T.StringType()), T.StructField("part", T.LongType()), T.StructField("local", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, pattern)
        part = TaskContext.get().partitionId()
        used: dict[str | None, int] = {}
        end = np.array([end_id], dtype="<u4")
        for batch in slices(batches, "_text"):
            ids = encode.batch(encoded(batch, "_text"))
            local, n, raw = [], [], []
            for source, own in zip(batch.column("_source").to_pylist(), ids):
                local.append(used.get(source, 0))
                n.append(len(own) + 1)
                used[source] = local[-1] + n[-1]
                raw.append(np.concatenate((own, end)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], batch.column("_source"), pa.array([part] * len(n), pa.int64()), pa.array(local, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())],
                names=[f.name for f in schema],
            )

    rows = docs.select(*carry, F.col("source").cast("string").alias("_source"), text_of().alias("_text"))
    return materialised(map_arrow(rows, run, schema), "queues")


def source_plan(queues: DataFrame, weights: dict[str, float] | None, window: int) -> DataFrame:
    """One row per source: its place in the round, its total and its quantum.

    Without ``weights`` the targets are the sources' own shares of all tokens, the only
    proportions that can hold to the end when everything is packed. Sources without a weight
    get the mean of the given ones. The table has one row per source.
    """
    totals = queues.groupBy("source").agg(F.sum("n").alias("total"))
    share = F.col("total").cast("double")
    if weights:
        mean = float(sum(weights.values()) / len(weights))
        share = F.lit(mean)
        for name, weight in weights.items():
            share = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(share)
    everything = W.partitionBy()
    return (
        totals.withColumn("share", share)
        .withColumn("quantum", F.greatest(F.lit(1), F.floor(F.col("share") / F.sum("share").over(everything) * window * FRACTION)).cast("long"))
        .withColumn("turn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .select("source", "turn", "total", "quantum")
    )


def pack(
    docs: DataFrame, vocabulary: str, ranks: str, pattern: str, end_id: int = 1, weights: dict[str, float] | None = None,
    window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False,
) -> DataFrame:
    """Pack all documents; one row per piece of a document in a window.

    Null texts count as empty: such a document is its end token alone. Null sources are a
    source of their own. Repeated rows are packed each time. An empty table gives no rows.
    Other columns are ignored, whatever their names. Columns: ``carry``, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, source and, if asked for, ids (little-endian
    unsigned 32-bit numbers).
    """
    carried = list(carry)
    queues = token_queues(docs, vocabulary, ranks, pattern, end_id, carried)
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = materialised(
        queues.groupBy("source", "part").agg(F.sum("n").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select(F.col("source").alias("_s"), F.col("part").alias("_p"), "base"),
        "queue-bases",
    )
    plan = [tuple(r) for r in source_plan(queues, weights, window).orderBy("turn").collect()]  # one row per source
    turns = {r[0]: r[1] for r in plan}
    total = np.array([r[2] for r in plan], dtype=np.int64)
    quantum = np.array([r[3] for r in plan], dtype=np.int64)
    schema = T.StructType([
        *[T.StructField(c, docs.schema[c].dataType) for c in carried],
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        T.StructField("source", T.StringType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])

    def sent(rounds: np.ndarray, turn) -> np.ndarray:
        return np.minimum(total[turn], rounds * quantum[turn] // FRACTION)

    def place(turn: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Tokens of the whole stream before the turn of a source in a round."""
        out = np.zeros(len(rounds), dtype=np.int64)
        for other in range(len(total)):
            out += sent(rounds + (other < turn), other)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            n = batch.column("n").to_numpy()
            at = batch.column("base").to_numpy() + batch.column("local").to_numpy()
            turn = np.array([turns[s] for s in batch.column("source").to_pylist()], dtype=np.int64)
            q = quantum[turn]
            # The round of token x is the last r with r * q // FRACTION <= x. Where a round sends
            # less than a token, tokens are counted instead of rounds: most rounds are empty.
            low, high = ((at + 1) * FRACTION - 1) // q, ((at + n) * FRACTION - 1) // q
            items = np.where(q >= FRACTION, high - low + 1, n)
            doc = np.repeat(np.arange(len(n)), items)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(items) - items, items)
            r = np.where(q[doc] >= FRACTION, low[doc] + nth, ((at[doc] + nth + 1) * FRACTION - 1) // q[doc])
            begin = np.maximum(at[doc], r * q[doc] // FRACTION)
            end = np.minimum(at[doc] + n[doc], (r + 1) * q[doc] // FRACTION)
            keep = end > begin
            doc, r, begin, end = doc[keep], r[keep], begin[keep], end[keep]
            stream = place(turn[doc], r) + begin - sent(r, turn[doc])
            # A piece that crosses the end of a window is cut there.
            cuts = (stream + (end - begin) - 1) // window - stream // window + 1
            piece = np.repeat(np.arange(len(doc)), cuts)
            nth = np.arange(len(piece)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            first = np.maximum(stream[piece], (stream[piece] // window + nth) * window)
            last = np.minimum(stream[piece] + (end - begin)[piece], (stream[piece] // window + nth + 1) * window)
            owner = doc[piece]
            start = begin[piece] + (first - stream[piece]) - at[owner]
            length = last - first
            raw = batch.column("ids").to_pylist()
            cut = [raw[d][s * 4 : (s + k) * 4] for d, s, k in zip(owner.tolist(), start.tolist(), length.tolist())]
            take = pa.array(owner)
            columns = [
                *[batch.column(c).take(take) for c in carried],
                pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[owner]),
                pa.array(first // window), pa.array(first % window), batch.column("source").take(take),
            ]
            if with_ids:
                columns.append(pa.array(cut, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    placed = queues.join(parts, F.col("part").eqNullSafe(F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_p", "_s")
    return map_arrow(placed, run, schema)
