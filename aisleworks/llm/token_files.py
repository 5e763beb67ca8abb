"""Token ids as Arrow files: sequences of equal length with masks, read at random without copies.

The documents are sorted by id over all tasks; every task encodes its range and writes one shard
of two Arrow IPC files (the stream format with a footer):

``<name>.sequences.arrow``
    ``ids`` and ``mask`` are fixed-size lists of ``length`` values, never null, not compressed,
    ``ROWS`` sequences a batch. Every batch but the last has the same size, so sequence ``i`` is
    row ``i % ROWS`` of batch ``i // ROWS``, and its ids are one slice of the mapped file. Ids
    take two bytes where the vocabulary allows it, else four. The mask takes one bit: set for a
    token, not set for the padding behind the last document of the shard.
``<name>.documents.arrow``
    One row per document in the shard's order: id, start (tokens of the shard before it), n_tokens.

Files carry the number of the attempt that wrote them. Spark commits the list of shards (the
manifest, one row per shard); readers open only files on it, so what a lost or repeated task
leaves behind is never read, and a lost executor costs its own shards. Sequences never cross
shards: no task waits for the counts of another.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm.common import encoded, map_arrow, slices, text_of
from aisleworks.llm.packing import encoder
from aisleworks.session import scratch_path

LENGTH = 2048
ROWS = 64
SHARDS = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("name", T.StringType()), T.StructField("n_documents", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("n_sequences", T.LongType()), T.StructField("bytes", T.LongType()),
])


class TokenFiles(NamedTuple):
    """Where a written set lies; everything else stands in the files and in the manifest."""

    path: str
    length: int


def file_system(path: str):
    """The store of a URI or plain path, and the path in it, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_arrow(path: str) -> pa.ipc.RecordBatchFileReader:
    """A reader with random access to batches; local files are mapped, so nothing is copied."""
    from pyarrow import fs

    store, inner = file_system(path)
    local = isinstance(store, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(inner) if local else store.open_input_file(inner))


class Sequences:
    """Random access to the sequences of one shard."""

    def __init__(self, path: str):
        self.reader = open_arrow(path)
        self.length = self.reader.schema.field("ids").type.list_size
        first = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        last = self.reader.get_batch(self.reader.num_record_batches - 1).num_rows if first else 0
        self.rows = first
        self.count = max(0, self.reader.num_record_batches - 1) * first + last
        self._at, self._batch = -1, None

    def __len__(self) -> int:
        return self.count

    def _column(self, batch: int, name: str) -> pa.Array:
        if batch != self._at:
            self._at, self._batch = batch, self.reader.get_batch(batch)
        return self._batch.column(self._batch.schema.get_field_index(name)).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``: views into the file."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        batch, row = i // self.rows, i % self.rows * self.length
        ids, mask = (self._column(batch, name).slice(row, self.length) for name in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from token ``start`` of the shard; one batch at a time is touched."""
        width, parts, stop = self.rows * self.length, [], start + n
        while start < stop:
            batch, row = divmod(start, width)
            part = self._column(batch, "ids").slice(row, stop - start).to_numpy(zero_copy_only=True)
            if not len(part):
                raise IndexError(stop)
            parts.append(part)
            start += len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, dtype="<u2")])


class _Shard:
    """Writes the two files of one task."""

    def __init__(self, folder: str, name: str, id_type: pa.DataType, width: str, length: int):
        store, inner = file_system(folder)
        store.create_dir(inner, recursive=True)
        self.width, self.length = width, length
        values = [pa.field("item", t, nullable=False) for t in (pa.uint16() if width == "<u2" else pa.uint32(), pa.bool_())]
        self.schema = pa.schema([pa.field(c, pa.list_(v, length), nullable=False) for c, v in zip(("ids", "mask"), values)])
        self.index = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [store.open_output_stream(f"{inner}/{name}.{kind}.arrow") for kind in ("sequences", "documents")]
        self.writers = [pa.ipc.new_file(sink, schema) for sink, schema in zip(self.sinks, (self.schema, self.index))]
        self.ids = np.zeros(ROWS * length, dtype=width)
        self.filled = self.n_documents = self.n_tokens = self.n_sequences = 0

    def _batch(self) -> None:
        rows = -(-self.filled // self.length)
        size = rows * self.length
        self.ids[self.filled : size] = 0
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(c).type)
            for c, x in (("ids", self.ids[:size].copy()), ("mask", np.arange(size) < self.filled))
        ]
        self.writers[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.n_sequences += rows
        self.filled = 0

    def add(self, names: pa.Array, texts: list[np.ndarray], end_id: int) -> None:
        n = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        starts = self.n_tokens + np.cumsum(n) - n
        end = np.array([end_id], dtype=self.width)
        ids = np.concatenate([part for t in texts for part in (t.astype(self.width), end)])
        at = 0
        while at < len(ids):
            room = min(len(self.ids) - self.filled, len(ids) - at)
            self.ids[self.filled : self.filled + room] = ids[at : at + room]
            self.filled += room
            at += room
            if self.filled == len(self.ids):
                self._batch()
        self.writers[1].write_batch(pa.RecordBatch.from_arrays([names, pa.array(starts), pa.array(n)], schema=self.index))
        self.n_documents += len(texts)
        self.n_tokens += len(ids)

    def close(self) -> int:
        if self.filled:
            self._batch()
        for writer in self.writers:
            writer.close()
        size = sum(sink.tell() for sink in self.sinks)
        for sink in self.sinks:
            sink.close()
        return size


def write(
    docs: DataFrame, vocabulary: str, ranks: str, pattern: str, end_id: int = 0, length: int = LENGTH,
    id_column: str = "doc_id", path: str | None = None,
) -> TokenFiles:
    """Encode all documents in ascending order of their id and write the files.

    Null texts count as empty: such a document is its end token alone. A null id comes first;
    rows of one id are ordered by a hash of their text, and repeated rows are written each time.
    An empty table gives an empty manifest and no files. Other columns are ignored, whatever
    their names. ``path`` must not exist yet and must be reachable by all executors; without it
    the shared scratch folder is used.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    folder, attempt = f"{path}/files", uuid.uuid4().hex[:8]
    schema = T.StructType([T.StructField("shard", SHARDS["shard"].dataType), *SHARDS.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, shard = TaskContext.get(), None
        encode = encoder(vocabulary, ranks, pattern)
        width = "<u2" if max(encode.whole.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"
        for batch in slices(batches, "_text"):
            if shard is None:
                name = f"{context.partitionId():06d}-{attempt}-{context.taskAttemptId()}"
                shard = _Shard(folder, name, batch.column("_id").type, width, length)
            shard.add(batch.column("_id"), encode.batch(encoded(batch, "_text")), end_id)
        if shard is not None:
            size = shard.close()
            row = (context.partitionId(), name, shard.n_documents, shard.n_tokens, shard.n_sequences, size)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[f.name for f in schema])

    # The row number splits even repeated rows; no range of equal ids has to be one task's.
    order = ["_id", "_hash", "_row"]
    rows = docs.select(F.col(id_column).alias("_id"), text_of().alias("_text")).withColumn("_hash", F.xxhash64("_text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    map_arrow(rows, run, schema).write.parquet(f"{path}/manifest")
    return TokenFiles(path, length)


def manifest(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row per shard, with base: the tokens of all shards before it."""
    shards = spark.read.schema(SHARDS).parquet(f"{files.path}/manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(spark: SparkSession, files: TokenFiles, id_type: T.DataType, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every document from the files: the id, start (tokens of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit numbers) and, if asked for, ids.

    A task opens one shard and reads its documents by position, a few at a time.
    """
    folder = f"{files.path}/files"
    schema = T.StructType([
        T.StructField(id_column, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                sequences, index = Sequences(f"{folder}/{name}.sequences.arrow"), open_arrow(f"{folder}/{name}.documents.arrow")
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    raw = [sequences.tokens(s, n).astype("<u4").tobytes() for s, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist())]
                    columns = [
                        part.column("id"), pa.array(part.column("start").to_numpy() + base), part.column("n_tokens"), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        *([pa.array(raw, pa.binary())] if with_ids else []),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    shards = manifest(spark, files).select("shard", "name", "base")
    tasks = max(1, spark.read.schema(SHARDS).parquet(f"{files.path}/manifest").count())  # a stated number is not merged: a task per shard
    return map_arrow(shards.repartitionByRange(tasks, "shard"), run, schema)
