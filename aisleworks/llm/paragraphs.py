"""Substring deduplication: MinHash banding of paragraphs, exact Jaccard, components.

Repetitions that do not fill such paragraphs are found as passages (``passages.py``), in content-
defined units over line ends; ``without_repeats`` cuts both.

A paragraph is a line with at least ``min_words`` words (ASCII lower case, white space
normalised). Equal paragraphs are one class, found by a 128-bit hash. Each class gets a MinHash
signature of its word shingles, cut into ``BANDS`` bands of ``ROWS`` values: at a Jaccard
similarity of 0.8 two paragraphs share at least one band with probability 0.997. Bands with the
same members are one bucket. Only classes that collide carry their words into the buckets, where
the exact Jaccard similarity of their shingles is checked in blocks of bounded size; a block
returns a spanning forest of its links, not its pairs. Components of the links are the clusters;
each cluster keeps its first paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm import passages
from aisleworks.llm.common import TASK_TEXTS, bounded_groups, by_merge, components, discard, encoded, fewer_tasks, forest, map_arrow, materialised, mix, range_hashes, slices, text_of, unused, word_ranges

WORDS, SIMILARITY = 5, 0.8
MIN_WORDS = 20
BANDS, ROWS = 12, 4
BLOCK = 256
#: A class with more than one in ``HOT`` of all rows is joined apart; there are fewer than ``HOT``.
HOT = 1000

_BLANK = " \t\r\x0b\x0c"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_random = np.random.default_rng(20)
_FACTORS = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(paragraphs: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of normalised paragraphs, one after another, and where each begins (and the end).

    A paragraph with fewer than ``words`` words has one shingle, all of it.
    """
    data, starts, ends, first = word_ranges(paragraphs)
    have = np.diff(first)
    n = np.where(have == 0, 0, np.maximum(have - words + 1, 1))
    edges = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(edges[-1]) + np.repeat(first[:-1] - edges[:-1], n)
    last = np.minimum(at + words, np.repeat(first[1:], n)) - 1
    return range_hashes(data, starts[at], ends[last]), edges


def bands(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Band keys, one row per paragraph; every paragraph must have a shingle."""
    out = np.empty((len(edges) - 1, BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(out), band + 1, dtype=np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            low = np.minimum.reduceat((hashes ^ _SEEDS[i]) * _FACTORS[i], edges[:-1])
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = key
    return out


def paragraphs(docs: DataFrame, id_column: str = "doc_id", min_words: int = MIN_WORDS, words: int = WORDS) -> DataFrame:
    """Paragraphs of all whole texts: id, text_hash, paragraph (line number from 0), n_words, h, bands, body."""
    schema = T.StructType([
        T.StructField("_id", docs.schema[id_column].dataType), T.StructField("text_hash", T.LongType()), T.StructField("paragraph", T.IntegerType()),
        T.StructField("n_words", T.LongType()), T.StructField("h", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("body", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "_text"):
            owner, number, count, body = [], [], [], []
            for i, text in enumerate(encoded(batch, "_text")):
                for k, line in enumerate(text.lower().split(b"\n")):
                    parts = line.split()
                    if parts and len(parts) >= min_words:
                        owner.append(i)
                        number.append(k)
                        count.append(len(parts))
                        body.append(b" ".join(parts))
            if not owner:
                continue
            keys = bands(*shingles(body, words))
            take = pa.array(owner, pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(take), batch.column("text_hash").take(take), pa.array(number, pa.int32()), pa.array(count, pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(b) for b in body], pa.binary()), lists, pa.array(body, pa.binary())],
                names=[f.name for f in schema],
            )

    rows = docs.select(F.col(id_column).alias("_id"), text_of().alias("_text")).withColumn("text_hash", F.xxhash64("_text"))
    return map_arrow(rows, run, schema)


def jaccard_forest(bodies: list[bytes], similarity: float = SIMILARITY, words: int = WORDS) -> np.ndarray:
    """For each paragraph the smallest index that links of at least ``similarity`` reach."""
    hashes, edges = shingles(bodies, words)
    return set_forest(hashes, np.repeat(np.arange(len(bodies)), np.diff(edges)), len(bodies), similarity)


def set_forest(hashes: np.ndarray, owner: np.ndarray, n: int, similarity: float = SIMILARITY) -> np.ndarray:
    """The same for ``n`` sets, given as element hashes and the set of each."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    sizes = np.bincount(owner, minlength=n)
    _, code, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[code] > 1  # a shingle of one paragraph only adds to no intersection
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    common = np.zeros((n, n), dtype=np.float64)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = 2048
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (low, low + width))
        held = np.zeros((n, width), dtype=np.float32)
        held[owner[a:b], code[a:b] - low] = 1
        common += held @ held.T
    either = sizes[:, None] + sizes[None, :] - common
    return forest(common >= similarity * either - 1e-9)


def links(candidates: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """Spanning edges (a, b) between classes with Jaccard similarity of at least ``similarity``.

    ``candidates`` has bucket, h and body; members of a bucket meet in blocks.
    """
    groups = bounded_groups(candidates, ["bucket"], "h", BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[bytes] = []
            b: list[bytes] = []
            rows = batch.column("members")
            flat, offsets = rows.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(rows).to_numpy())))
            keys, bodies = flat.field("h").to_pylist(), flat.field("body").to_pylist()
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                for i, root in enumerate(jaccard_forest(bodies[s:e], similarity, words).tolist()):
                    if i != root:
                        a.append(keys[s + i])
                        b.append(keys[s + root])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return map_arrow(groups.select("members"), run, "a binary, b binary")


def attached(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join on ``key``, unique in ``classes``; ``_n`` there is the number of rows of the key.

    Keys with more than one in ``HOT`` of all rows are fewer than ``HOT`` and go by broadcast, so
    that no task gets all rows of a frequent key.
    """
    hot = classes.where(F.col("_n") * HOT > total)
    cold = classes.where(F.col("_n") * HOT <= total)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(by_merge(cold, total), key))


def repeated(docs: DataFrame, id_column: str = "doc_id", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One row per paragraph that occurs, alike, in another place.

    Columns: the id, text_hash, paragraph (line number from 0), n_words, keeper_id,
    keeper_paragraph (the cluster's first place), cluster_size (paragraphs in it) and kept
    (this is that place). Places are ordered by id, text and line; a null id comes first. Null
    and empty texts have no paragraphs. Rows that repeat id and text are one document: their
    paragraphs are no repetition of each other and share one decision. Empty tables give no rows;
    other columns are ignored, whatever their names.
    """
    found = materialised(paragraphs(docs, id_column, min_words, words), "paragraphs")
    total = found.count()
    place = F.struct("_id", "text_hash", "paragraph")
    classes = found.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("first"), F.max(place).alias("last"), F.first("bands").alias("bands"))
    classes = materialised(fewer_tasks(classes, total), "paragraph-classes")
    # Bands carry 64-bit names of classes; a collision of names only adds a candidate. The joins
    # are merged at every size: what they join with grows with the corpus.
    banded = classes.select(F.xxhash64("h").alias("member"), F.explode("bands").alias("bucket"))
    # One exchange: a row of a bucket has a neighbour before or after it in the bucket.
    beside = Window.partitionBy("bucket").orderBy("member")
    both = banded.withColumn("before", F.lag("member").over(beside)).withColumn("after", F.lead("member").over(beside))
    met = materialised(fewer_tasks(both.where("before IS NOT NULL OR after IS NOT NULL").select("member", "bucket"), total * BANDS), "bucket-members")
    alike = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("member").alias("x"), F.sum(F.shiftright("member", 24)).alias("s"))
    alone = materialised(fewer_tasks(alike.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket"), total * BANDS), "buckets")
    met = met.join(by_merge(alone, alone.count()), "bucket")
    bodies = (
        found.select("h", "body", F.xxhash64("h").alias("member")).join(met.select("member").distinct().hint("merge"), "member", "left_semi")
        .groupBy("h", "member").agg(F.min("body").alias("body"))
    )
    bodies = materialised(fewer_tasks(bodies, total, TASK_TEXTS), "bodies")
    # From here on the places will do: the texts and bands of all paragraphs go.
    places = materialised(found.select("_id", "text_hash", "paragraph", "n_words", "h"), "paragraph-places")
    discard(found)
    edges = links(met.join(by_merge(bodies, total, TASK_TEXTS), "member").drop("member"), similarity, words)
    reached = components(edges, rows=total).withColumnRenamed("node", "h")
    discard(bodies)
    rooted = classes.drop("bands").join(by_merge(reached, total), "h", "left").withColumn("root", F.coalesce("component", "h")).drop("component")
    rooted = materialised(fewer_tasks(rooted, total), "paragraph-roots")
    discard(classes)
    # Classes without links are clusters by themselves; only linked ones are added up by root.
    linked = rooted.join(by_merge(reached.select("h"), total), "h", "left_semi")
    sums = linked.groupBy("root").agg(F.sum("_n").alias("size"), F.min("first").alias("keeper"), F.max("last").alias("end"), F.count(F.lit(1)).alias("_n"))
    sums = materialised(fewer_tasks(sums, total), "paragraph-clusters")
    of_linked = attached(linked.select("h", "root", F.col("_n").alias("copies")), sums, "root", max(1, linked.count()))
    clusters = of_linked.select("h", F.col("copies").alias("_n"), "size", "keeper", "end").unionByName(
        rooted.join(by_merge(reached.select("h"), total), "h", "left_anti").select("h", "_n", F.col("_n").alias("size"), F.col("first").alias("keeper"), F.col("last").alias("end"))
    ).where("keeper <> end OR (keeper IS NULL) <> (end IS NULL)")
    clusters = materialised(fewer_tasks(clusters, total), "clusters")
    discard(rooted)
    every = attached(places, clusters, "h", max(1, total))
    return every.select(
        F.col("_id").alias(id_column), "text_hash", "paragraph", "n_words", F.col("keeper._id").alias("keeper_id"),
        F.col("keeper.paragraph").alias("keeper_paragraph"), F.col("size").alias("cluster_size"), F.struct("_id", "text_hash", "paragraph").eqNullSafe(F.col("keeper")).alias("kept"),
    )


def cut_text(text: str, lines: set[int], spans: list[tuple[int, int]]) -> str:
    """``text`` without the lines and without the words of the spans (first word, words).

    A line that loses all its words to spans goes too; other white space stays.
    """
    kept, at, gone = [], 0, np.zeros(0, dtype=bool)
    if spans:
        gone = np.zeros(max(s + n for s, n in spans) + 1, dtype=bool)
        for s, n in spans:
            gone[s : s + n] = True
    for number, line in enumerate(text.split("\n")):
        found = list(_WORD.finditer(line)) if spans else []
        own = gone[at : at + len(found)]
        at += len(found)
        if number in lines or (len(own) and len(own) == len(found) and own.all()):
            continue
        if own.any():
            parts, begin = [], 0
            for word, out in zip(found, own.tolist()):
                if out:
                    parts.append(line[begin : word.start()])
                    begin = word.end()
                    while begin < len(line) and line[begin] in _BLANK:
                        begin += 1
            line = "".join([*parts, line[begin:]])
        kept.append(line)
    return "\n".join(kept)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", **settings) -> DataFrame:
    """The documents without what repeats a kept place: paragraphs, and passages within lines.

    All rows and columns come back. Texts without repetitions, null ones among them, stay as they
    are. ``n_chars``, where it is a column, follows the text. A document that loses everything
    has an empty text.
    """
    lines = repeated(docs, id_column, **settings).where("NOT kept").select(id_column, "text_hash", F.col("paragraph").alias("line"))
    spans = passages.passages(docs, id_column).where("NOT kept").select(id_column, "text_hash", F.struct("start", "n_words").alias("span"))
    identity, key, cut_lines, cut_spans = unused(docs, "id", "hash", "lines", "spans")
    cut = lines.unionByName(spans, allowMissingColumns=True).groupBy(F.col(id_column).alias(identity), F.col("text_hash").alias(key)).agg(
        F.collect_set("line").alias(cut_lines), F.collect_list("span").alias(cut_spans)
    )
    joined = docs.join(cut, F.col(id_column).eqNullSafe(F.col(identity)) & (F.xxhash64(text_of()) == F.col(key)), "left").drop(identity, key)
    names = docs.columns
    counted = "n_chars" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            hit = np.flatnonzero(pc.is_valid(columns[cut_lines]).to_numpy(zero_copy_only=False))
            if len(hit):
                texts = columns["text"].to_pylist()
                for i in hit.tolist():
                    spans_ = [(s["start"], s["n_words"]) for s in columns[cut_spans][i].as_py()]
                    texts[i] = cut_text(texts[i] or "", set(columns[cut_lines][i].as_py()), spans_)
                columns["text"] = pa.array(texts, columns["text"].type)
                if counted:
                    new = pc.utf8_length(columns["text"]).cast(columns["n_chars"].type)
                    mask = np.zeros(batch.num_rows, dtype=bool)
                    mask[hit] = True
                    columns["n_chars"] = pc.if_else(pa.array(mask), new, columns["n_chars"])
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return map_arrow(fewer_tasks(joined, docs.count(), TASK_TEXTS), run, docs.schema)
