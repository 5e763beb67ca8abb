"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

A fingerprint is embedded as the bit counts of its 16 segments of four bits. Every bit that
differs moves one count by one at most, so the Manhattan distance of two embeddings is a lower
bound of the Hamming distance of the fingerprints. Two embeddings within distance two always
have a grid cell within distance one of both: each distinct fingerprint is put into its own
cell and the neighbouring ones, fingerprints that share a cell are candidates, and the exact
distance is verified. Large cells are cut into blocks, and a block only returns a spanning
forest of its links, so no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm.common import bounded_groups, by_merge, components, encoded, forest, map_arrow, materialised, slices, text_of

SEGMENTS = 16
BLOCK = 512
#: Fingerprints cover this many shingles at a time, so that very long texts need little memory.
_STEP = 1 << 15


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of one text (signed 64-bit): ASCII lower case, word shingles, majority per bit."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    k = min(words, len(tokens))
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest, n = xxhash.xxh64_intdigest, len(tokens) - k + 1
    pairs = list(zip(starts[:n].tolist(), ends[k - 1 :].tolist()))
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, _STEP):
        hashes = np.array([digest(joined[s:e], seed) for s, e in pairs[a : a + _STEP]], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) of every row; null and empty texts have fingerprint zero."""
    schema = T.StructType([docs.schema[id_column], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            prints = [fingerprint(t, words, seed) for t in encoded(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=[f.name for f in schema])

    return map_arrow(docs.select(id_column, text_of().alias("_text")), run, schema)


def _counts(fp: Column) -> Column:
    """Bit counts of the 16 segments, four bits each, in one long."""
    ones = F.lit(0x1111111111111111)
    out = fp.bitwiseAND(ones)
    for i in (1, 2, 3):
        out = out + F.shiftrightunsigned(fp, i).bitwiseAND(ones)
    return out


def _cells(fp: Column) -> Column:
    """The fingerprint's own cell and its neighbours that lie in the grid."""
    own = _counts(fp)
    around = [own]
    for i in range(SEGMENTS):
        at = F.shiftrightunsigned(own, 4 * i).bitwiseAND(F.lit(15))
        around += [F.when(at > 0, own - F.lit(1 << (4 * i))), F.when(at < 4, own + F.lit(1 << (4 * i)))]
    return F.array_compact(F.array(*around))


def links(prints: DataFrame, id_column: str, distance: int = 2) -> DataFrame:
    """Edges (a, b) between representatives of fingerprints at most ``distance`` (2 or less) apart.

    ``prints`` has one row per distinct fingerprint. The edges span the components of the
    linked fingerprints; they are not all links.
    """
    if distance > 2:
        raise ValueError("the grid covers distances up to two")
    members = prints.select(F.col(id_column).alias("rep"), "fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    groups = bounded_groups(members, ["cell"], "rep", BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            rows = batch.column("members")
            flat, offsets = rows.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(rows).to_numpy())))
            reps, prints_ = flat.field("rep").to_numpy(zero_copy_only=False), flat.field("fp").to_numpy().view(np.uint64)
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                near = np.bitwise_count(prints_[s:e, None] ^ prints_[None, s:e]) <= distance
                if e - s == 2:
                    if near[0, 1]:
                        a.append(reps[s : s + 1])
                        b.append(reps[s + 1 : e])
                    continue
                root = forest(near)
                moved = np.flatnonzero(root != np.arange(e - s))
                a.append(reps[s:e][moved])
                b.append(reps[s:e][root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], names=["a", "b"])

    return map_arrow(groups.select("members"), run, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", words: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 lower-case hex digits), component_id.

    ``component_id`` is the smallest id that links reach, itself included; links join
    fingerprints with at most ``distance`` differing bits. Texts without words (null, empty,
    white space) all have fingerprint zero and so are linked with each other. Repeated rows
    stay. A null id is never the smallest; documents of a fingerprint with null ids only have
    a null component. Empty tables give no rows. Other columns are ignored.
    """
    prints = materialised(fingerprints(docs, id_column, words, seed), "fingerprints")
    reps = materialised(prints.groupBy("fp").agg(F.min(id_column).cast("long").alias("rep")), "fingerprint-classes")
    found, n = components(links(reps.where("rep IS NOT NULL"), "rep", distance)), reps.count()
    classes = reps.join(by_merge(found, n), reps["rep"] == found["node"], "left").select(
        F.col("fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(by_merge(classes, n), "fp").select(
        id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
