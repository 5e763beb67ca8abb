"""Near copies among whole documents: SimHash and MinHash candidates, exact Jaccard of five-word shingles.

Every text gets the SimHash of ``simhash.py``; texts whose fingerprints its links of at most two
bits join are candidates. At a Jaccard similarity of 0.8 two 64-bit SimHashes differ in about ten
bits and often in more, and within that radius segment counts no longer tell documents apart, so
the two-bit grid cannot be widened. Pairs further apart are found as well: they come from the
MinHash bands of ``paragraphs.py`` (probability 0.998 at 0.8), over the words of the whole
document. Candidates of both kinds are checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm import simhash
from aisleworks.llm.common import SLICE_BYTES, TASK_TEXTS, bounded_groups, by_merge, components, discard, encoded, fewer_tasks, map_arrow, materialised, slices, text_of
from aisleworks.llm.paragraphs import BANDS, BLOCK, SIMILARITY, WORDS, bands, set_forest, shingles


def documents(docs: DataFrame, id_column: str = "doc_id", words: int = WORDS) -> DataFrame:
    """Every row: id, h (hash of the normalised text), fp (its SimHash), bands and body; without words no bands."""
    schema = T.StructType([
        T.StructField("_id", docs.schema[id_column].dataType), T.StructField("h", T.BinaryType()),
        T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("body", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "_text"):
            body = [b" ".join(t.lower().split()) for t in encoded(batch, "_text")]
            full = [b for b in body if b]
            keys = bands(*shingles(full, words)).view(np.int64).ravel() if full else np.zeros(0, dtype=np.int64)
            ends = np.concatenate(([0], np.cumsum([BANDS if b else 0 for b in body])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([xxhash.xxh3_128_digest(b) for b in body], pa.binary()), pa.array([simhash.fingerprint(b) for b in body], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys)), pa.array(body, pa.binary())],
                names=[f.name for f in schema],
            )

    return map_arrow(docs.select(F.col(id_column).alias("_id"), text_of().alias("_text")), run, schema)


def shingle_sets(bodies: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of many documents and the document of each, a few megabytes of text at a time."""
    hashes, owner = [], []
    start = 0
    while start < len(bodies):
        stop, size = start + 1, len(bodies[start])
        while stop < len(bodies) and size + len(bodies[stop]) <= SLICE_BYTES:
            size += len(bodies[stop])
            stop += 1
        found, edges = shingles(bodies[start:stop], words)
        for i in range(stop - start):
            own = np.unique(found[edges[i] : edges[i + 1]])
            hashes.append(own)
            owner.append(np.full(len(own), start + i))
        start = stop
    return np.concatenate(hashes), np.concatenate(owner)


def links(candidates: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """Spanning edges (a, b) between members (member, body) of a bucket that are alike; members meet in blocks."""
    groups = bounded_groups(candidates, ["bucket"], "member", BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            rows = batch.column("members")
            flat, offsets = rows.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(rows).to_numpy())))
            members, bodies = flat.field("member").to_numpy(zero_copy_only=False), flat.field("body")
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                root = set_forest(*shingle_sets(bodies.slice(s, e - s).to_pylist(), words), e - s, similarity)
                moved = np.flatnonzero(root != np.arange(e - s))
                a.append(members[s:e][moved])
                b.append(members[s:e][root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], names=["a", "b"])

    return map_arrow(groups.select("members"), run, "a long, b long")


def print_buckets(classes: DataFrame, rows: int) -> DataFrame:
    """(member, bucket): members (member, fp) whose fingerprints links of at most two bits join share a bucket.

    There are at most ``rows`` members.
    """
    prints = materialised(fewer_tasks(classes.groupBy("fp").agg(F.min("member").alias("rep")), rows), "fingerprint-classes")
    reached = components(simhash.links(prints, "rep"), rows=rows)
    joined = prints.join(by_merge(reached, rows), prints["rep"] == reached["node"], "left").select("fp", F.coalesce("component", "rep").alias("_root"))
    return classes.join(by_merge(joined, rows), "fp").select("member", F.xxhash64(F.lit("simhash"), "_root").alias("bucket"))


def first_ids(docs: DataFrame, id_column: str = "doc_id", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The smallest id of every group that links of at least ``similarity`` join, once each.

    Documents with equal words are one; those without words (null, empty, white space) are
    linked with each other. A null id is the smallest only where a group has no other.
    """
    found = materialised(documents(docs, id_column, words).withColumn("_row", F.monotonically_increasing_id()), "documents")
    # One row stands for all documents with the same words; its number names the class.
    n = found.count()
    classes = found.groupBy("h").agg(F.min("_row").alias("member"), F.min("_id").alias("first"), F.first("fp").alias("fp"))
    classes = materialised(fewer_tasks(classes, n), "document-classes").select("member", "first", "fp")
    banded = found.select(F.col("_row").alias("member"), "bands").join(classes.select("member").hint("merge"), "member", "left_semi")
    banded = banded.select("member", F.explode("bands").alias("bucket")).unionByName(print_buckets(classes.select("member", "fp"), n))
    banded = materialised(fewer_tasks(banded, n * (BANDS + 1)), "document-bands")
    several = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    met = materialised(fewer_tasks(banded.join(several.hint("merge"), "bucket"), n * (BANDS + 1)), "bucket-members")
    # Buckets with the same members are one.
    name = F.xxhash64("member")
    alike = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(name).alias("x"), F.sum(F.shiftright(name, 24)).alias("s"))
    alone = materialised(fewer_tasks(alike.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket"), n * (BANDS + 1)), "buckets")
    met = met.join(by_merge(alone, alone.count()), "bucket")
    bodies = found.select(F.col("_row").alias("member"), "body").join(met.select("member").distinct().hint("merge"), "member", "left_semi")
    bodies = materialised(fewer_tasks(bodies, n, TASK_TEXTS), "bodies")
    discard(found, banded)
    reached = components(links(met.join(by_merge(bodies, n, TASK_TEXTS), "member"), similarity, words), rows=n)
    discard(bodies)
    rooted = classes.join(by_merge(reached, n), classes["member"] == reached["node"], "left")
    return rooted.groupBy(F.coalesce("component", "member")).agg(F.min("first").alias(id_column)).select(id_column).distinct()
