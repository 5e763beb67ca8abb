"""Near-duplicate vectors by iterative quantisation and several Hamming tables.

A rotation of the principal axes is learned so that the signs of the rotated vectors are
balanced, faithful codes (ITQ). Several rotations from different starts give one long code,
cut into substrings; every substring is the key of one table. Vectors that agree in a table are
candidates and are ranked with their original components in double precision. A pair that
meets in several tables counts in the first one only. Equal vectors are one class from the
start. Large buckets are cut into blocks; a block returns counts per vector and a spanning
forest of its links, never its pairs.

Substrings lengthen with the logarithm of the number of vectors, so that a bucket keeps its
size, and tables are added as longer substrings agree less often. Vectors of each length have
buckets of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleworks.llm.common import bounded_groups, components, forest, map_arrow, materialised

#: Rows the rotations are fitted on; every row is indexed.
FIT_ROWS = 8192
#: Lengths a rotation is fitted for, the most frequent ones; each needs ``FIT_PER_DIMENSION``
#: sampled rows a dimension. Vectors of other lengths are coded by a rotation drawn at random.
FITTED, FIT_PER_DIMENSION = 16, 4
#: Least bits of a substring, members that a bucket has on average, and the share of the pairs at
#: the threshold that some table has to bring together (nearer pairs are found surely).
BITS, BUCKET, RECALL = 12, 128, 0.965
ITERATIONS = 30
COSINE = 0.9
BLOCK = 512


def shape(n: int, cosine: float = COSINE, least: int = BITS) -> tuple[int, int]:
    """(tables, bits of a table) for ``n`` vectors.

    One bit of a pair at ``cosine`` differs with a chance of its angle over pi (0.14 at 0.9).
    """
    bits = min(30, max(least, math.ceil(math.log2(max(1, n) / BUCKET))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - RECALL) / math.log1p(-agree)) if agree < 1 else 1, bits


class Quantiser:
    """Rotations; codes are the signs of the rotated unit vectors.

    The sample is taken with its mirror image, so nothing is subtracted: to centre on a mean that
    lies in a dense group would spread the group's angles, and its links would be missed.
    """

    @classmethod
    def drawn(cls, dims: int, bits: int) -> Quantiser:
        """Directions by the length alone, for vectors too few to learn from."""
        self = cls.__new__(cls)
        self.projection = np.random.default_rng(dims).standard_normal((dims, bits))
        return self

    def __init__(self, unit: np.ndarray, bits: int, iterations: int = ITERATIONS, seed: int = 5):
        dims = unit.shape[1]
        _, axes = np.linalg.eigh(unit.T @ unit)
        axes = axes[:, ::-1]
        random = np.random.default_rng(seed)
        projections = []
        for _ in range(-(-bits // dims)):
            rotation, _ = np.linalg.qr(random.standard_normal((dims, dims)))
            data = unit @ axes
            for _ in range(iterations):
                codes = np.where(data @ rotation >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(codes.T @ data)
                rotation = (u @ v).T
            projections.append(axes @ rotation)
        self.projection = np.concatenate(projections, axis=1)[:, :bits]

    def substrings(self, unit: np.ndarray, tables: int, bits: int) -> np.ndarray:
        """(rows, tables) of table keys."""
        signs = (unit @ self.projection >= 0).reshape(len(unit), tables, bits)
        return (signs * (1 << np.arange(bits))).sum(axis=2)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / np.where(scale > 0, scale, 1)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _models(classes: DataFrame, fit_rows: int, bits: int) -> dict[int, Quantiser]:
    """Quantisers by vector length, fitted on ``fit_rows`` rows in all."""
    lengths = [r[0] for r in classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(FITTED).collect()]
    out = {}
    for dims in lengths:
        rows = classes.where(F.col("dims") == dims).orderBy(F.xxhash64(F.lit(23), F.col("rep")), "rep").limit(fit_rows // len(lengths))
        sample = rows.select("_v").toArrow()  # bounded by fit_rows
        if sample.num_rows >= FIT_PER_DIMENSION * dims:
            out[dims] = Quantiser(_unit(_matrix(sample.column(0).combine_chunks(), dims)), bits)
    return out


def near_vectors(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cosine: float = COSINE,
    fit_rows: int = FIT_ROWS, least_bits: int = BITS,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing;
    vectors of any one length are compared with each other. ``component_id`` is the smallest id
    that links reach. Repeated rows count as separate vectors with one id. Rows with a null id
    link and are counted like others, but a null is never the smallest id: their ``component_id``
    is null, and they are kept, where no id is reached. An empty table gives no rows; other
    columns are ignored. The classes are written, counted and sampled while the query is built.
    """
    base = vectors.select(F.col(id_column), F.col(column).cast("array<double>").alias("_v"))
    valid = F.coalesce(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0), F.lit(False))
    # A class is named by its smallest id; one of rows without ids by a hash, marked to sort behind all ids.
    classes = materialised(
        base.where(valid).groupBy("_v").agg(F.min(id_column).cast("long").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .select("_v", F.col("first_id").isNull().cast("int").alias("missing"), F.coalesce("first_id", F.xxhash64("_v")).alias("rep"), "copies", F.size("_v").alias("dims")),
        "vector-classes",
    )
    tables, bits = shape(classes.count(), cosine, least_bits)
    models = _models(classes, fit_rows, tables * bits)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(models)
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            for dims in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dims))
                if dims not in known:
                    known[dims] = Quantiser.drawn(dims, tables * bits)
                unit = _unit(_matrix(part.column("_v"), dims))
                keys = known[dims].substrings(unit, tables, bits)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.astype(np.int32).ravel()), tables).cast(pa.list_(pa.int32()))
                raw = pa.array([v.tobytes() for v in unit], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("dims", "missing", "rep", "copies")), raw, listed], names=["dims", "missing", "rep", "copies", "unit", "keys"])

    coded = map_arrow(classes.select("_v", "dims", "missing", "rep", "copies"), code, "dims int, missing int, rep long, copies long, unit binary, keys array<int>")
    members = coded.select("*", F.posexplode("keys").alias("table", "key"))
    groups = bounded_groups(members, ["dims", "table", "key"], "rep", BLOCK)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            rows = batch.column("members")
            flat = rows.flatten()
            ends = np.cumsum(pc.list_value_length(rows).to_numpy())
            first, second = batch.column("first").to_numpy(), batch.column("second").to_numpy()
            missing, reps, copies, own = (flat.field(c).to_numpy() for c in ("missing", "rep", "copies", "block"))
            units = flat.field("unit").to_pylist()
            keys = flat.field("keys").flatten().to_numpy().reshape(-1, tables)
            for i, (table, dims) in enumerate(zip(batch.column("table").to_pylist(), batch.column("dims").to_pylist())):
                s, e = int(ends[i - 1]) if i else 0, int(ends[i])
                unit = np.frombuffer(b"".join(units[s:e]), dtype=np.float64).reshape(-1, dims)
                near = unit @ unit.T >= cosine
                if first[i] != second[i]:  # pairs within one block belong to its own row
                    near &= own[s:e, None] != own[None, s:e]
                a, b = np.nonzero(np.triu(near, 1))
                if not len(a):
                    continue
                if table:  # met in an earlier table
                    new = ~(keys[s + a, :table] == keys[s + b, :table]).any(axis=1)
                    a, b = a[new], b[new]
                    if not len(a):
                        continue
                links = np.bincount(a, weights=copies[s + b], minlength=e - s) + np.bincount(b, weights=copies[s + a], minlength=e - s)
                joined = np.zeros((e - s, e - s), dtype=bool)
                joined[a, b] = joined[b, a] = True
                some = s + np.flatnonzero(links)
                root = s + forest(joined)[some - s]
                for column_, values in zip(out, (missing[some], reps[some], links[some - s], missing[root], reps[root])):
                    column_.append(values.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["missing", "rep", "links", "root_missing", "root"])

    found = materialised(
        map_arrow(groups.select("dims", "table", "first", "second", "members"), rank, "missing long, rep long, links long, root_missing long, root long"), "vector-links"
    )
    linked = found.groupBy("missing", "rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.struct("missing", "rep").alias("a"), F.struct(F.col("root_missing").alias("missing"), F.col("root").alias("rep")).alias("b")))
    joined = joined.select(F.col("node.missing").alias("missing"), F.col("node.rep").alias("rep"), "component")
    smallest = F.coalesce("component", F.struct(F.col("missing").cast("long").alias("missing"), "rep"))
    per_class = (
        classes.join(linked, ["missing", "rep"], "left").join(joined, ["missing", "rep"], "left")
        .select(F.col("_v").alias("_class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(smallest["missing"] == 0, smallest["rep"]).alias("component_id"))
    )
    return (
        base.join(per_class, valid & (F.col("_v") == F.col("_class")), "left")
        .select(
            id_column, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", F.col(id_column).cast("long")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
    )
