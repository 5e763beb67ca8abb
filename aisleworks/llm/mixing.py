"""Mixing sources to target weights by weighted sampling without replacement, in built-in functions.

Targets: sources share the mix by weight; none gets more than ``cap`` times its size, and the
excess goes to the others by weight until none is above. Complete epochs of a source come
first. The rest of its target is drawn by Efraimidis-Spirakis keys: document ``d`` gets the
exponential key ``-ln(u_d) / quality_d`` with a hashed ``u_d``, documents are sorted by key
within their source and taken while the running size is within the budget; a document too
large for what is left is passed over for smaller ones of its bucket.

The order within a source is never one task: ``exp(-key)`` lies in (0, 1), so the key's range
is cut into buckets in number of the source's documents. Running sums are taken inside buckets,
and the buckets' own sums are added up in a table of one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from aisleworks.llm.common import TASK_TEXTS, by_merge, materialised, text_of, unused

#: Words are runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents of a source per bucket of keys.
BUCKET = 4096
#: Weight of a document that is mostly markup or symbols, against 1 for plain prose.
POOR = 0.25


def quality_weight(text: Column, size: Column) -> Column:
    """1 for prose, ``POOR`` where symbols are more than a tenth of the words."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.when(symbols * 10 > size, F.lit(POOR)).otherwise(F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add ``target`` to one row per source with ``source`` and ``source_size``.

    Sources in code-point order, null last, take the weights in turn. Sources are sorted by
    the level at which they reach their cap; the level of the first that does not is the level
    of all that follow. The table has one row per source.
    """
    everything, by_name = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    by_level = W.orderBy("_reach", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    return (
        sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
        .withColumn("_most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_reach", F.col("_most") / F.col("_w"))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(by_level), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_level), F.lit(0.0))))
        .withColumn("_level", F.max(F.when(F.col("_reach") > F.col("_level"), F.col("_level"))).over(everything))
        .withColumn("target", F.coalesce(F.least("_most", F.col("_level") * F.col("_w")), F.lit(0.0)))
        .drop("_w", "_most", "_reach", "_level")
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 11, id_column: str = "doc_id",
    quality=quality_weight,
) -> DataFrame:
    """How often each document goes into the mix.

    Columns: the id, source, text_hash, size (words), source_size, target, copies, taken
    (copies times size). Null texts and texts without words have size 0 and come along in
    complete epochs only; null sources are one source, last in order. Rows that repeat an id
    and text get the same number of copies. Empty tables give no rows; other columns are
    ignored. The same rows always give the same mix.
    """
    text = text_of()
    slim = materialised(
        docs.select(id_column, F.col("source").cast("string").alias("source"), text.alias("_text"))
        .select(id_column, "source", "_text", F.regexp_count("_text", F.lit(WORD)).cast("long").alias("size"))
        .select(
            id_column, "source", "size", F.xxhash64("_text").alias("text_hash"),
            (-F.log((F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_column)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))) / quality(F.col("_text"), F.col("size"))).alias("_key"),
        ),
        "mix-keys",
    )
    sources = materialised(
        targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")), weights, cap)
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .withColumn("_buckets", F.ceil(F.col("_docs") / F.lit(BUCKET)))
        .withColumnRenamed("source", "_source"),
        "mix-sources",
    )
    dealt = slim.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_bucket", F.least(F.floor((1 - F.exp(-F.col("_key"))) * F.col("_buckets")), F.col("_buckets") - 1)
    )
    inner = ["source", "_bucket", "_key", id_column, "size", "text_hash"]
    peers, bucket = W.partitionBy(*inner), W.partitionBy("source", "_bucket")
    upto = W.partitionBy("source", "_bucket").orderBy(*inner[2:])  # ends with the row's equals
    ranked = dealt.withColumn("_inside", F.sum("size").over(upto) - F.sum("size").over(peers)).withColumn("_own", F.sum("size").over(peers))
    bases = materialised(
        dealt.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_base"),
        "mix-buckets",
    )
    return (
        ranked.join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_left", F.col("_rest") - F.col("_base"))
        .withColumn("_fits", (F.col("_inside") + F.col("_own") <= F.col("_left")) & (F.col("size") > 0))
        # The first that does not fit is passed over, and smaller ones after it fill what is left.
        .withColumn("_left", F.col("_left") - F.coalesce(F.max(F.when(F.col("_fits"), F.col("_inside") + F.col("_own"))).over(bucket), F.lit(0)))
        .withColumn("_small", ~F.col("_fits") & (F.col("_own") <= F.col("_left")) & (F.col("size") > 0))
        .withColumn("_fits", F.col("_fits") | (F.col("_small") & (F.sum(F.when(F.col("_small"), F.col("size"))).over(upto) <= F.col("_left"))))
        .withColumn("copies", F.col("_epochs") + F.col("_fits").cast("long"))
        .select(id_column, "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", **settings) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    identity, source, key, copies, copy = unused(docs, "id", "source", "hash", "copies", "copy")
    taken = (
        mix(docs, id_column=id_column, **settings).where("copies > 0")
        .select(F.col(id_column).alias(identity), F.col("source").alias(source), F.col("text_hash").alias(key), F.col("copies").alias(copies))
        .distinct()
    )
    same = (
        F.col(id_column).eqNullSafe(F.col(identity)) & F.col("source").cast("string").eqNullSafe(F.col(source))
        & (F.xxhash64(text_of()) == F.col(key))
    )
    return docs.join(by_merge(taken, docs.count(), TASK_TEXTS), same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
