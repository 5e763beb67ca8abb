"""Documents to packed training windows: quality, near copies, repeated passages, mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of ``documents``. Rows with a null id pass the stages that decide by id
together: they are one document to the near-copy stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleworks.llm import cotraining, mixing, near_copies, packing, paragraphs
from aisleworks.llm.common import TASK_TEXTS, by_merge, discard, fewer_tasks, materialised, unused
from aisleworks.llm.queries import table, vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Null and empty texts are scored like others; repeated rows get one verdict and stay repeated.
    """
    columns = tuple(docs.columns)
    return cotraining.classify(docs, table(spark, sf_dir, "labels"), carry=columns).where("kept").select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies.

    Near copies have a Jaccard similarity of at least 0.8 in shingles of five words; candidates have
    SimHashes that links of two bits join, or share a MinHash band. Rows that repeat that id stay:
    an id is one document.
    """
    (name,) = unused(docs, "first")
    first = near_copies.first_ids(docs).withColumnRenamed("doc_id", name)
    rows = docs.count()
    return fewer_tasks(docs.join(by_merge(first, rows), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi"), rows, TASK_TEXTS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs and passages that an earlier document holds already.

    Null texts stay null; rows that repeat id and text are cut alike; what loses all is empty.
    """
    return paragraphs.without_repeats(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and empty texts have no words and are never taken; null sources are one source.
    """
    return fewer_tasks(mixing.mixed_documents(docs), docs.count(), TASK_TEXTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens.

    Null texts are packed as their end token alone, repeated rows each time.
    """
    import public_tokenizers

    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each_group),
    ("substring_dedup", without_repeated_passages),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Classifier, SimHash, MinHash and tokens cannot be stated in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again, the one before it goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
