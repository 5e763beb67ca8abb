"""The operators of this package bound to the given tables, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleworks.llm import cotraining, itq, language, mixing, packing, paragraphs, passages, periods, rules, simhash, spelling, templates, token_counts, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def bound(key: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; every executor has the package installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@bound("op1_packing")
def op1_packing(spark, sf_dir):
    import public_tokenizers

    packed = packing.pack(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@bound("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = paragraphs.repeated(docs).withColumn("kind", F.lit("paragraph")).drop("text_hash")
    spans = passages.passages(docs).withColumn("kind", F.lit("passage")).drop("text_hash")
    return lines.unionByName(spans, allowMissingColumns=True)


@bound("op3_quality_classifier")
def op3_quality_classifier(spark, sf_dir):
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@bound("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@bound("op9_simhash")
def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@bound("op6_mixing")
def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@bound("op8_quality_rules", rules.statement())
def op8_quality_rules(spark, sf_dir):
    return rules.judge(table(spark, sf_dir, "documents"))


@bound("op5_language")
def op5_language(spark, sf_dir):
    return language.predict(table(spark, sf_dir, "documents"))


@bound("op10_html_extraction")
def op10_html_extraction(spark, sf_dir):
    return templates.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@bound("op7_embedding_near_dedup")
def op7_embedding_near_dedup(spark, sf_dir):
    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


@bound("op11_token_files")
def op11_token_files(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    files = token_files.write(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_files.read_documents(spark, files, docs.schema["doc_id"].dataType)


@bound("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    return periods.periodic_runs(periods.with_cycles(table(spark, sf_dir, "documents")))


@bound("op13_spelling_variants")
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"), slips=31)
