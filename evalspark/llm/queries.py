"""The training-data operators bound to the driver tables, with DuckDB statements
where SQL can express them. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import (op01_repeats, op02_simhash, op03_mixing, op04_warc, op05_quality, op06_iblt, op07_decontaminate,
                           op08_pii, op09_line_chunks, op10_token_files, op11_bpe_transducer, op12_whitening,
                           op13_spelling_variants)
from evalspark.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_repeats.remove_repeats(read(spark, sf_dir, "documents"), "doc_id", "text", length=200).drop("kept")


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_simhash.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, radius=2)


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op03_mixing.mix(read(spark, sf_dir, "documents"), share=0.5)
    return mixed.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
                        F.col("_tokens").alias("n_tokens"), F.round("_weight", 9).alias("cell_weight"),
                        F.round("_rate", 9).alias("rate"), F.col("_sampled").alias("sampled"))


@query
def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = op04_warc.warc_round_trip(read(spark, sf_dir, "pages"), "page_id", "url", "html", min_bytes=100)
    return records.drop("target_uri", "payload")


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_iblt.fingerprints(read(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op07_decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_pii.report(read(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op09_line_chunks.remove_repeated_chunks(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op9_line_chunks"] = op09_line_chunks.ORACLE


@query
def op10_token_files_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op10_token_files.token_files(read(spark, sf_dir, "documents"),
                                        public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query
def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return op11_bpe_transducer.digests(read(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening.whiten(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=32)


@query
def op13_spelling_variants_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = op13_spelling_variants.corpus_words(read(spark, sf_dir, "documents"), "doc_id", "text", min_chars=7, min_count=2, slip=31)
    return op13_spelling_variants.variants(words, ratio=10)


ORACLE_SQL["op13_spelling_variants_trie"] = op13_spelling_variants.ORACLE
