"""Corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination,
source mixing, token files.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
its result is written as Parquet and read again. All but the last return the columns
of ``documents``; the last returns the index read back from the token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import op02_simhash, op03_mixing, op05_quality, op07_decontaminate, op10_token_files
from evalspark.llm.common import read, stored

SAMPLE_SHARE = 0.5  # of the tokens that reach the mixing stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. A row is judged by its text: null and empty texts have one
    score, repeated rows go together, null ids are of no concern; an empty table stays empty."""
    return op05_quality.drop_low_quality(docs, read(spark, sf_dir, "labels"), "doc_id", "text", "quality", threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id. Null and empty texts are one group;
    rows that share the id that stays all stay; a row with a null id stays only where its whole group has none."""
    return op02_simhash.drop_near_duplicates(docs, "doc_id", "text", shingle=3, radius=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Null and empty texts stay; repeated rows, with or without an
    id, go together; an empty benchmark drops nothing."""
    return op07_decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of ``SAMPLE_SHARE`` of the tokens whose shares follow the target weights as far as the tokens reach. Null
    sources and languages are a category; texts without words are drawn like others; rows with the same (or
    no) id are drawn together."""
    return op03_mixing.sample_mixture(docs, id_col="doc_id", text_col="text", share=SAMPLE_SHARE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and their index: doc_id, start, n_tokens, ids_crc32. Null texts are empty documents, null ids come first,
    repeated rows are written each; an empty table has an empty index."""
    import public_tokenizers

    return op10_token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate),
          ("source mixing", mix), ("token files", tokens)]

ORACLE_SQL = None  # training, fingerprints and tokenisation are no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
