"""Counting and bounded ranking (word counts, k-th most frequent, top-k).

Counts are partial aggregates (a hot word costs one row per map task); the
global ranking is ``orderBy().limit()`` (per-partition top-k, then a merge)
and per-group top-k is ``row_number() <= k``, planned with a partial
``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD_SPLIT = r"[^\p{L}]+"


# B1 -------------------------------------------------------------------------
def word_counts(df: DataFrame, text: str, split: str = WORD_SPLIT, lower: bool = True) -> DataFrame:
    t = F.lower(F.col(text)) if lower else F.col(text)
    w = df.select(F.explode(F.split(t, split)).alias("word")).filter(F.col("word") != "")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, k: int) -> DataFrame:
    """The k+1 most frequent words, ranked by count desc then word asc, with 0-based rank ``k``."""
    top = counts.orderBy(F.desc("n"), "word").limit(k + 1)
    return top.withColumn("k", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).cast("int"))


def kth_frequent_word(counts: DataFrame, k: int) -> DataFrame:
    """One row: the k-th (0-based) most frequent word and its count; nulls past the end."""
    spark = counts.sparkSession
    hit = top_words(counts, k).filter(F.col("k") == k).select("word", "n")
    probe = spark.range(1).select(F.lit(k).cast("int").alias("k"))
    return probe.join(hit.withColumn("k", F.lit(k).cast("int")), "k", "left").select("k", "word", "n")


# B2 -------------------------------------------------------------------------
def top_k(df: DataFrame, score: str, k: int, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The k smallest scores (equal scores: the earlier by ``tie``), per group if
    ``by``; ``cutoff`` is the k-th smallest score of the group (k = 0 gives no rows)."""
    if not by:
        top = df.orderBy(score, *tie).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(score, *tie)).cast("int")) \
            .withColumn("cutoff", F.max(score).over(Window.partitionBy(F.lit(1))))
    w = Window.partitionBy(*by).orderBy(score, *tie)
    t = df.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
    return t.withColumn("cutoff", F.max(score).over(Window.partitionBy(*by)))
