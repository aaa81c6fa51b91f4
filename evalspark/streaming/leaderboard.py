"""Leaderboard over run files as they arrive (Structured Streaming).

Run results land as files one by one (one file per model x mode x task run).
The stream reads new files with an explicit schema, parses the pass ratio,
and keeps a running (model, mode) aggregate in the state store; the output
is the same leaderboard as the batch operator (ratio of sums + 95 %
half-width). Checkpoints go to the session's checkpoint folder, so a
restarted query resumes from its last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalspark.functions.rates import error_bar, parse_ratio, rate

RUN_FILE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("model", T.StringType()),
    T.StructField("mode", T.StringType()), T.StructField("pass_ratio", T.StringType()),
])


def stream_runs(spark: SparkSession, path: str, schema: T.StructType = RUN_FILE_SCHEMA,
                fmt: str = "parquet", max_files_per_trigger: int = 64) -> DataFrame:
    return (spark.readStream.schema(schema).format(fmt)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


def streaming_leaderboard(runs: DataFrame, by=("model", "mode")) -> DataFrame:
    """Running counts per group; rate and error bar are projections of the counts."""
    r = parse_ratio("pass_ratio")
    agg = runs.groupBy(*by).agg(F.count_if(r == 1.0).alias("n_pass"), F.count(F.lit(1)).alias("n_total"))
    return agg.select(*by, "n_pass", "n_total", F.round(rate("n_pass", "n_total"), 6).alias("pass_rate"),
                      F.round(error_bar("n_pass", "n_total"), 6).alias("err95"))


def start(spark: SparkSession, path: str, sink_table: str, checkpoint: str | None = None,
          fmt: str = "parquet") -> StreamingQuery:
    """Start the query into an in-memory table (tests / notebooks) with complete output."""
    from evalspark.sources.io import scratch_path
    ck = checkpoint or scratch_path(spark, "stream-leaderboard")
    lb = streaming_leaderboard(stream_runs(spark, path, fmt=fmt))
    return (lb.writeStream.outputMode("complete").format("memory").queryName(sink_table)
            .option("checkpointLocation", ck).start())


def distinct_runs(runs: DataFrame, keep: str = "7 days") -> DataFrame:
    """Rows of ``runs`` (a stream over files) without those of a run file that arrived before under the same name, in
    whatever folder: one row per file name and ``doc_id`` within ``keep`` of the files' times. State older than that is dropped."""
    named = runs.select("*", F.col("_metadata.file_name").alias("run_file"), F.col("_metadata.file_modification_time").alias("arrived"))
    return named.withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["run_file", "doc_id"])


def start_durable(spark: SparkSession, path: str, folder: str, checkpoint: str, fmt: str = "parquet", keep: str = "7 days",
                  available_now: bool = False) -> StreamingQuery:
    """Append the judged rows of new run files to ``folder`` (model, mode, passed). The file sink lists what a committed batch
    wrote, so each batch counts once however often it is tried, and a query started again on the same ``checkpoint``
    goes on after the last committed one. Both folders belong to the shared store. ``available_now``: stop when
    everything that is there has been read."""
    runs = distinct_runs(stream_runs(spark, path, fmt=fmt), keep)
    rows = runs.select("model", "mode", (parse_ratio("pass_ratio") == 1.0).alias("passed"))
    out = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", folder)
    return (out.trigger(availableNow=True) if available_now else out).start()


def durable_leaderboard(spark: SparkSession, folder: str, by=("model", "mode")) -> DataFrame:
    """The leaderboard of all batches committed to ``folder`` so far: counts (partial aggregates), rate and 95 % half-width."""
    rows = spark.read.schema("model string, mode string, passed boolean").parquet(folder)
    agg = rows.groupBy(*by).agg(F.count_if("passed").alias("n_pass"), F.count(F.lit(1)).alias("n_total"))
    return agg.select(*by, "n_pass", "n_total", F.round(rate("n_pass", "n_total"), 6).alias("pass_rate"),
                      F.round(error_bar("n_pass", "n_total"), 6).alias("err95"))
