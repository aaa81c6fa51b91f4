"""Scans and sinks for run results, records, checkpoints and reports.

Everything is a Spark reader / writer with an explicit schema; nested text
is parsed once at ingest. Run identity comes from the file name
(``_metadata.file_name``) or from partition directories, so pruning by
model / mode is a partition filter, not a directory listing in Python.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.rates import parse_run_name

RECORD_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("usage_line", T.IntegerType()),
    T.StructField("def_line", T.IntegerType()), T.StructField("scope_type", T.StringType()),
    T.StructField("range_type", T.StringType())])
REASON_SCHEMA = T.StructType([
    T.StructField("reason_category", T.StringType()), T.StructField("usage_line", T.IntegerType())])
CHECKPOINT_SCHEMA = T.StructType([
    T.StructField("Task_Name", T.StringType()),
    T.StructField("LN_range", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("output_to_check", T.StringType()),
    T.StructField("checkpoint_LN_infilling", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("checkpoint_LN_Completion", T.ArrayType(T.ArrayType(T.IntegerType())))])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (the shared folder)."""
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        from evalspark.session import ensure_checkpoint_dir
        base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _csv(spark: SparkSession, schema: T.StructType, on_corrupt: str = "FAILFAST"):
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("mode", on_corrupt))


# S1 / S2 / S9 ---------------------------------------------------------------
def scan_runs(spark: SparkSession, path: str, schema: T.StructType, model: str | None = None,
              mode: str | None = None, task: str | None = None, stamp: str | None = None,
              on_corrupt: str = "FAILFAST") -> DataFrame:
    """Read result CSVs (only ``*.csv``) of a folder or one file; attach run identity.

    A row that does not fit the schema raises (``on_corrupt``: Spark's CSV ``mode``).
    Quoted line breaks make one file one task: for more than one pass over large runs,
    store them with :func:`write_runs` after the first read.

    A single file is one group ``single_file``; a missing path is an error.
    Identity comes from the file name ``model_mode_task_stamp.csv`` (P1) or,
    for a partitioned layout, from the ``run_name`` partition column.
    Filters on model / mode / task / stamp are column filters (S9), so a
    layout partitioned by them is pruned at planning time.
    """
    try:
        df = _csv(spark, schema, on_corrupt).csv(path, pathGlobFilter="*.csv")
        files = df.inputFiles()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise ValueError(f"Invalid path: {path}") from e
    single = len(files) == 1 and files[0].rsplit("/", 1)[-1] == path.rstrip("/").rsplit("/", 1)[-1]
    df = df.withColumn("_file", F.col("_metadata.file_name"))
    if "run_name" not in df.columns:
        df = df.withColumn("run_name", F.regexp_replace("_file", r"\.csv$", ""))
    df = df.withColumn("_id", parse_run_name("run_name"))
    df = df.select(*[c for c in df.columns if c not in ("_id", "_file")],
                   F.col("_id.model").alias("model"), F.col("_id.mode").alias("mode"),
                   F.col("_id.task").alias("task"), F.col("_id.stamp").alias("stamp"),
                   F.lit("single_file" if single else None).cast("string").alias("group"))
    for c, v in (("model", model), ("mode", mode), ("task", task), ("stamp", stamp)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def union_scans(spark: SparkSession, paths: list[str], schema: T.StructType, **filters) -> DataFrame:
    """``scan_runs`` of several folders and files, stacked; columns a path lacks are null."""
    if not paths:
        raise ValueError("no path to scan")
    out = None
    for path in paths:
        df = scan_runs(spark, path, schema, **filters)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# K1 -------------------------------------------------------------------------
def write_runs(df: DataFrame, path: str, fmt: str = "parquet", partition_by=("model", "mode")) -> None:
    """Store runs partitioned by model and mode (parquet default, CSV with header optional)."""
    # rebalance: rows of a partition value go to few files; AQE splits a hot value
    w = df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_run_files(df: DataFrame, path: str) -> None:
    """One CSV folder per run (``run_name=<name>``), header, no index."""
    df.hint("rebalance", "run_name").write.mode("overwrite").partitionBy("run_name") \
        .option("header", True).option("escape", '"').csv(path)


# S3 -------------------------------------------------------------------------
def scan_records(spark: SparkSession, path: str, kind: str = "dependency") -> DataFrame:
    """Verified record CSVs; empty files give no rows, blank lines are dropped.

    Python files call the name column ``var_name``: it is read positionally
    under the unified name ``name``. Language comes from the path, the task
    from the file name ``<task>_dependency_verified.csv`` or from a
    ``code_task=`` partition folder.
    """
    schema = RECORD_SCHEMA if kind == "dependency" else REASON_SCHEMA
    df = _csv(spark, schema).csv(path, pathGlobFilter="*.csv")
    part = F.col("code_task") if "code_task" in df.columns else F.lit(None).cast("string")
    df = df.na.drop("all", subset=schema.fieldNames())
    from_name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_(dependency|reason)_verified\.csv$", 1)
    return df.select(*schema.fieldNames(),
                     F.regexp_extract(F.col("_metadata.file_path"), r"/(Python|Java)/", 1).alias("language"),
                     F.coalesce(part.cast("string"), F.nullif(from_name, F.lit(""))).alias("code_task"))


# S4 -------------------------------------------------------------------------
def scan_checkpoints(spark: SparkSession, path: str, kind: str = "infilling", multiline: bool = True) -> DataFrame:
    """Task JSON -> one row per (task, checkpoint, start, end) with ``output_to_check``.

    ``multiline=True`` reads one JSON array (or object) per file, as the
    harness stores them; ``False`` reads JSON Lines (one task per line)."""
    col = {"infilling": "checkpoint_LN_infilling", "completion": "checkpoint_LN_Completion",
           "whole": "LN_range"}[kind]
    # a top-level JSON array yields one row per element
    raw = spark.read.option("multiLine", multiline).schema(CHECKPOINT_SCHEMA).json(path)
    return raw.select(F.col("Task_Name").alias("task"), "output_to_check",
                      F.posexplode(col).alias("ckpt_no", "rng")).select(
        "task", "output_to_check", "ckpt_no", F.col("rng")[0].alias("start_line"),
        F.col("rng")[1].alias("end_line"))


# S5 -------------------------------------------------------------------------
def scan_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """language -> task -> base path; derive the test path and extension."""
    txt = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", "map<string, map<string, string>>")
    lang = txt.select(F.explode(m).alias("language", "tasks"))
    t = lang.select("language", F.explode("tasks").alias("task", "base_path"))
    ext = F.when(F.lower("language") == "python", F.lit(".py")).when(F.lower("language") == "java", F.lit(".java"))
    return t.select("language", "task", "base_path", ext.alias("extension"),
                    F.concat("base_path", F.lit("/"), F.col("task"), F.lit(".json")).alias("test_path"))


def require_task(catalogue: DataFrame, language: str, task: str) -> DataFrame:
    hit = catalogue.filter((F.col("language") == language) & (F.col("task") == task))
    if hit.isEmpty():
        raise ValueError(f"Unknown task {task} for {language}")
    return hit


# S6 -------------------------------------------------------------------------
def test_case_pairs(df: DataFrame, key: str, cases: str) -> DataFrame:
    """``map<string,string>`` of ``test_case{i}`` / ``expected_output{i}`` ->
    consecutive pairs from 1, stopping at the first gap.

    Rows: (key, idx, test_case, expected). Keys with no pair 1 produce none
    (``require_test_cases`` raises for them).
    """
    ent = df.select(key, F.explode(F.col(cases)).alias("k", "v"))
    ent = ent.select(key, F.regexp_extract("k", r"^(test_case|expected_output)(\d+)$", 1).alias("kind"),
                     F.regexp_extract("k", r"^(test_case|expected_output)(\d+)$", 2).alias("i"), "v") \
        .filter(F.col("kind") != "").withColumn("i", F.col("i").cast("int"))
    tc = ent.filter(F.col("kind") == "test_case").select(key, "i", F.col("v").alias("test_case"))
    eo = ent.filter(F.col("kind") == "expected_output").select(key, "i", F.col("v").alias("expected"))
    pairs = tc.join(eo, [key, "i"])
    # consecutive from 1: the idx-th smallest index must equal idx
    from pyspark.sql.window import Window
    w = Window.partitionBy(key).orderBy("i")
    pairs = pairs.withColumn("_rank", F.row_number().over(w))
    pairs = pairs.withColumn("_gap", F.max((F.col("i") != F.col("_rank")).cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return pairs.filter(F.col("_gap") == 0).select(key, F.col("i").alias("idx"), "test_case", "expected")


# S7 -------------------------------------------------------------------------
def scan_json_dir(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON per file; key = file name without extension, or the partition value where
    the folder is partitioned by ``key``; dot-files skipped."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    df = r.json(path, pathGlobFilter="[!.]*.json")
    if "key" not in df.columns:
        df = df.withColumn("key", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    return df.orderBy("key")


# S8 -------------------------------------------------------------------------
TASKS_SCHEMA = T.StructType([
    T.StructField("task_type", T.StringType()), T.StructField("code_task", T.StringType()),
    T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
    T.StructField("before", T.StringType()), T.StructField("between", T.StringType()),
    T.StructField("after", T.StringType()),
    T.StructField("reason_categories_output", T.StringType()),
    T.StructField("horizon_categories_output", T.StringType()),
    T.StructField("reason_freq_analysis", T.StringType()),
    T.StructField("horizon_freq_analysis", T.StringType())])


def scan_dataset(spark: SparkSession, path: str, schema: T.StructType = TASKS_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


# K2 -------------------------------------------------------------------------
def grouped_report(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Groups stacked, each preceded by a key row with nulls elsewhere.

    Adds header rows by ``unionByName`` and orders by
    (key, is_header desc, order...). The header has the key in ``key`` only.
    """
    hdr = df.select(key).distinct().withColumn("_hdr", F.lit(1))
    body = df.withColumn("_hdr", F.lit(0))
    out = body.unionByName(hdr, allowMissingColumns=True)
    return out.orderBy(F.col(key), F.col("_hdr").desc(), *order).drop("_hdr") if order else \
        out.orderBy(F.col(key), F.col("_hdr").desc()).drop("_hdr")


def write_grouped(df: DataFrame, key: str, order: list[str], path: str) -> None:
    grouped_report(df, key, order).write.mode("overwrite").option("header", True).csv(path)


# K3 -------------------------------------------------------------------------
def output_name(name, now: str) -> Column:
    """Replace the last four ``_`` parts of a run name by the stamp ``now`` (MM_DD_HH_MM)."""
    parts = F.split(F.col(name) if isinstance(name, str) else name, "_")
    keep = F.slice(parts, 1, F.greatest(F.size(parts) - 4, F.lit(0)))
    return F.concat_ws("_", F.concat(keep, F.split(F.lit(now), "_")))


# K4 -------------------------------------------------------------------------
def add_expected(existing, key: str, content) -> Column:
    """Merge an expected output under ``key`` and an empty ``test_case1`` into a JSON map."""
    m = F.coalesce(existing, F.create_map().cast("map<string,string>"))
    new = F.create_map(F.lit(key), content, F.lit("test_case1"), F.lit(""))
    kept = F.map_filter(m, lambda k, v: ~k.isin(key, "test_case1"))
    return F.map_concat(kept, new)

