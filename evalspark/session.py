"""Session construction and table access.

Everything here is plain SparkSession configuration; the settings are the
ones that matter for large evaluation tables:

* AQE on, so join strategies and shuffle partition counts are re-planned at
  runtime from real sizes (broadcast only when a side is measured small,
  skew-join splitting for hot keys).
* ``spark.sql.autoBroadcastJoinThreshold`` stays at a fixed, small byte
  bound: a side is broadcast only when its measured size is under it.
* The checkpoint folder comes from ``spark.checkpoint.dir`` of the session
  (the shared folder of the cluster). Only where it is unset and the master is
  ``local`` do we make a scratch folder, and remove it at the end.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, app: str = "evalspark",
                  shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app)
    if master or "PYSPARK_GATEWAY_PORT" not in os.environ:  # not under spark-submit, which names the master
        builder = builder.master(master or f"local[{cpus}]")
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(128 * 1024 * 1024))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .config("spark.sql.files.minPartitionNum", cpus)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, choosing a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="evalspark-ckpt-", dir="/tmp")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table. How finely a scan is split is the session's business
    (``spark.sql.files.maxPartitionBytes`` / ``minPartitionNum``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
