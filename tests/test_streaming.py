"""The streaming leaderboard equals the batch leaderboard over the same files."""

from pyspark.sql import functions as F

from evalspark.functions.rates import parse_ratio
from evalspark.operators.rates import leaderboard
from evalspark.plans import views as V
from evalspark.sources.io import scratch_path
from evalspark.streaming.leaderboard import start

from conftest import SF0001


def test_streaming_matches_batch(spark):
    runs = V.runs(spark, SF0001).select("doc_id", "model", "mode", "pass_ratio")
    src = scratch_path(spark, "stream-src")
    # files arrive in three batches
    for part in range(3):
        runs.filter(F.col("doc_id") % 3 == part).write.mode("append").parquet(src)
    q = start(spark, src, "lb_test")
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT * FROM lb_test").collect())
    finally:
        q.stop()
    batch = leaderboard(runs.withColumn("p", (parse_ratio("pass_ratio") == 1.0).cast("int")), passed="p")
    want = sorted(tuple(r) for r in batch.collect())
    assert got == want


def test_durable_leaderboard_survives_a_restart(spark, tmp_path):
    """Files arrive before and after a restart, one of them twice; the table equals the batch result."""
    from evalspark.streaming.leaderboard import durable_leaderboard, start_durable

    runs = V.runs(spark, SF0001).select("doc_id", "model", "mode", "pass_ratio")
    src, sink, ck = (f"file://{tmp_path}/{n}" for n in ("src", "sink", "ck"))
    both = f"file://{tmp_path}/{{src,src/again}}"
    (tmp_path / "src" / "again").mkdir(parents=True)
    for part in range(2):
        runs.filter(F.col("doc_id") % 4 == part).coalesce(1).write.mode("append").parquet(src)
    start_durable(spark, both, sink, ck, available_now=True).awaitTermination()
    first = durable_leaderboard(spark, sink).agg(F.sum("n_total")).first()[0]
    assert first == runs.filter("doc_id % 4 < 2").count()
    for part in (2, 3):
        runs.filter(F.col("doc_id") % 4 == part).coalesce(1).write.mode("append").parquet(src)
    old = next((tmp_path / "src").glob("part-*.parquet"))
    (tmp_path / "src" / "again" / old.name).write_bytes(old.read_bytes())  # the same run file in another folder
    for _ in range(2):  # the second start finds nothing new
        start_durable(spark, both, sink, ck, available_now=True).awaitTermination()
    got = sorted(tuple(r) for r in durable_leaderboard(spark, sink).collect())
    batch = leaderboard(runs.withColumn("p", (parse_ratio("pass_ratio") == 1.0).cast("int")), passed="p")
    assert got == sorted(tuple(r) for r in batch.collect())
