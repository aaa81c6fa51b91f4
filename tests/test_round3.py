"""Dyadic range joins, bins, kernel SVM."""

import math
import random

from pyspark.sql import functions as F

from evalspark.operators import models as M, rates as A, spans as S


def test_dyadic_intervals_cover_ranges_once(spark):
    rnd = random.Random(4)
    rows = [(a, a + rnd.choice([-1, 0, 1, 2, 3, 7, 8, 100, 5000])) for a in (rnd.randrange(-3000, 3000) for _ in range(300))] + [(0, 2**40), (-(2**40), 5)]
    out = spark.createDataFrame(rows, "a long, b long").select("a", "b", S._dyadic(F.col("a"), F.col("b")).alias("d")).collect()
    for r in out:
        spans = sorted((x.node << x.level, (x.node + 1 << x.level) - 1) for x in r.d)
        assert len(spans) <= 2 * math.log2(max(r.b - r.a, 0) + 2) + 2
        if r.b < r.a:
            assert not spans
        else:
            assert spans[0][0] == r.a and spans[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))


def test_range_join_with_long_ranges(spark):
    rnd = random.Random(5)
    ranges = [(i, rnd.choice("ab"), s, s + rnd.choice([0, 3, 40, 100_000, -1])) for i, s in enumerate(rnd.randrange(-500, 500) for _ in range(60))]
    recs = [(i, rnd.choice("ab"), rnd.randrange(-600, 3000)) for i in range(400)]
    r = spark.createDataFrame(ranges, "cid int, k string, s long, e long")
    p = spark.createDataFrame(recs, "rid int, k string, p long")
    got = sorted((x.cid, x.rid) for x in S.records_in_range(r, p, ["k"], "s", "e", "p", bucket=7).collect())
    assert got == sorted((c, q) for c, k, s, e in ranges for q, k2, v in recs if k == k2 and s <= v <= e)
    assert S.records_in_range(r.limit(0), p, ["k"], "s", "e", "p", bucket=7).count() == 0


def test_histogram_shuffles_bins_only(spark):
    df = spark.range(5000).select((F.rand(3) * 10).alias("x"), (F.col("id") % 3 == 0).alias("s")).unionAll(spark.createDataFrame([(None, True)], "x double, s boolean"))
    df = spark.createDataFrame(df.collect(), df.schema)
    rows = [(r.x, r.s) for r in df.collect() if r.x is not None]
    lo, hi = min(x for x, _ in rows), max(x for x, _ in rows)
    want = {}
    for x, s in rows:
        b = min(int(math.floor((x - lo) / ((hi - lo) / 30))), 29)
        n, m = want.get(b, (0, 0))
        want[b] = (n + 1, m + bool(s))
    assert {r.bin: (r.n, r.n_subset) for r in A.histogram(df, "x", 30, "s").collect()} == want
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [(r.bin, r.n) for r in A.histogram(flat, "x").collect()] == [(0, 2)]
    assert A.histogram(flat.limit(0), "x").count() == 0


def test_kernel_svm_parts_a_ring(spark):
    from pyspark.ml.functions import array_to_vector

    rnd = random.Random(6)
    rows = []
    for _ in range(600):
        inner = rnd.random() < 0.5
        radius, angle = (rnd.uniform(0, 1) if inner else rnd.uniform(2, 3)), rnd.uniform(0, 2 * math.pi)
        rows.append((int(inner), [radius * math.cos(angle), radius * math.sin(angle)], 1.0))
    df = spark.createDataFrame(rows, "y int, v array<double>, weight double").withColumn("features", array_to_vector("v"))
    train, test = df.limit(400), df
    right = lambda pred: pred.where(F.col("prediction").cast("int") == F.col("y")).count() / pred.count()
    assert right(M.rbf_svm(train, test, "y")) >= 0.95
    assert right(M.linear_svm(train, test, "y")) < 0.8
    again = M.rbf_svm(train, test, "y").select("prediction").collect()
    assert again == M.rbf_svm(train, test, "y").select("prediction").collect()
