"""The pivot index against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import metric as MX


def clouds(rnd, n, dims=4, centres=12):
    mid = [[rnd.uniform(-50, 50) for _ in range(dims)] for _ in range(centres)]
    return [(i, [c + rnd.gauss(0, 1) for c in rnd.choice(mid)]) for i in range(n)]


def dist(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    pts = clouds(rnd, 700) + [(2000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    qs = [(i, v) for i, (_, v) in enumerate(rnd.sample(pts, 25))] + [(100, [500.0] * 4), (101, [1.0, 2.0, 3.0, 4.0])]
    p = spark.createDataFrame([*pts, (9999, None)], "id long, v array<double>").repartition(4)
    q = spark.createDataFrame([*qs, (999, None)], "q long, qv array<double>")
    return pts, qs, p, q


@pytest.mark.parametrize("tile", [7, 4096])
def test_radius_search(spark, data, tile, monkeypatch):
    pts, qs, p, q = data
    monkeypatch.setattr(MX.Index.__init__, "__defaults__", (None, MX.PIVOTS, tile))
    for r in (0.0, 1.5, 30.0):
        got = sorted((x.q, x.id) for x in MX.radius_search(p, "id", "v", q, "q", "qv", r).collect())
        assert got == sorted((i, j) for i, a in qs for j, b in pts if dist(a, b) <= r)
    assert MX.radius_search(p.limit(0), "id", "v", q, "q", "qv", 1.0).count() == 0
    assert MX.radius_search(p, "id", "v", q.limit(0), "q", "qv", 1.0).count() == 0


def test_little_is_compared_in_clusters(spark, data):
    pts, qs, p, q = data
    near = MX.Index(p, "id", "v").candidates(MX._queries(q, "q", "qv").withColumn("r", F.lit(1.5))).count()
    share = near / (len(pts) * len(qs))
    print(f"compared {share:.3%} of all pairs")
    assert share < 0.1


@pytest.mark.parametrize("k", [1, 5, 60, 2000])
def test_nearest(spark, data, k):
    pts, qs, p, q = data
    got = {(x.q, x.rank): (x.id, round(x.dist, 9)) for x in MX.knn(p, "id", "v", q, "q", "qv", k).collect()}
    want = {}
    for i, a in qs:
        for rank, (d, j) in enumerate(sorted((dist(a, b), j) for j, b in pts)[:k], 1):
            want[i, rank] = (j, round(d, 9))
    assert got == want


def test_spheres(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(0, 60) for _ in range(3)], rnd.choice([0.0, 0.3, 1.0, 1.5, 4.0, 25.0])) for i in range(160)]
    df = spark.createDataFrame(rows, "k long, centroid array<double>, radius double").repartition(3)
    got = sorted((r.k, r.other) for r in MX.intersecting_spheres(df, "k").collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and dist(a[1], b[1]) <= a[2] + b[2])
    assert got == want and 50 < len(want) < 160 * 159 / 2
    assert MX.intersecting_spheres(df.limit(0), "k").count() == 0
