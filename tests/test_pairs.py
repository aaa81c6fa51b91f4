"""Pairs of balls in blocks against all pairs, and what is made of the pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import graph as G
from evalspark.operators import metric as MX
from evalspark.operators import vectors as VX
from evalspark.operators.pairs import touching


def _directions(n, dims=16, seed=4):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return (v / np.sqrt((v * v).sum(1))[:, None]).tolist()


@pytest.mark.parametrize("size", [None, 5, 64])
def test_all_pairs_of_random_directions(spark, size):
    v = _directions(300)
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>").repartition(3)
    got = sorted((r.i, r.j, r.dist) for r in touching(df, "id", "v", F.lit(0.45), size=size).collect())
    dist = lambda a, b: math.sqrt(_squares(a, b))
    want = [(i, j, dist(v[i], v[j])) for i in range(300) for j in range(i + 1, 300) if dist(v[i], v[j]) <= 0.9]
    assert got == want and len(want) > 100


def _squares(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += (x - y) * (x - y)
    return s


def test_odd_rows(spark):
    big = 1e200  # its squares are no longer finite
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 0.0]), (5, [0.0]), (6, [0.0]), (None, [0.0, 0.0]),
            (7, []), (8, []), (9, [big, 0.0]), (10, [big, 0.0]), (11, [float("nan"), 0.0]), (12, [float("inf"), 0.0]), (13, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(2)
    for size in (1, 1000):
        got = sorted((r.i, r.j) for r in touching(df, "id", "v", F.lit(0.5), size=size).collect())
        assert got == [(1, 2), (1, 2), (5, 6), (7, 8), (9, 10)]
    assert touching(df.limit(0), "id", "v", F.lit(0.5)).count() == 0


def test_a_distance_at_the_limit_is_within(spark):
    df = spark.createDataFrame([(i, [i * 0.1, 1e6]) for i in range(30)], "id long, v array<double>")
    d = lambda i, j: math.sqrt((i * 0.1 - j * 0.1) ** 2)
    for eps in (0.1, 0.2, 0.30000000000000004):
        got = sorted((r.i, r.j) for r in G.eps_pairs(df, "id", "v", eps, tile=7).collect())
        assert got == [(i, j) for i in range(30) for j in range(i + 1, 30) if d(i, j) <= eps]


def test_points_are_copied_once_per_block_not_once_per_few_points(spark):
    """Before, every point was sent to one key per 64 points."""
    df = spark.createDataFrame(list(enumerate(_directions(2048))), "id long, v array<double>").repartition(4)
    for found in (G.eps_pairs(df, "id", "v", 0.6), MX.intersecting_spheres(df.withColumn("r", F.lit(0.3)), "id", "v", "r")):
        grouped = found._jdf.queryExecution().optimizedPlan().toString()
        assert grouped.count("FlatMapGroupsInArrow") == 1
        sent = [line for line in grouped.splitlines() if "Join" in line]
        assert len(sent) == 3  # bands, tiles and the pairs of blocks: no join of points with points


def test_distance_and_correlation_of_pairs(spark):
    v = _directions(40)
    s = spark.createDataFrame([*enumerate(v), (100, [1.0, 2.0]), (101, [1.0]), (102, None), (103, [None, 1.0]), (104, [])], "id long, v array<double>")
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40)] + [(100, 101), (100, 102), (100, 103), (100, 104), (0, 999)], "a long, b long")
    got = {(r.a, r.b): r.dist for r in VX.pair_distance(pairs, "a", "b", s, "id", "v").collect()}
    assert len(got) == 40 * 39 // 2 + 4 and all(got[100, k] is None for k in (101, 102, 103, 104))
    c = np.cumsum(v, axis=1)
    assert all(abs(got[i, j] - np.linalg.norm(c[i] - c[j])) < 1e-9 for i in range(40) for j in range(i + 1, 40))
    corr = {(r.a, r.b): r.corr for r in VX.pair_corr(pairs, "a", "b", s, "id", "v").where("a < 100 and b < 100").collect()}
    assert len(corr) == 40 * 39 // 2 and all(abs(x - np.corrcoef(v[i], v[j])[0, 1]) < 1e-9 for (i, j), x in corr.items())


def test_partial_aggregate_of_the_correlation_precedes_the_shuffle(spark):
    """Before, one row per pair and dimension was joined and shuffled."""
    s = spark.createDataFrame(list(enumerate(_directions(20))), "id long, v array<double>")
    pairs = s.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    plan = VX.pair_corr(pairs, "a", "b", s, "id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Generate") < plan.index("Join")
