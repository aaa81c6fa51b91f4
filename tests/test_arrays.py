"""Folds inside a row: same results as plain Python, and time in proportion to the length."""

import random
import time

from pyspark.sql import functions as F

from evalspark.functions import arrays as AR, text as X
from evalspark.operators import vectors as VX


def test_fold_map_and_member_flags(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice("abcdef") + str(rnd.randrange(9)) for _ in range(n)], [rnd.choice("abcdef") + str(rnd.randrange(9)) for _ in range(m)])
            for i, (n, m) in enumerate([(0, 0), (0, 5), (5, 0), (1, 1), (255, 9), (256, 30), (257, 3), (1500, 12)])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    out = df.select("id", AR.fold_map(F.col("a"), F.lit(0), "int", lambda s, x: (s + F.length(x), s * 2)).alias("f"),
                    AR.member_flags(F.col("a"), F.col("b")).alias("m"), AR.blocks(F.col("a"), 100).alias("k")).collect()
    for r in out:
        a, b = rows[r.id][1:]
        assert r.f == [4 * i for i in range(len(a))] and r.m == [x in b for x in a]
        assert [x for k in r.k for x in k] == a and all(len(k) == 100 for k in r.k[:-1])


def test_running_sums_and_dense_vectors(spark):
    v = [random.Random(1).random() for _ in range(1000)]
    got = spark.createDataFrame([(v,), ([],)], "v array<double>").select(VX.cumulative("v").alias("c")).collect()
    total, want = 0.0, []
    for x in v:
        total += x
        want.append(total)
    assert got[0].c == want and got[1].c == []
    coo = spark.createDataFrame([("k", 7, 2.0), ("k", 0, 1.0), ("k", 3, None), ("m", 9, 5.0)], "k string, i int, x double")
    dense = {r.k: (r.dense, r.n_stored) for r in VX.sparse_dense(coo, "k", "i", "x", 10, -1.0).collect()}
    assert dense == {"k": ([1.0, -1, -1, -1, -1, -1, -1, 2.0, -1, -1], 3), "m": ([-1.0] * 9 + [5.0], 1)}


def test_a_text_of_very_many_lines(spark):
    text = "\n".join(["x = call(a)", "# a comment", "", '"""', "inside", '"""', "This is a sentence in prose, no code."] * 14_286)
    df = spark.createDataFrame([(text,)], "t string").select(X.clean_code(F.col("t"), "python").alias("c"))
    began = time.time()
    lines = df.first().c.split("\n")
    took = time.time() - began
    assert lines.count("x = call(a)") == 14_286 and "inside" not in lines and "# a comment" not in lines
    assert took < 60, took  # some seconds; the square of the length took minutes
