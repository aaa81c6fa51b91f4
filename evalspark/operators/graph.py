"""Iterative graph operators: greedy matching and density clustering.

Both are driver loops over *distributed* rounds that run until they converge; every
round's state is cut from the lineage with a reliable ``checkpoint()`` into the
session's checkpoint folder, so a lost executor recomputes at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.operators.components import connected_components
from evalspark.operators.pairs import touching
from evalspark.session import cut, ensure_checkpoint_dir


# B14 ------------------------------------------------------------------------
def _by_two_lightest(e: DataFrame) -> DataFrame:
    """Edges with ``up_a`` / ``up_b``: lighter edges at that end -- 0, 1 or 2 (two or
    more) -- and ``pa`` / ``pb``, the lightest edge there."""
    ends = e.select(F.col("a").alias("node"), "k").unionByName(e.select(F.col("b").alias("node"), "k"))
    # Two rows per node and task reach the shuffle (a partial group limit), also of a hub's edges.
    lightest = ends.withColumn("no", F.row_number().over(Window.partitionBy("node").orderBy("k"))).where("no <= 2")
    two = lightest.groupBy("node").agg(F.min("k").alias("k1"), F.min(F.when(F.col("no") == 2, F.col("k"))).alias("k2"))
    out = e
    for end in ("a", "b"):
        side = two.select(F.col("node").alias(end), F.col("k1").alias(f"p{end}"), F.col("k2").alias("_k2"))
        out = out.join(side, end).withColumn(f"up_{end}", F.when(F.col("k") == F.col(f"p{end}"), 0)
                                             .when(F.col("k") == F.col("_k2"), 1).otherwise(2)).drop("_k2")
    return out


def _chain_tops(chain: DataFrame) -> DataFrame:
    """``k``, ``p``, ``odd``: ``p`` followed up to the first edge that is no chain edge, by
    doubling (the number of steps is the logarithm of the chain length)."""
    t = cut(chain)
    while not t.join(t.select(F.col("k").alias("p")), "p", "left_semi").isEmpty():
        up = t.select(F.col("k").alias("p"), F.col("p").alias("_p"), F.col("odd").alias("_odd"))
        t = cut(t.join(up, "p", "left").select("k", F.coalesce("_p", "p").alias("p"),
                                               (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd")))
    return t


def greedy_match(edges: DataFrame, a: str = "a", b: str = "b", w: str = "w") -> DataFrame:
    """Greedy matching: walk edges by ascending (w, a, b) and take an edge when
    both ends are free.

    Parallel form with the identical result, in rounds until no edge is left. An edge
    without a lighter neighbour is taken. An edge with exactly one lighter neighbour is
    taken if and only if that one is not, so a path of rising weights is decided in one
    round: its edges are followed to the top of their chain by doubling. Then all edges
    that touch a taken node are dropped. Every round's winners are appended to one
    table in the checkpoint folder, so the plan does not grow with the rounds.
    """
    import uuid

    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(w).alias("w")).filter(F.col("a") != F.col("b")).distinct()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/matching-{uuid.uuid4().hex}"
    schema = e.schema
    e = cut(e.withColumn("k", F.struct("w", "a", "b")))
    turn = 0
    while not e.isEmpty():
        d = cut(_by_two_lightest(e))
        top = d.filter("up_a = 0 AND up_b = 0")
        chain = d.filter("up_a + up_b = 1").select("k", F.when(F.col("up_a") == 1, F.col("pa")).otherwise(F.col("pb")).alias("p"), F.lit(True).alias("odd"))
        below = _chain_tops(chain).filter("NOT odd").join(top.select(F.col("k").alias("p")), "p", "left_semi")
        win = top.select("a", "b", "w", "k").unionByName(d.join(below.select("k"), "k", "left_semi").select("a", "b", "w", "k"))
        win.select("a", "b", "w").write.parquet(f"{path}/turn={turn}")
        win = spark.read.schema(schema).parquet(f"{path}/turn={turn}")
        used = win.select(F.col("a").alias("n")).unionByName(win.select(F.col("b").alias("n")))
        e = cut(e.join(used.withColumnRenamed("n", "a"), "a", "left_anti").join(used.withColumnRenamed("n", "b"), "b", "left_anti"))
        turn += 1
    if not turn:
        return edges.select(F.col(a), F.col(b), F.col(w)).limit(0)
    taken = spark.read.schema(schema).parquet(path)
    return taken.select(F.col("a").alias(a), F.col("b").alias(b), F.col("w").alias(w))


# B12 - B16 --------------------------------------------------------------------
def eps_pairs(points: DataFrame, pid: str, vec: str, eps: float, n_pivots: int = 6, tile: int | None = None) -> DataFrame:
    """All pairs (i < j) within Euclidean distance ``eps`` -- exact, nothing dropped: the balls of half
    that radius that touch. ``tile``: points of a block at most, by default as :func:`pairs.touching` sets it."""
    return touching(points, pid, vec, F.lit(float(eps) / 2), n_pivots, tile)


def dbscan(points: DataFrame, pid: str, vec: str, eps: float, min_pts: int) -> DataFrame:
    """Density clustering: core points have >= ``min_pts`` neighbours within eps
    (self included); clusters are the connected components of core points; a border
    point joins the cluster of its nearest core point (ties by id); others are noise
    (-1). A cluster is identified by its smallest core id (no global renumbering pass).
    """
    pairs = cut(eps_pairs(points, pid, vec, eps))
    ids = points.select(F.col(pid).alias("id"))
    nb = pairs.select(F.col("i").alias("id")).unionByName(pairs.select(F.col("j").alias("id")))
    deg = nb.groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    core = ids.join(deg, "id", "left").filter(F.coalesce("deg", F.lit(0)) + 1 >= min_pts).select("id")
    core = cut(core)
    ce = pairs.join(core.withColumnRenamed("id", "i"), "i").join(core.withColumnRenamed("id", "j"), "j")
    comp = connected_components(ce.select(F.col("i").alias("a"), F.col("j").alias("b")))
    lab = cut(core.join(comp.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("lab")))
    # border points: nearest core neighbour
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    border = both.join(core.withColumnRenamed("id", "j"), "j").join(core.withColumnRenamed("id", "i"), "i", "left_anti") \
        .join(lab.withColumnRenamed("id", "j"), "j") \
        .groupBy("i").agg(F.min(F.struct("dist", "j", "lab")).alias("b")).select(F.col("i").alias("id"), F.col("b.lab").alias("lab"))
    labels = lab.unionByName(border)
    out = ids.join(labels, "id", "left")
    return out.select(F.col("id").alias(pid), F.coalesce("lab", F.lit(-1)).cast("long").alias("cluster"))
