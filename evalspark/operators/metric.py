"""Exact search in metric space with a pivot-partitioned index.

Every point belongs to the cell of its nearest pivot and keeps its distances to all pivots. What the triangle
inequality rules out is never compared: a query with radius r looks only into cells whose ring (least and
largest distance of their points to the pivot) it can reach and whose pivot is at most 2 r further from it than its
nearest one, and there only at points whose distances to all pivots are within r of its own. Cells are
join keys; a cell with many points is cut into tiles, and a query goes to all of them, so no key holds more than
about ``TILE`` points. The table of cells has one row per pivot (and group): a fixed number, sent with the tasks.

How much is ruled out depends on the data: much where points lie in clusters, little where all distances
are nearly the same, as for random directions in many dimensions. The result is exact either way;
``candidates`` shows the pairs that are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.operators.pairs import touching
from evalspark.operators.vectors import as_double_array, euclid
from evalspark.session import cut

PIVOTS = 32
TILE = 4096
SLACK = 1e-9  # rounding of sums of squares must not rule out a point on the edge


class Index:
    """``points``: ``id``, ``v``, ``g`` (group), ``cell``, ``pd`` (distances to the pivots), ``tile``; ``cells``: array column value of all
    cells; ``pivots``: array column value of their vectors."""

    def __init__(self, points: DataFrame, pid: str, vec: str, group: Column | None = None, n_pivots: int = PIVOTS, tile: int = TILE):
        pts = points.select(F.col(pid).alias("id"), as_double_array(vec).alias("v"), (group if group is not None else F.lit(0)).cast("int").alias("g"))
        pts = pts.where(F.col("v").isNotNull())
        spark = points.sparkSession
        few = [r["v"] for r in pts.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(n_pivots).select("v").collect()]
        self.pivots = spark.createDataFrame([(few,)], "p array<array<double>>")
        d = self._distances(pts, "v", "pd")
        d = cut(d.withColumn("cell", (F.array_position("pd", F.array_min("pd")) - 1).cast("int")))
        own = F.get("pd", F.col("cell"))
        rings = d.groupBy("g", "cell").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.count(F.lit(1)).alias("n"))
        rings = rings.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).select("g", "cell", "lo", "hi", "n", "tiles")
        rows = [tuple(r) for r in rings.collect()]  # one per pivot and group
        table = spark.createDataFrame(rows, rings.schema)
        self.cells = spark.createDataFrame([(rows,)], "c array<struct<g:int,cell:int,lo:double,hi:double,n:bigint,tiles:int>>")
        d = d.join(F.broadcast(table.select("g", "cell", "tiles")), ["g", "cell"])
        self.points = d.withColumn("tile", F.pmod(F.xxhash64("id", F.lit(5)), F.col("tiles")).cast("int")).drop("tiles")

    def _distances(self, rows: DataFrame, vec: str, out: str) -> DataFrame:
        d = rows.withColumn("_piv", self.pivots.scalar())
        return d.withColumn(out, F.transform("_piv", lambda p: euclid(vec, p))).drop("_piv")

    def reach(self, queries: DataFrame, only=None) -> DataFrame:
        """``queries`` (``q``, ``qv``, ``r`` and more) with ``qd`` and one row per cell and tile they can have a match in. ``only``: a further
        condition on the cell, as a function of it."""
        d = self._distances(queries, "qv", "qd").withColumn("_cells", self.cells.scalar())
        nearest = F.array_min("qd")

        def may(c):
            dq, room = F.get("qd", c["cell"]), F.col("r") + SLACK * (1 + F.col("r"))
            ok = (dq - room <= c["hi"]) & (dq + room >= c["lo"]) & (dq - nearest <= 2 * room)
            return ok if only is None else ok & only(c)

        each = d.withColumn("_c", F.explode(F.filter("_cells", may))).drop("_cells")
        return (each.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("_c.tiles") - 1)))
                .withColumns({"g": F.col("_c.g"), "cell": F.col("_c.cell")}).drop("_c"))

    def candidates(self, queries: DataFrame, only=None) -> DataFrame:
        """The pairs that are compared: all columns of ``queries``, ``id``, ``v`` and ``g`` of the point."""
        j = self.reach(queries, only).join(self.points, ["g", "cell", "tile"])
        room = F.col("r") + SLACK * (1 + F.col("r"))
        near = F.forall(F.zip_with("pd", "qd", lambda x, y: F.abs(x - y)), lambda x: x <= room)
        return j.where(near).drop("cell", "tile", "pd", "qd")

    def within(self, queries: DataFrame, only=None) -> DataFrame:
        """Candidates at a distance (``dist``) of at most ``r``."""
        return self.candidates(queries, only).withColumn("dist", euclid("v", "qv")).where("dist <= r")


def _queries(queries: DataFrame, qkey: str, qvec: str) -> DataFrame:
    return queries.select(F.col(qkey).alias("q"), as_double_array(qvec).alias("qv")).where(F.col("qv").isNotNull())


def radius_search(points: DataFrame, pid: str, vec: str, queries: DataFrame, qkey: str, qvec: str, r: float) -> DataFrame:
    """``qkey``, ``pid``, ``dist``: all points within ``r`` of each query. Rows with a null vector have no match; repeated
    rows match each; empty sides give an empty result."""
    found = Index(points, pid, vec).within(_queries(queries, qkey, qvec).withColumn("r", F.lit(float(r))))
    return found.select(F.col("q").alias(qkey), F.col("id").alias(pid), "dist")


def knn(points: DataFrame, pid: str, vec: str, queries: DataFrame, qkey: str, qvec: str, k: int) -> DataFrame:
    """``qkey``, ``pid``, ``dist``, ``rank``: the ``k`` nearest points of each query (ties by id), all if there are fewer. ``qkey``
    identifies a query.

    Two rounds. Cells sorted by how far their points can be at most tell a radius that holds k points; of
    the cells that make it up the distances are computed, and the k-th of them is the radius of the second round,
    in which all other cells within it are searched as well."""
    index = Index(points, pid, vec)
    qs = cut(_queries(queries, qkey, qvec))
    # The farthest that the points of a cell can be, and their number: the first cells that hold k points.
    bound = index._distances(qs, "qv", "qd").withColumn("_cells", index.cells.scalar())
    far = F.array_sort(F.transform("_cells", lambda c: F.struct((F.get("qd", c["cell"]) + c["hi"]).alias("far"), c["n"].alias("n"))))
    enough = F.aggregate(far, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("r")), lambda acc, c: F.when(acc["n"] >= k, acc).otherwise(
        F.struct((acc["n"] + c["n"]).alias("n"), c["far"].alias("r"))), lambda acc: acc["r"])
    first = bound.select("q", "qv", (enough * (1 + SLACK)).alias("r"))
    w = Window.partitionBy("q").orderBy("dist", "id")
    near = index.within(first.withColumn("most", F.col("r")), only=lambda c: F.get("qd", c["cell"]) + c["hi"] <= F.col("most") * (1 + SLACK))
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    second = first.join(near.groupBy("q").agg(F.max("dist").alias("kth"), F.count(F.lit(1)).alias("n")), "q")
    second = second.select("q", "qv", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.col("r")).alias("r"))
    found = index.within(second).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select(F.col("q").alias(qkey), F.col("id").alias(pid), "dist", "rank")


def intersecting_spheres(spheres: DataFrame, key: str, centre: str = "centroid", radius: str = "radius") -> DataFrame:
    """``key``, ``other`` (``key`` < ``other``), ``centre_dist``: the pairs of spheres that intersect (distance of the centres at most the
    sum of the radii), each once; no other pair is written. Keys are unique.

    Spheres are dealt into blocks by classes of radius (powers of two), and blocks meet blocks, each looked at as far as
    their own radii reach (see :mod:`pairs`)."""
    found = touching(spheres, key, centre, F.col(radius))
    return found.select(F.col("i").alias(key), F.col("j").alias("other"), F.col("dist").alias("centre_dist"))
