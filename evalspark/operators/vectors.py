"""Vectors, matrices, series and pair operators (the task programs' data work).

Design for scale:

* vectors are ``array<double>``; per-vector math is higher-order functions
  (no UDF);
* a *query set* (centroids, probes) meets the points in blocks of
  ``QUERY_BLOCK`` queries: one block is one array value sent with the tasks,
  more blocks are joined by block number, and the runtime broadcasts them only
  while they are measured small;
* per-query top-k is ``row_number() <= k`` over the query key, which Spark
  plans with a partial ``WindowGroupLimit`` before the shuffle (each map task
  forwards at most k rows per query);
* running sums and previous-row lookups per key use two levels -- inside a
  (key, time bucket) and a carry over the per-bucket totals -- so one hot key
  spreads over its buckets instead of one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.functions.arrays import fold_map, let
from evalspark.session import cut

QUERY_BLOCK = 1_000  # queries that meet a point at once


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return _c(c).cast("array<double>")


# distances ------------------------------------------------------------------
def sq_dist(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def euclid(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))


# B6 -------------------------------------------------------------------------
def l1_norm(v) -> Column:
    return F.aggregate(F.transform(_c(v), lambda x: F.abs(x)), F.lit(0.0), lambda s, x: s + x)


def l1_normalize(v) -> Column:
    n = l1_norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: x / n)).otherwise(_c(v))


# B7 -------------------------------------------------------------------------
def vector_add(a, b) -> Column:
    """Element-wise sum; unequal lengths raise."""
    a, b = _c(a), _c(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector lengths differ")).cast("array<double>")) \
        .otherwise(F.zip_with(a, b, lambda x, y: x + y))


def sparse_add(a: DataFrame, b: DataFrame, key: Sequence[str], idx: str, value: str) -> DataFrame:
    """Sparse vectors in coordinate form: union + sum per (key, idx)."""
    return a.select(*key, idx, value).unionByName(b.select(*key, idx, value)) \
        .groupBy(*key, idx).agg(F.sum(value).alias(value))


# B8 -------------------------------------------------------------------------
def sparse_dense(coo: DataFrame, key: str, idx: str, value: str, length: int, baseline: float) -> DataFrame:
    """Dense view of sparse vectors with a baseline for absent indices.

    Built per key from its stored entries (a bounded ``length``-sized array),
    not by a join against a generated index table.
    """
    g = _in_range(coo, idx, length).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(idx).cast("int").alias("i"), F.col(value).cast("double").alias("x")))).alias("_m"))
    return g.select(key, _filled("_m", length, baseline).alias("dense"), F.size("_m").alias("n_stored"))


def _filled(entries, length: int, baseline: float) -> Column:
    """Sorted entries ``i``, ``x`` as a dense array: each is preceded by the baseline up to it. An index that is
    stored twice raises; a stored null counts as absent."""
    base = F.lit(float(baseline))

    def fill(m: Column) -> Column:
        before = lambda i: F.coalesce(F.get(m, i - 1)["i"], F.lit(-1))
        parts = F.transform(m, lambda e, i: F.when(e["i"] == before(i), F.raise_error(F.lit("index stored twice")).cast("array<double>"))
                            .otherwise(F.concat(F.array_repeat(base, e["i"] - before(i) - 1), F.array(F.coalesce(e["x"], base)))))
        return F.concat(F.flatten(parts), F.array_repeat(base, F.lit(length - 1) - F.coalesce(F.element_at(m, -1)["i"], F.lit(-1))))
    return let(_c(entries), fill)


def _in_range(coo: DataFrame, idx: str, length: int) -> DataFrame:
    """Stored indices as they are; one outside [0, length) raises."""
    i = F.col(idx)
    return coo.withColumn(idx, F.when(i.between(0, length - 1), i).otherwise(
        F.raise_error(F.concat(F.lit("index out of range: "), i.cast("string"))).cast(coo.schema[idx].dataType)))


def sparse_l1(coo: DataFrame, key: str, value: str, length: int, baseline: float) -> DataFrame:
    """L1 norm with the closed formula: stored |values| + (length - stored) * |baseline|."""
    g = coo.groupBy(key).agg(F.sum(F.abs(value)).alias("_s"), F.count(F.lit(1)).alias("n_stored"))
    return g.select(key, "n_stored", (F.col("_s") + (F.lit(length) - F.col("n_stored")) * abs(baseline)).alias("l1"))


def sparse_summary(coo: DataFrame, key: str, idx: str, value: str, length: int, baseline: float) -> DataFrame:
    """Stored count, L1 norm (closed formula) and dense view in ONE aggregate per key."""
    g = _in_range(coo, idx, length).groupBy(key).agg(F.count(F.lit(1)).alias("n_stored"), F.sum(F.abs(value)).alias("_s"),
                             F.sort_array(F.collect_list(F.struct(F.col(idx).cast("int").alias("i"), F.col(value).cast("double").alias("x"))))
                             .alias("_m"))
    return g.select(key, "n_stored", (F.col("_s") + (F.lit(length) - F.col("n_stored")) * abs(baseline)).alias("l1"),
                    _filled("_m", length, baseline).alias("dense"))


# B9 -------------------------------------------------------------------------
def matrix_sums(coo: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Row sums and column sums of a coordinate matrix, stacked with an ``axis`` column."""
    r = coo.groupBy(F.col(row).alias("idx")).agg(F.sum(value).alias("total")).withColumn("axis", F.lit("row"))
    c = coo.groupBy(F.col(col).alias("idx")).agg(F.sum(value).alias("total")).withColumn("axis", F.lit("col"))
    return r.unionByName(c)


def matrix_add(a: DataFrame, b: DataFrame, row: str, col: str, value: str) -> DataFrame:
    return a.select(row, col, value).unionByName(b.select(row, col, value)).groupBy(row, col) \
        .agg(F.sum(value).alias(value))


# centroids / query sets --------------------------------------------------------
def centroids(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Per-key mean vector (dimension-wise ``avg``; partial aggregation per dimension)."""
    e = df.select(key, F.posexplode(as_double_array(vec)).alias("pos", "x"))
    g = e.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return g.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_p")) \
        .select(key, F.transform("_p", lambda s: s["x"]).alias("centroid"))


def attach_queries(points: DataFrame, queries: DataFrame, qkey: str, qvec: str) -> DataFrame:
    """Every point with every query, in blocks of queries (``_q``: all columns of the
    query; ``qkey`` and ``_qv`` beside it). A set of one block is one scalar subquery
    value; a larger one is joined block by block on the block's number."""
    item = F.struct(F.col(qkey).alias("qk"), as_double_array(qvec).alias("qv"),
                    F.struct(*[F.col(c) for c in queries.columns]).alias("row"))
    blocks = -(-queries.count() // QUERY_BLOCK)
    if blocks <= 1:
        qs = queries.agg(F.collect_list(item)).scalar()
        out = points.select("*", F.explode(qs).alias("_q"))
    else:
        sets = queries.groupBy(F.pmod(F.xxhash64(qkey), F.lit(blocks)).alias("_block")).agg(F.collect_list(item).alias("_set"))
        each = points.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        out = each.join(sets, "_block").select(*points.columns, F.explode("_set").alias("_q"))
    return out.withColumn(qkey, F.col("_q.qk")).withColumn("_qv", F.col("_q.qv")).withColumn("_q", F.col("_q.row"))


# B3 -------------------------------------------------------------------------
def radius_search(points: DataFrame, pid: str, vec: str, queries: DataFrame, qkey: str, qvec: str,
                  r: float) -> DataFrame:
    j = attach_queries(points.select(pid, as_double_array(vec).alias("_v")), queries, qkey, qvec)
    d = j.withColumn("dist", euclid("_v", "_qv"))
    return d.filter(F.col("dist") <= r).select(qkey, pid, "dist")


# B4 -------------------------------------------------------------------------
def knn(points: DataFrame, pid: str, vec: str, queries: DataFrame, qkey: str, qvec: str, k: int) -> DataFrame:
    j = attach_queries(points.select(pid, as_double_array(vec).alias("_v")), queries, qkey, qvec)
    d = j.select(qkey, pid, euclid("_v", "_qv").alias("dist"))
    w = Window.partitionBy(qkey).orderBy("dist", pid)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# B5 -------------------------------------------------------------------------
def bounding_spheres(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Centre (mean) and radius (max distance to the centre) per group."""
    c = centroids(df, key, vec)
    j = df.select(key, as_double_array(vec).alias("_v")).join(c, key)
    return j.groupBy(key).agg(F.first("centroid").alias("centroid"),
                              F.max(euclid("_v", "centroid")).alias("radius"), F.count(F.lit(1)).alias("n"))


def sphere_intersections(spheres: DataFrame, key: str) -> DataFrame:
    """Pairs of groups whose spheres intersect (centre distance <= r1 + r2).

    The sphere table has one row per group; it is computed once, and meets itself in
    blocks of queries that carry their radius.
    """
    spheres = cut(spheres.select(key, "centroid", "radius"))
    other = spheres.select(F.col(key).alias("other"), F.col("centroid").alias("c"), F.col("radius").alias("other_radius"))
    j = attach_queries(spheres, other, "other", "c").withColumn("other_radius", F.col("_q.other_radius"))
    j = j.filter(F.col(key) < F.col("other"))
    return j.select(key, "other", F.round(euclid("centroid", "_qv"), 6).alias("centre_dist"),
                    (euclid("centroid", "_qv") <= F.col("radius") + F.col("other_radius")).alias("intersect"))


# B10 / B36: two-level scans per key -----------------------------------------------
def running_sum(df: DataFrame, key: str, order: Sequence[str], value: str, bucket: Column,
                out: str = "cum") -> DataFrame:
    """Running sum per key in ``order``; ``bucket`` (monotone in order, e.g. the
    day) splits a key so the scan runs per (key, bucket) plus a carry."""
    d = df.withColumn("_b", bucket)
    w_in = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_in", F.sum(value).over(w_in))
    tot = d.groupBy(key, "_b").agg(F.sum(value).alias("_t"))
    w_b = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.withColumn("_carry", F.coalesce(F.sum("_t").over(w_b), F.lit(0).cast(tot.schema["_t"].dataType))) \
        .select(key, "_b", "_carry")
    return d.join(carry, [key, "_b"]).withColumn(out, F.col("_in") + F.col("_carry")).drop("_b", "_in", "_carry")


def previous_value(df: DataFrame, key: str, order: Sequence[str], value: str, bucket: Column,
                   out: str = "prev") -> DataFrame:
    """``lag(value)`` per key in ``order`` computed per (key, bucket) with the
    last row of the previous non-empty bucket carried in."""
    d = df.withColumn("_b", bucket)
    w_in = Window.partitionBy(key, "_b").orderBy(*order)
    d = d.withColumn("_lag", F.lag(value).over(w_in)).withColumn("_first", F.row_number().over(w_in) == 1)
    last = d.groupBy(key, "_b").agg(F.max(F.struct(*[F.col(o) for o in order], F.col(value).alias("_v"))).alias("_l"))
    w_b = Window.partitionBy(key).orderBy("_b")
    carry = last.withColumn("_pv", F.lag(F.col("_l._v")).over(w_b)).select(key, "_b", "_pv")
    d = d.join(carry, [key, "_b"])
    return d.withColumn(out, F.when(F.col("_first"), F.col("_pv")).otherwise(F.col("_lag"))) \
        .drop("_b", "_lag", "_first", "_pv")


def change_flag(df: DataFrame, key: str, order: Sequence[str], value: str, bucket: Column,
                out: str = "changed") -> DataFrame:
    """1 where the value differs from the previous row's (first row: 0)."""
    p = previous_value(df, key, order, value, bucket, "_prev")
    return p.withColumn(out, F.when(F.col("_prev").isNull(), F.lit(0))
                        .otherwise((F.col("_prev") != F.col(value)).cast("int"))).drop("_prev")


# B12 / B13 --------------------------------------------------------------------------
def cumulative(v) -> Column:
    """Running sum along a vector (the cumulative return series)."""
    return fold_map(_c(v), F.lit(0.0), "double", lambda total, x: (total + x, total + x))


def _with_vectors(pairs: DataFrame, a: str, b: str, series: DataFrame, sid: str, vec: str) -> DataFrame:
    """The pairs with the vectors of both ends (``_va``, ``_vb``), which are shuffled as they are stored."""
    return pairs.select(a, b).join(series.select(F.col(sid).alias(a), F.col(vec).alias("_va")), a) \
        .join(series.select(F.col(sid).alias(b), F.col(vec).alias("_vb")), b)


def pair_distance(pairs: DataFrame, a: str, b: str, series: DataFrame, sid: str, vec: str) -> DataFrame:
    """Euclidean norm of the difference of the cumulative series of each given pair."""
    def step(s: Column, x: Column) -> Column:
        p, q = s["p"] + x["p"], s["q"] + x["q"]
        return F.struct(p.alias("p"), q.alias("q"), (s["sum"] + (p - q) * (p - q)).alias("sum"))

    j = _with_vectors(pairs, a, b, series, sid, vec)
    both = F.zip_with(as_double_array("_va"), as_double_array("_vb"), lambda x, y: F.struct(x.alias("p"), y.alias("q")))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("p", "q", "sum")])
    return j.select(a, b, F.aggregate(both, zero, step, lambda s: F.sqrt(s["sum"])).alias("dist"))


def pair_corr(pairs: DataFrame, a: str, b: str, series: DataFrame, sid: str, vec: str) -> DataFrame:
    """Pearson correlation per given pair, dimensions as observations (``corr`` aggregate). A pair's observations are made
    beside each other after the joins, so that the partial aggregate leaves one row of them for the shuffle."""
    j = _with_vectors(pairs, a, b, series, sid, vec)
    both = F.least(F.size("_va"), F.size("_vb"))
    obs = F.arrays_zip(F.slice(as_double_array("_va"), 1, both).alias("xa"), F.slice(as_double_array("_vb"), 1, both).alias("xb"))
    j = j.where(both > 0).select(a, b, F.explode(obs).alias("_o"))
    return j.groupBy(a, b).agg(F.corr("_o.xa", "_o.xb").alias("corr"))


# B37 ----------------------------------------------------------------------------------
def multi_hot(df: DataFrame, key: str, cat: str, domain: Sequence[str]) -> DataFrame:
    """Set of categories per key -> 0/1 vector over a fixed domain (algebraic max per slot)."""
    aggs = [F.max((F.col(cat) == v).cast("int")).alias(f"_h{i}") for i, v in enumerate(domain)]
    g = df.groupBy(key).agg(*aggs)
    return g.select(key, F.array(*[F.col(f"_h{i}") for i in range(len(domain))]).alias("multi_hot"))


# B20 ----------------------------------------------------------------------------------
def one_hot(df: DataFrame, col: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Category column -> one 0/1 column per sorted level (when not given, the distinct
    levels: they become the columns of the result's schema)."""
    if levels is None:
        levels = sorted(r[0] for r in df.select(col).distinct().collect() if r[0] is not None)
    return df.select(*[c for c in df.columns if c != col],
                     *[(F.col(col) == v).cast("int").alias(f"{col}_{v}") for v in levels])


# B18 ----------------------------------------------------------------------------------
def members(df: DataFrame, label: str, path: str) -> None:
    """One table per cluster label: a partitioned write, rows sorted by label within files."""
    df.hint("rebalance", label).sortWithinPartitions(label).write.mode("overwrite").partitionBy(label).parquet(path)
