"""Tier B: data work of the benchmark's task programs, bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.functions.time import day_bucket
from evalspark.operators import metric as MX, models as M
from evalspark.operators import ranking as RK
from evalspark.operators import vectors as VX
from evalspark.operators.graph import eps_pairs
from evalspark.plans.q_core import W
from evalspark.plans.registry import query
from evalspark.session import table
from evalspark.sources import io

WORD_SPLIT = RK.WORD_SPLIT
DAY_US = 86_400_000_000


# ---------------------------------------------------------------- B1
def word_counts(spark, d):
    return RK.word_counts(table(spark, d, "documents"), "text", WORD_SPLIT)


WORDS_SQL = f"""
words AS (SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_split_to_array(lower(text), '{WORD_SPLIT}')) AS word FROM documents) WHERE word <> ''
  GROUP BY word)"""


@query("kth_frequent_word", ops=("B1",), sql=W("""
SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) - 1 AS INTEGER) AS k
FROM words ORDER BY n DESC, word LIMIT 15""", WORDS_SQL))
def q_top_words(spark, d):
    return RK.top_words(word_counts(spark, d), 14)


# ---------------------------------------------------------------- B2
@query("bounded_top_k", ops=("B2",), sql="""
SELECT user_id, event_id, round(value, 6) AS value, CAST(rk AS INTEGER) AS rank,
       round(max(value) OVER (PARTITION BY user_id), 6) AS cutoff
FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rk
      FROM events) WHERE rk <= 3""")
def q_top_k(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "value")
    t = RK.top_k(ev, "value", 3, ["event_id"], by=["user_id"])
    return t.select("user_id", "event_id", F.round("value", 6).alias("value"), "rank",
                    F.round("cutoff", 6).alias("cutoff"))


# ---------------------------------------------------------------- B3 / B4 / B5
CENTROIDS_SQL = """
cent AS (SELECT label, list(x ORDER BY pos) AS c FROM (
  SELECT label, pos, avg(x) AS x FROM (
    SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
  GROUP BY label, pos) GROUP BY label)"""
RADIUS = 0.97


def _emb(spark, d):
    return table(spark, d, "embeddings")


@query("radius_search", ops=("B3",), sql=W(f"""
SELECT c.label AS centre, e.vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), c.c), 6) AS dist
FROM embeddings e, cent c WHERE list_distance(CAST(e.embedding AS DOUBLE[]), c.c) <= {RADIUS}""", CENTROIDS_SQL))
def q_radius(spark, d):
    e = _emb(spark, d)
    c = VX.centroids(e, "label", "embedding").withColumnRenamed("label", "centre")
    r = MX.radius_search(e, "vec_id", "embedding", c, "centre", "centroid", RADIUS)
    return r.select("centre", "vec_id", F.round("dist", 6).alias("dist"))


@query("knn_search", ops=("B4",), sql=W("""
SELECT centre, vec_id, round(dist, 6) AS dist, CAST(rk AS INTEGER) AS rank FROM (
  SELECT c.label AS centre, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), c.c) AS dist,
         row_number() OVER (PARTITION BY c.label ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), c.c), e.vec_id) AS rk
  FROM embeddings e, cent c) WHERE rk <= 5""", CENTROIDS_SQL))
def q_knn(spark, d):
    e = _emb(spark, d)
    c = VX.centroids(e, "label", "embedding").withColumnRenamed("label", "centre")
    k = MX.knn(e, "vec_id", "embedding", c, "centre", "centroid", 5)
    return k.select("centre", "vec_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


@query("bounding_sphere", ops=("B5",), sql=W("""
SELECT label, round(max(list_distance(CAST(e.embedding AS DOUBLE[]), c.c)), 6) AS radius, count(*) AS n
FROM embeddings e JOIN cent c USING (label) GROUP BY label""", CENTROIDS_SQL))
def q_spheres(spark, d):
    e = _emb(spark, d)
    return VX.bounding_spheres(e, "label", "embedding").select("label", F.round("radius", 6).alias("radius"), "n")


@query("sphere_intersections", ops=("B5",), sql=W("""
SELECT a.label, b.label AS other, round(list_distance(a.c, b.c), 6) AS centre_dist,
       list_distance(a.c, b.c) <= a.r + b.r AS intersect
FROM (SELECT c.label, c.c, max(list_distance(CAST(e.embedding AS DOUBLE[]), c.c)) AS r
      FROM embeddings e JOIN cent c USING (label) GROUP BY c.label, c.c) a,
     (SELECT c.label, c.c, max(list_distance(CAST(e.embedding AS DOUBLE[]), c.c)) AS r
      FROM embeddings e JOIN cent c USING (label) GROUP BY c.label, c.c) b
WHERE a.label < b.label""", CENTROIDS_SQL))
def q_sphere_pairs(spark, d):
    s = VX.bounding_spheres(_emb(spark, d), "label", "embedding")
    return VX.sphere_intersections(s, "label")


# Spheres around the vectors themselves: half the distance to their label's centre.
NEST_SQL = """
nest AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS c, round(list_distance(CAST(e.embedding AS DOUBLE[]), c.c) * 0.545, 9) AS r
         FROM embeddings e JOIN cent c USING (label))"""


@query("intersecting_spheres", ops=("B5",), sql=W("""
SELECT a.vec_id, b.vec_id AS other, round(list_distance(a.c, b.c), 6) AS centre_dist
FROM nest a JOIN nest b ON a.vec_id < b.vec_id AND list_distance(a.c, b.c) <= a.r + b.r""", CENTROIDS_SQL, NEST_SQL))
def q_nested(spark, d):
    e = _emb(spark, d)
    c = VX.centroids(e, "label", "embedding")
    s = e.join(c, "label").select("vec_id", VX.as_double_array("embedding").alias("c"),
                                  F.round(VX.euclid(VX.as_double_array("embedding"), "centroid") * 0.545, 9).alias("r"))
    return MX.intersecting_spheres(s, "vec_id", "c", "r").withColumn("centre_dist", F.round("centre_dist", 6))


# ---------------------------------------------------------------- B6 / B7
@query("vector_l1_normalize", ops=("B6",), sql="""
SELECT vec_id, round(l1, 6) AS l1, round(list_sum(list_transform(v, lambda x: abs(x / l1))), 6) AS l1_after,
       round(list_max(list_transform(v, lambda x: x / l1)) + 1.0, 6) AS max_plus_one
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
             list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS l1 FROM embeddings)""")
def q_l1(spark, d):
    e = _emb(spark, d).select("vec_id", VX.as_double_array("embedding").alias("v"))
    e = e.withColumn("l1", VX.l1_norm("v")).withColumn("nv", VX.l1_normalize("v"))
    return e.select("vec_id", F.round("l1", 6).alias("l1"), F.round(VX.l1_norm("nv"), 6).alias("l1_after"),
                    F.round(F.array_max("nv") + 1.0, 6).alias("max_plus_one"))


@query("vector_add", ops=("B7",), sql="""
SELECT a.vec_id, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),
       lambda p: p[1] + p[2])), 6) AS sum_of_sum, CAST(len(a.embedding) AS INTEGER) AS dim
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_vector_add(spark, d):
    e = _emb(spark, d).select("vec_id", VX.as_double_array("embedding").alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    j = e.join(b, "vec_id").withColumn("s", VX.vector_add("v", "w"))
    return j.select("vec_id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_of_sum"),
                    F.size("s").cast("int").alias("dim"))


# ---------------------------------------------------------------- B8 / B9
SPARSE_LEN, BASELINE = 8, 0.5


@query("sparse_default_fill", ops=("B8",), sql=f"""
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_stored,
       round(sum(abs(q)) + ({SPARSE_LEN} - count(*)) * {BASELINE}, 6) AS l1,
       round(sum(q) + ({SPARSE_LEN} - count(*)) * {BASELINE}, 6) AS dense_sum
FROM (SELECT l_orderkey, l_linenumber - 1 AS idx, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
GROUP BY l_orderkey""")
def q_sparse(spark, d):
    li = table(spark, d, "lineitem")
    coo = li.groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("idx")).agg(F.sum("l_quantity").alias("q"))
    j = VX.sparse_summary(coo, "l_orderkey", "idx", "q", SPARSE_LEN, BASELINE) \
        .withColumn("ds", F.aggregate("dense", F.lit(0.0), lambda a, x: a + x))
    return j.select("l_orderkey", F.col("n_stored").cast("long").alias("n_stored"), F.round("l1", 6).alias("l1"),
                    F.round("ds", 6).alias("dense_sum"))


@query("matrix_row_col_sums", ops=("B9",), sql="""
SELECT 'row' AS axis, l_partkey AS idx, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY l_partkey
UNION ALL
SELECT 'col' AS axis, l_suppkey AS idx, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY l_suppkey""")
def q_matrix(spark, d):
    li = table(spark, d, "lineitem")
    m = VX.matrix_sums(li, "l_partkey", "l_suppkey", "l_quantity")
    return m.select("axis", "idx", F.round("total", 6).alias("total"))


@query("matrix_add", ops=("B9",), sql="""
SELECT l_partkey, l_suppkey, round(sum(v), 6) AS v FROM (
  SELECT l_partkey, l_suppkey, l_quantity AS v FROM lineitem
  UNION ALL SELECT l_partkey, l_suppkey, l_discount AS v FROM lineitem) GROUP BY 1, 2""")
def q_matrix_add(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select("l_partkey", "l_suppkey", F.col("l_quantity").alias("v"))
    b = li.select("l_partkey", "l_suppkey", F.col("l_discount").alias("v"))
    return VX.matrix_add(a, b, "l_partkey", "l_suppkey", "v").select("l_partkey", "l_suppkey", F.round("v", 6).alias("v"))


# ---------------------------------------------------------------- B10 / B36 / B37
@query("cumulative_return", ops=("B10",), sql="""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum FROM events""")
def q_cumulative(spark, d):
    ev = table(spark, d, "events")
    c = VX.running_sum(ev, "user_id", ["ts", "event_id"], "value", day_bucket(ev, "ts"), "cum")
    return c.select("event_id", F.round("cum", 6).alias("cum"))


@query("change_flag", ops=("B36",), sql="""
SELECT event_id, CASE WHEN lag(event_type) OVER w IS NULL THEN 0
                      WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS changed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_change_flag(spark, d):
    ev = table(spark, d, "events")
    return VX.change_flag(ev, "user_id", ["ts", "event_id"], "event_type", day_bucket(ev, "ts")) \
        .select("event_id", "changed")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


_MH_SEP = " || ',' || "


@query("multi_hot", ops=("B37",), sql=f"""
SELECT user_id, {_MH_SEP.join(f"CAST(max(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS VARCHAR)" for t in EVENT_TYPES)} AS multi_hot
FROM events GROUP BY user_id""")
def q_multi_hot(spark, d):
    mh = VX.multi_hot(table(spark, d, "events"), "user_id", "event_type", EVENT_TYPES)
    return mh.select("user_id", F.array_join(F.transform("multi_hot", lambda x: x.cast("string")), ",").alias("multi_hot"))


# ---------------------------------------------------------------- B12 / B13
PAIR_RADIUS = 1.12  # pairs of the series whose vectors are this close
PAIRS_SQL = f"""
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b,
    list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d
  FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id
  WHERE list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) <= {PAIR_RADIUS})"""


def close_pairs(e):
    """The pairs of vectors within ``PAIR_RADIUS``: ``a`` < ``b`` and their distance ``d``."""
    return eps_pairs(e, "vec_id", "embedding", PAIR_RADIUS).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("dist").alias("d"))


@query("pair_distance", ops=("B12",), sql=W("""
SELECT a, b, round(sqrt(list_sum(list_transform(list_zip(ca, cb), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS dist
FROM (SELECT p.a, p.b,
        list_transform(generate_series(1, len(x.embedding)), lambda i: list_sum(CAST(x.embedding AS DOUBLE[])[1:i])) AS ca,
        list_transform(generate_series(1, len(y.embedding)), lambda i: list_sum(CAST(y.embedding AS DOUBLE[])[1:i])) AS cb
      FROM pairs p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b)""", PAIRS_SQL))
def q_pair_distance(spark, d):
    e = _emb(spark, d)
    r = VX.pair_distance(close_pairs(e), "a", "b", e, "vec_id", "embedding")
    return r.select("a", "b", F.round("dist", 6).alias("dist"))


@query("pair_correlation", ops=("B13",), sql=W("""
SELECT a, b, round(corr(xa, xb), 6) AS corr FROM (
  SELECT p.a, p.b, unnest(CAST(x.embedding AS DOUBLE[])) AS xa, unnest(CAST(y.embedding AS DOUBLE[])) AS xb
  FROM pairs p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b) GROUP BY a, b""", PAIRS_SQL))
def q_pair_corr(spark, d):
    e = _emb(spark, d)
    r = VX.pair_corr(close_pairs(e), "a", "b", e, "vec_id", "embedding")
    return r.select("a", "b", F.round("corr", 6).alias("corr"))


# ---------------------------------------------------------------- B18 / B20
@query("split_by_cluster", ops=("B18",), sql="""
SELECT label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY label""")
def q_members(spark, d):
    path = io.scratch_path(spark, "members")
    VX.members(_emb(spark, d).select("vec_id", "label"), "label", path)
    back = spark.read.parquet(path)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"),
                                     F.max("vec_id").alias("last_id"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", ops=("B20",), sql=f"""
SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal,
       {', '.join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s}" for s in SEGMENTS)}
FROM customer""")
def q_one_hot(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")
    return VX.one_hot(c, "c_mktsegment")


# ---------------------------------------------------------------- B25 - B28
@query("linear_regression", ops=("B25",), sql="""
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*) AS n
FROM lineitem GROUP BY l_returnflag""")
def q_regression(spark, d):
    r = M.simple_regression(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", by=["l_returnflag"])
    return r.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


CONF_SQL = """
conf AS (SELECT d.lang,
  count_if(l.quality = 0 AND l.toxic = 1) AS m00, count_if(l.quality = 0 AND l.toxic = 0) AS m01,
  count_if(l.quality = 1 AND l.toxic = 1) AS m10, count_if(l.quality = 1 AND l.toxic = 0) AS m11, count(*) AS n
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY ROLLUP (d.lang))"""


def _scored_labels(spark, d):
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    # prediction of "quality": not toxic
    return lab.join(docs, "doc_id").withColumn("pred", (1 - F.col("toxic")).cast("int"))


@query("confusion_matrix", ops=("B26",), sql=W("""
SELECT m00, m01, m10, m11, n, round((m00 + m11) / n, 6) AS accuracy FROM conf WHERE lang IS NULL""", CONF_SQL))
def q_confusion(spark, d):
    return M.confusion(_scored_labels(spark, d), "quality", "pred")


@query("subgroup_confusion", ops=("B27",), sql=W("""
SELECT lang, m00, m01, m10, m11, n, round((m00 + m11) / n, 6) AS accuracy FROM conf WHERE lang IS NOT NULL""", CONF_SQL))
def q_subgroup(spark, d):
    return M.confusion(_scored_labels(spark, d), "quality", "pred", by=["lang"])


def _ratio_sql(a, b):
    return f"round(CASE WHEN ({b}) = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / ({b}) END, 6)"


@query("fairness_metrics", ops=("B28",), sql=W(f"""
SELECT lang, m00, m01, m10, m11, n, round((m00 + m11) / n, 6) AS accuracy, m00 + m11 AS parity,
       {_ratio_sql('m00', 'm00 + m10')} AS tpr_ref, {_ratio_sql('m10', 'm10 + m00')} AS fnr_ref,
       {_ratio_sql('m11', 'm11 + m10')} AS tpr, {_ratio_sql('m10', 'm10 + m11')} AS fnr
FROM conf WHERE lang IS NOT NULL""", CONF_SQL))
def q_fairness(spark, d):
    return M.fairness(M.confusion(_scored_labels(spark, d), "quality", "pred", by=["lang"]))
