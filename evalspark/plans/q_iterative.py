"""Iterative, random and model-fitting rows (checked by row count + pytest invariants)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import graph as G
from evalspark.operators import models as M
from evalspark.operators import sampling as SM
from evalspark.operators import vectors as VX
from evalspark.plans import views as V
from evalspark.plans.views import with_views as W
from evalspark.plans.q_tier_b import PAIRS_SQL, _scored_labels, close_pairs
from evalspark.plans.registry import query
from evalspark.session import table


def _edges(spark, d):
    """Edges of the matching: the pairs of vectors within the radius, weighted by distance."""
    return close_pairs(table(spark, d, "embeddings")).select("a", "b", F.round("d", 9).alias("w"))


# Greedy matching in SQL: the lightest free edge is taken, one per step.
MATCHING_SQL = f"""WITH RECURSIVE {PAIRS_SQL},
edge AS (SELECT a, b, round(d, 9) AS w, row_number() OVER (ORDER BY round(d, 9), a, b) AS k FROM pairs),
walk(k, used, a, b, w) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT e.k, CASE WHEN list_contains(t.used, e.a) OR list_contains(t.used, e.b) THEN t.used ELSE list_concat(t.used, [e.a, e.b]) END,
         CASE WHEN list_contains(t.used, e.a) OR list_contains(t.used, e.b) THEN NULL ELSE e.a END, e.b, e.w
  FROM walk t JOIN edge e ON e.k = t.k + 1),
matched AS (SELECT a, b, w FROM walk WHERE a IS NOT NULL)"""


@query("greedy_matching", ops=("B14",), sql=MATCHING_SQL + " SELECT a, b, w FROM matched")
def q_greedy(spark, d):
    return G.greedy_match(_edges(spark, d))


@query("pca_whiten", ops=("B15",))
def q_pca(spark, d):
    p = M.pca_whiten(table(spark, d, "embeddings"), "embedding", k=10)
    return p.select("vec_id", F.round(F.col("components")[0], 6).alias("pc1_z"))


DBSCAN_SQL = f"""WITH RECURSIVE {PAIRS_SQL},
near AS (SELECT a AS i, b AS j, d FROM pairs UNION ALL SELECT b, a, d FROM pairs),
core AS (SELECT vec_id AS i FROM embeddings WHERE (SELECT count(*) FROM near WHERE near.i = vec_id) + 1 >= 3),
reach(i, j) AS (SELECT i, i FROM core UNION SELECT r.i, n.j FROM reach r JOIN near n ON n.i = r.j WHERE n.j IN (SELECT i FROM core)),
lab AS (SELECT i, min(j) AS cluster FROM reach GROUP BY i),
border AS (SELECT n.i, arg_min(l.cluster, (n.d, n.j)) AS cluster FROM near n JOIN lab l ON l.i = n.j
           WHERE n.i NOT IN (SELECT i FROM core) GROUP BY n.i)
SELECT e.vec_id, coalesce(l.cluster, b.cluster, -1) AS cluster FROM embeddings e
LEFT JOIN lab l ON l.i = e.vec_id LEFT JOIN border b ON b.i = e.vec_id"""


@query("dbscan", ops=("B16",), sql=DBSCAN_SQL)
def q_dbscan(spark, d):
    e = table(spark, d, "embeddings")
    return G.dbscan(e, "vec_id", "embedding", eps=1.12, min_pts=3)


@query("kmeans", ops=("B17",))
def q_kmeans(spark, d):
    lab, _centres = M.kmeans(table(spark, d, "embeddings"), "embedding", k=5, seed=42)
    return lab.select("vec_id", "cluster")


@query("sample_rows", ops=("B19",), sql=f"""
SELECT c_custkey, c_mktsegment FROM customer ORDER BY {SM.uniform01_sql('c_custkey', seed=42)}, c_custkey LIMIT 100""")
def q_sample(spark, d):
    return SM.sample_n(table(spark, d, "customer"), "c_custkey", 100, seed=42).select("c_custkey", "c_mktsegment")


@query("train_test_split", ops=("B21",), sql=f"""
SELECT c_custkey, CASE WHEN {SM.uniform01_sql('c_custkey', seed=42)} < 0.8 THEN 'train' ELSE 'test' END AS part FROM customer""")
def q_split(spark, d):
    tr, te = SM.split(table(spark, d, "customer"), "c_custkey", 0.8, seed=42)
    return tr.select("c_custkey", F.lit("train").alias("part")).unionByName(
        te.select("c_custkey", F.lit("test").alias("part")))


def _features(spark, d):
    s = _scored_labels(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    s = s.join(docs, "doc_id")
    s = VX.one_hot(s.withColumn("lang_", F.col("lang")), "lang_", ["de", "en", "es", "fr"])
    s = s.withColumn("log_chars", F.log1p("n_chars").cast("double"))
    s = M.assemble(s, ["log_chars", "toxic", "lang__de", "lang__en", "lang__es", "lang__fr"])
    s = M.balanced_weights(s, "quality")
    tr, te = SM.split(s, "doc_id", 0.8, seed=7)
    return tr, te


def _eval(pred):
    return M.confusion(pred.withColumn("p", F.col("prediction").cast("int")), "quality", "p", by=["lang"])


@query("gaussian_nb", ops=("B22",))
def q_nb(spark, d):
    tr, te = _features(spark, d)
    return _eval(M.gaussian_nb(tr, te, "quality"))


@query("random_forest", ops=("B23",))
def q_rf(spark, d):
    tr, te = _features(spark, d)
    return _eval(M.random_forest(tr, te, "quality"))


@query("svm_classify", ops=("B24",))
def q_svm(spark, d):
    tr, te = _features(spark, d)
    return _eval(M.rbf_svm(tr, te, "quality"))


@query("linear_regression_fit", ops=("B25",))
def q_linreg(spark, d):
    tr, te = _features(spark, d)
    p = M.linear_reg(tr, te, "quality")
    return p.select("doc_id", F.round("prediction", 6).alias("prediction"))


@query("unaware_compare", ops=("B29",))
def q_unaware(spark, d):
    """Refit without the protected attribute (language) and compare per group."""
    tr, te = _features(spark, d)
    aware = _eval(M.random_forest(tr, te, "quality")).withColumn("model", F.lit("aware"))
    cols = ["log_chars", "toxic"]
    tr2 = M.assemble(tr.drop("features"), cols)
    te2 = M.assemble(te.drop("features"), cols)
    unaware = _eval(M.random_forest(tr2, te2, "quality")).withColumn("model", F.lit("unaware"))
    return M.fairness(aware.unionByName(unaware))


@query("uniform_samples", ops=("B30",), sql=f"""
SELECT c_custkey, 2.0::DOUBLE + {SM.uniform01_sql('c_custkey', seed=3)} * 3.0::DOUBLE AS u FROM customer""")
def q_uniform(spark, d):
    u = SM.uniform(table(spark, d, "customer"), "c_custkey", 2.0, 5.0, seed=3)
    return u.select("c_custkey", "u")


@query("multinomial_samples", ops=("B31",), sql=f"""
WITH p AS (SELECT event_type, count(*)::DOUBLE AS p FROM events GROUP BY event_type),
c AS (SELECT event_type, sum(p) OVER (ORDER BY event_type) / (SELECT sum(p) FROM p) AS hi FROM p),
iv AS (SELECT event_type, coalesce(lag(hi) OVER (ORDER BY event_type), 0) AS lo,
              CASE WHEN lead(hi) OVER (ORDER BY event_type) IS NULL THEN 1 ELSE hi END AS hi FROM c),
u AS (SELECT {SM.uniform01_sql('event_id', seed=5)} AS u FROM events)
SELECT iv.event_type, count(u.u) AS n FROM iv LEFT JOIN u ON u.u >= iv.lo AND u.u < iv.hi GROUP BY iv.event_type""")
def q_multinomial(spark, d):
    ev = table(spark, d, "events")
    probs = ev.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("p"))
    return SM.multinomial(ev, "event_id", probs, "event_type", "p", seed=5)


def _gamma_sql(idc: str, shape: float, seed: int, stream: int = 0) -> str:
    """``SM.standard_gamma`` in DuckDB SQL."""
    u = SM.uniform01_sql
    whole, part = int(shape), shape - int(shape)
    terms = [f"-ln(1.0::DOUBLE - {u(idc, str(j), str(stream), seed=seed)})" for j in range(1, whole + 1)]
    if part > 1e-12:
        x, y = (f"pow({u(idc, 'j', str(stream), repr(c), seed=seed)}, {e!r}::DOUBLE)" for c, e in (("x", 1.0 / part), ("y", 1.0 / (1.0 - part))))
        pair = f"list_transform(generate_series(1, {SM.JOHNK_TRIES}), lambda j: [{x}, {x} + {y}])"
        ratio = f"list_transform([t FOR t IN {pair} IF t[2] <= 1.0 AND t[2] > 0.0], lambda t: t[1] / t[2])[1]"
        terms.append(f"(-ln(1.0::DOUBLE - {u(idc, '0', str(stream), repr('e'), seed=seed)})) * {ratio}")
    return "(0.0::DOUBLE + " + " + ".join(terms) + ")"


def _spread(ids):
    """Ids dealt out evenly: their draws cost far more than they do, and a file may have few row groups."""
    return ids.repartition(4 * ids.sparkSession.sparkContext.defaultParallelism)


GAMMA_SHAPE, ALPHAS = 2.5, (1.0, 2.0, 0.5)
GAMMA_SQL = f"""
SELECT c_custkey, round(gamma, 6) AS gamma, round(g0 / (g0 + g1 + g2), 6) AS dir0, round(g1 / (g0 + g1 + g2), 6) AS dir1,
       round(g2 / (g0 + g1 + g2), 6) AS dir2, u
FROM (SELECT c_custkey, 2.0::DOUBLE * {_gamma_sql('c_custkey', GAMMA_SHAPE, 11)} AS gamma,
             {', '.join(f"{_gamma_sql('c_custkey', a, 13, i)} AS g{i}" for i, a in enumerate(ALPHAS))},
             {SM.uniform01_sql('c_custkey', seed=3)} AS u FROM customer)"""


@query("gamma_dirichlet_samples", ops=("B32",), sql=f"SELECT c_custkey, gamma, dir0, dir1, dir2 FROM ({GAMMA_SQL})")
def q_gamma(spark, d):
    c = _spread(table(spark, d, "customer").select("c_custkey"))
    g = SM.gamma(c, "c_custkey", GAMMA_SHAPE, 2.0, seed=11)
    g = SM.dirichlet(g, "c_custkey", ALPHAS, seed=13)
    return g.select("c_custkey", F.round("gamma", 6).alias("gamma"), *[F.round(F.col("dirichlet")[i], 6).alias(f"dir{i}") for i in range(len(ALPHAS))])


@query("sampler_moments", ops=("B33",), sql=f"""
SELECT round(avg(u), 6) AS mean, round(stddev_pop(u), 6) AS std, count(u) AS n, 'uniform' AS sampler FROM ({GAMMA_SQL})
UNION ALL SELECT round(avg(gamma), 6), round(stddev_pop(gamma), 6), count(gamma), 'gamma' FROM ({GAMMA_SQL})""")
def q_moments(spark, d):
    c = _spread(table(spark, d, "customer").select("c_custkey"))
    g = SM.gamma(SM.uniform(c, "c_custkey", 0.0, 1.0, seed=3), "c_custkey", GAMMA_SHAPE, 2.0, seed=11).withColumn("gamma", F.round("gamma", 6))
    out = SM.moments(g, "u").withColumn("sampler", F.lit("uniform")).unionByName(
        SM.moments(g, "gamma").withColumn("sampler", F.lit("gamma")))
    return out.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n", "sampler")


ENDS_SQL = """
ends AS (SELECT user_id, coalesce(min(CASE WHEN success AND step > 0 THEN step END), max(step)) AS end_step
         FROM sessions GROUP BY user_id)"""


@query("weighted_episode_sample", ops=("B34",), sql=W(f"""
SELECT d.draw, c.user_id, c.end_step, CAST(floor({SM.uniform01_sql('d.draw', '1', seed=21)} * (c.end_step + 1)) AS INTEGER) AS step
FROM (SELECT draw, floor({SM.uniform01_sql('draw', seed=21)} * (SELECT sum(end_step + 1) FROM ends)::DOUBLE) + 0.5 AS pos
      FROM (SELECT unnest(generate_series(0, 999)) AS draw)) d
JOIN (SELECT *, sum(end_step + 1) OVER (ORDER BY user_id) AS hi FROM ends) c ON d.pos < c.hi AND d.pos >= c.hi - c.end_step - 1""",
    V.SESSIONS_SQL, ENDS_SQL))
def q_episode_sample(spark, d):
    s = V.sessions(spark, d)
    return SM.sample_steps(s, "user_id", "step", "success", n=1000, seed=21)


@query("future_goal_relabel", ops=("B35",), sql=W(f"""
SELECT s.user_id, s.step, e.end_step, g.value AS goal FROM sessions s JOIN ends e USING (user_id)
LEFT JOIN sessions g ON g.user_id = s.user_id AND s.step < e.end_step
  AND g.step = s.step + CAST(floor({SM.uniform01_sql('s.user_id', 's.step', seed=23)} * (e.end_step - s.step)) AS INTEGER)""",
    V.SESSIONS_SQL, ENDS_SQL))
def q_relabel(spark, d):
    s = V.sessions(spark, d).withColumn("state", F.col("value"))
    r = SM.relabel_future_goal(s, "user_id", "step", "state", "success", seed=23)
    return r.select("user_id", "step", "end_step", "goal")


@query("pair_matching_distance", ops=("B12", "B14"), sql=MATCHING_SQL + """
SELECT a, b, round(sqrt(list_sum(list_transform(list_zip(ca, cb), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS dist
FROM (SELECT p.a, p.b,
        list_transform(generate_series(1, len(x.embedding)), lambda i: list_sum(CAST(x.embedding AS DOUBLE[])[1:i])) AS ca,
        list_transform(generate_series(1, len(y.embedding)), lambda i: list_sum(CAST(y.embedding AS DOUBLE[])[1:i])) AS cb
      FROM matched p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b)""")
def q_pair_match(spark, d):
    """Pairs of the matching re-scored by the distance of their cumulative series."""
    e = table(spark, d, "embeddings")
    m = G.greedy_match(_edges(spark, d))
    return VX.pair_distance(m.select("a", "b"), "a", "b", e, "vec_id", "embedding") \
        .select("a", "b", F.round("dist", 6).alias("dist"))

