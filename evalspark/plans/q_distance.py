"""Distances, dependency sentences, interval / as-of joins (build-plan step 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import deps as D
from evalspark.functions import rates as R
from evalspark.functions.time import epoch_us
from evalspark.functions.constants import PY_SENTENCE
from evalspark.operators import rates as A
from evalspark.operators import spans as S
from evalspark.plans import sqlfrag as Q
from evalspark.plans import views as V
from evalspark.plans.registry import query
from evalspark.session import cut, table

LAGS = V.LAGS_SQL
SHORT, MEDIUM = 300, 1000
DAY_US = 86_400_000_000
WINDOW_US = 6 * 3_600_000_000      # J6: clicks in the 6 hours up to a purchase
NEAR_US = 3_600_000_000            # P12 / A9: previous view within one hour
W1_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"]

# event type -> reason label used when events are rendered as reason records
EVENT_REASON = [("click", "If Condition"), ("view", "Loop Body"), ("purchase", "If Body"),
                ("signup", "Else Reasoning"), ("error", "Pattern-Based Completion")]


def W(body, *ctes):
    return V.with_views(body, *ctes)


def _sentence_sql(name, use, def_, scope, rng) -> str:
    parts = []
    for sc, (subject, middle) in PY_SENTENCE.items():
        parts.append(f"WHEN {scope} = '{sc}' THEN printf('{subject} ''%s'' used at line %d {middle} %d "
                     f"and has a %s dependency.', {name}, {use}, {def_}, {rng})")
    undefined = (f"printf('Variable ''%s'' used at line %d is undefined and has a %s dependency.', "
                 f"{name}, {use}, {rng})")
    return f"(CASE WHEN {scope} = 'builtin' THEN NULL {' '.join(parts)} ELSE {undefined} END)"


USABLE_SQL = ("NOT coalesce(usage_line = def_line AND scope_type NOT IN ('list_comp', 'generator_exp', 'lambda'), false) "
              "AND coalesce(scope_type, '') <> 'builtin'")

SENT_SQL = f"""
sent AS (
  SELECT l_orderkey, o.passed, {_sentence_sql('name', 'usage_line', 'def_line', 'scope_type',
                                               Q.range_class('abs_diff', SHORT, MEDIUM))} AS sentence
  FROM lags o WHERE {USABLE_SQL})"""


def lags_usable(spark, d):
    lg = V.lags(spark, d)
    return lg.filter(D.usable("usage_line", "def_line", "scope_type"))


def sentences(spark, d):
    lg = lags_usable(spark, d)
    rng = R.range_class("abs_diff", SHORT, MEDIUM)
    return lg.select("l_orderkey", "passed",
                     D.render_dependency("name", "usage_line", "def_line", "scope_type", rng).alias("sentence"))


# ---------------------------------------------------------------- P11 / P13
@query("range_class", ops=("P11",), sql=W(f"""
SELECT scope_type, {Q.range_class('abs_diff', SHORT, MEDIUM)} AS range_type, count(*) AS n
FROM lags GROUP BY 1, 2""", LAGS))
def q_range_class(spark, d):
    lg = V.lags(spark, d)
    return lg.groupBy("scope_type", R.range_class("abs_diff", SHORT, MEDIUM).alias("range_type")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("skip_trivial_usage", ops=("P13",), sql=W(f"""
SELECT scope_type, count(*) AS n_kept FROM lags WHERE {USABLE_SQL} GROUP BY scope_type""", LAGS))
def q_usable(spark, d):
    return lags_usable(spark, d).groupBy("scope_type").agg(F.count(F.lit(1)).alias("n_kept"))


# ---------------------------------------------------------------- P15 / F1 / F2
@query("render_dependency", ops=("P15",), sql=W("SELECT l_orderkey, sentence FROM sent", LAGS, SENT_SQL))
def q_render(spark, d):
    return sentences(spark, d).select("l_orderkey", "sentence")


DIST_PAT = D.DISTANCE_PATTERN
DP = Q.sql_str(DIST_PAT)


@query("extract_distances", ops=("F1", "F2"), sql=W(f"""
SELECT l_orderkey, m[1] AS type, CAST(m[2] AS INTEGER) AS usage_line, CAST(m[3] AS INTEGER) AS def_line,
       abs(CAST(m[2] AS INTEGER) - CAST(m[3] AS INTEGER)) AS abs_diff
FROM (SELECT l_orderkey,
             [nullif(regexp_extract(sentence, {DP}, 1), ''),
              nullif(regexp_extract(sentence, {DP}, 2), ''),
              nullif(regexp_extract(sentence, {DP}, 3), '')] AS m
      FROM sent)""", LAGS, SENT_SQL))
def q_extract_distances(spark, d):
    s = sentences(spark, d).select("l_orderkey", D.extract_distances("sentence").alias("m"))
    e = s.select("l_orderkey", F.explode_outer("m").alias("t"))
    return e.select("l_orderkey", F.col("t.type").alias("type"), F.col("t.usage_line").alias("usage_line"),
                    F.col("t.def_line").alias("def_line"),
                    F.abs(F.col("t.usage_line") - F.col("t.def_line")).alias("abs_diff"))


# ---------------------------------------------------------------- W1 / A8 / W8
W1_SQL = """
w1 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey
             ORDER BY abs_diff DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) AS rn
    FROM lags WHERE l_orderkey IS NOT NULL) WHERE rn = 1)"""


@query("max_distance_row", ops=("W1",), sql=W("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, abs_diff, scope_type, passed FROM w1""", LAGS, W1_SQL))
def q_max_distance_row(spark, d):
    # project first: the arg-max carries its payload inside an aggregated
    # struct, where unused fields can no longer be pruned
    lg = V.lags(spark, d).select("l_orderkey", "abs_diff", *W1_ORDER, "scope_type", "passed")
    best = S.max_distance_row(lg, ["l_orderkey"], "abs_diff", W1_ORDER)
    return best.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "abs_diff", "scope_type", "passed")


@query("range_class_pass_rate", ops=("A8", "W8"), sql=W(f"""
SELECT range_type, count(*) AS n_total, count_if(passed) AS n_pass,
       round({Q.rate('count_if(passed)', 'count(*)')}, 6) AS pass_rate,
       CASE range_type WHEN 'Short-Range' THEN 1 WHEN 'Medium-Range' THEN 2 WHEN 'Long-Range' THEN 3 END AS class_rank
FROM (SELECT {Q.range_class('abs_diff', SHORT, MEDIUM)} AS range_type, passed FROM w1) GROUP BY range_type
""", LAGS, W1_SQL))
def q_range_class_rate(spark, d):
    lg = V.lags(spark, d).select("l_orderkey", "abs_diff", *W1_ORDER, "passed")
    best = S.max_distance_row(lg, ["l_orderkey"], "abs_diff", W1_ORDER)
    c = best.select(R.range_class("abs_diff", SHORT, MEDIUM).alias("range_type"), "passed")
    rates = A.class_pass_rate(c, "range_type", "passed", order=["Short-Range", "Medium-Range", "Long-Range"])
    return S.order_by_class(rates, "range_type")


# ---------------------------------------------------------------- A12 horizon
H_PAT = D.HORIZON_PATTERN
HP = Q.sql_str(H_PAT)


@query("label_frequency", ops=("A12",), sql=W(f"""
SELECT category, count(*) AS n FROM (
  SELECT CASE WHEN coalesce(g3, '') <> '' THEN g1 || ' ' || g3 || ' ' || g4 ELSE g1 || ' ' || g2 END AS category
  FROM (SELECT unnest(regexp_extract_all(sentence, {HP}, 1)) AS g1,
               unnest(regexp_extract_all(sentence, {HP}, 2)) AS g2,
               unnest(regexp_extract_all(sentence, {HP}, 3)) AS g3,
               unnest(regexp_extract_all(sentence, {HP}, 4)) AS g4 FROM sent))
GROUP BY category""", LAGS, SENT_SQL))
def q_label_frequency(spark, d):
    s = sentences(spark, d).select(F.explode(D.horizon_categories("sentence")).alias("category"))
    return s.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- A14 / A15
@query("mean_std_distance", ops=("A14",), sql=W("""
SELECT scope_type, round(avg(abs_diff), 6) AS mean_dist, round(stddev_pop(abs_diff), 6) AS std_dist,
       count(abs_diff) AS n
FROM lags GROUP BY scope_type""", LAGS))
def q_mean_std(spark, d):
    return A.distance_stats(V.lags(spark, d), "abs_diff", by=["scope_type"])


@query("histogram", ops=("A15",), sql=W("""
SELECT bin, count(*) AS n, count_if(passed) AS n_subset, round(min(lo) + bin * (min(hi) - min(lo)) / 30, 6) AS left_edge
FROM (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 30)), 29) END AS INTEGER) AS bin,
             passed, lo, hi
      FROM (SELECT CAST(abs_diff AS DOUBLE) AS x, passed FROM lags WHERE abs_diff IS NOT NULL),
           (SELECT CAST(min(abs_diff) AS DOUBLE) AS lo, CAST(max(abs_diff) AS DOUBLE) AS hi FROM lags))
GROUP BY bin""", LAGS))
def q_histogram(spark, d):
    return A.histogram(V.lags(spark, d), "abs_diff", bins=30, subset="passed")


# ---------------------------------------------------------------- J6 / J7 / J8 / P12 / A9
def events_us(spark, d):
    ev = table(spark, d, "events")
    return ev.withColumn("t_us", epoch_us(ev, "ts"))


@query("records_in_range", ops=("J6",), sql=f"""
SELECT p.event_id AS purchase_id, c.event_id AS click_id, p.user_id
FROM events p JOIN events c ON p.user_id = c.user_id
 AND epoch_us(c.ts) BETWEEN epoch_us(p.ts) - {WINDOW_US} AND epoch_us(p.ts)
WHERE p.event_type = 'purchase' AND c.event_type = 'click'""")
def q_records_in_range(spark, d):
    ev = events_us(spark, d)
    ck = ev.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("purchase_id"), "user_id", (F.col("t_us") - WINDOW_US).alias("lo"),
        F.col("t_us").alias("hi"))
    rc = ev.filter(F.col("event_type") == "click").select(F.col("event_id").alias("click_id"), "user_id", "t_us")
    j = S.records_in_range(ck, rc, ["user_id"], "lo", "hi", "t_us", bucket=DAY_US)
    return j.select("purchase_id", "click_id", "user_id")


ASOF_SQL = """
asofp AS (
  SELECT p.event_id, p.user_id, p.value, epoch_us(p.ts) - epoch_us(v.ts) AS gap_us
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') v
    ON p.user_id = v.user_id AND p.ts > v.ts)"""


def asof_views(spark, d):
    ev = events_us(spark, d)
    p = ev.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "value", "t_us")
    v = ev.filter(F.col("event_type") == "view").select("user_id", "t_us")
    j = S.asof_previous(p, v, ["user_id"], "t_us", "t_us", bucket=DAY_US, out="prev_us")
    return j.select("event_id", "user_id", "value", (F.col("t_us") - F.col("prev_us")).alias("gap_us"))


@query("nearest_previous_comment", ops=("J7",), sql=W("SELECT event_id, user_id, gap_us FROM asofp", ASOF_SQL))
def q_asof(spark, d):
    return asof_views(spark, d).select("event_id", "user_id", "gap_us")


LOOKUP_SQL = """
lookup AS (
  SELECT p.event_id, p.user_id, p.value, a.gap_us
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN asofp a ON a.event_id = p.event_id)"""


def lookup(spark, d):
    """Every purchase with its distance; the distances are computed once and looked up."""
    ev = events_us(spark, d)
    seen = F.when(F.col("event_type") == "view", F.col("t_us"))
    rows = S._latest_before(ev.select("event_id", "user_id", "event_type", "value", "t_us", seen.alias("prev_us")),
                            ["user_id"], "t_us", ["prev_us"], DAY_US)
    rows = cut(rows.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "value", (F.col("t_us") - F.col("prev_us")).alias("gap_us")))
    return S.attach_distance(rows.drop("gap_us"), rows.filter("gap_us IS NOT NULL"), ["event_id"], "gap_us")


@query("lookup_distance", ops=("J8",), sql=W("SELECT event_id, gap_us FROM lookup", ASOF_SQL, LOOKUP_SQL))
def q_lookup(spark, d):
    return lookup(spark, d).select("event_id", "gap_us")


@query("two_way_class", ops=("P12",), sql=W(f"""
SELECT CASE WHEN gap_us IS NULL THEN NULL WHEN gap_us <= {NEAR_US} THEN 'Short' ELSE 'Long' END AS near_far,
       count(*) AS n
FROM lookup GROUP BY 1""", ASOF_SQL, LOOKUP_SQL))
def q_two_way(spark, d):
    return lookup(spark, d).groupBy(R.near_far("gap_us", NEAR_US).alias("near_far")).agg(
        F.count(F.lit(1)).alias("n"))


@query("near_far_pass_rate", ops=("A9",), sql=W(f"""
SELECT near_far, count(*) AS n_total, count_if(passed) AS n_pass,
       round({Q.rate('count_if(passed)', 'count(*)')}, 6) AS pass_rate
FROM (SELECT CASE WHEN gap_us IS NULL THEN NULL WHEN gap_us <= {NEAR_US} THEN 'Short' ELSE 'Long' END AS near_far,
             value >= 50 AS passed FROM lookup)
WHERE near_far IS NOT NULL GROUP BY near_far""", ASOF_SQL, LOOKUP_SQL))
def q_near_far_rate(spark, d):
    c = lookup(spark, d).select(R.near_far("gap_us", NEAR_US).alias("near_far"),
                                (F.col("value") >= 50).alias("passed"))
    return A.class_pass_rate(c, "near_far", "passed")


# ---------------------------------------------------------------- P16 / A12 reason
REASON_SENT_SQL = f"""
rsent AS (
  SELECT s.user_id, printf('''%s'' detected at line %d.', m.reason, s.step) AS sentence
  FROM sessions s JOIN ({Q.values(EVENT_REASON)}) m(event_type, reason) ON m.event_type = s.event_type)"""


def reason_sentences(spark, d):
    s = V.sessions(spark, d)
    m = F.create_map(*[F.lit(x) for kv in EVENT_REASON for x in kv])
    return s.select("user_id", D.render_reason(m[F.col("event_type")], "step").alias("sentence"))


@query("render_reason", ops=("P16",), sql=W("SELECT user_id, sentence FROM rsent",
                                            V.SESSIONS_SQL, REASON_SENT_SQL))
def q_render_reason(spark, d):
    return reason_sentences(spark, d)


R_PAT = D.REASON_PATTERN
RP = Q.sql_str(R_PAT)


@query("reason_frequency", ops=("A12",), sql=W(f"""
SELECT category, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(sentence, {RP}, 1)) AS category FROM rsent)
GROUP BY category""", V.SESSIONS_SQL, REASON_SENT_SQL))
def q_reason_frequency(spark, d):
    s = reason_sentences(spark, d).select(F.explode(D.reason_categories("sentence")).alias("category"))
    return s.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- W6 / W7
@query("stable_sort_distinct", ops=("W6",), sql="""
SELECT DISTINCT user_id, event_type, CAST(value >= 50 AS INTEGER) AS high FROM events""")
def q_dedupe(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type", (F.col("value") >= 50).cast("int").alias("high"))
    return S.dedupe_records(ev, order="user_id")


@query("repeated_condition", ops=("W7",), sql="""
SELECT event_type, count_if(rn > 1) AS n_repeated, count(*) AS n
FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
GROUP BY event_type""")
def q_repeated(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    f = S.seen_before(ev, ["user_id", "event_type"], ["ts", "event_id"])
    return f.groupBy("event_type").agg(F.count_if("repeated").alias("n_repeated"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- J9
DEF_PRIORITY = ["view", "click", "signup", "error"]


HOUR_US = 3_600_000_000
DEF_SCOPES = [6 * HOUR_US, DAY_US, 7 * DAY_US, None]  # nested, innermost first; then the whole user


def _j9_sql():
    parts, joins = [], []
    for i, k in enumerate(DEF_PRIORITY):
        parts.append(f"""m{i} AS (SELECT p.event_id, v.event_id AS def_id, v.t AS dt FROM p
  ASOF JOIN (SELECT * FROM dd WHERE event_type = '{k}') v
  ON p.user_id = v.user_id AND p.t > v.t)""")
        joins.append(f"LEFT JOIN m{i} ON m{i}.event_id = p.event_id")
    n = range(len(DEF_PRIORITY))
    tests = [(f"floor(m{i}.dt / {s}) = floor(p.t / {s})" if s else f"m{i}.dt IS NOT NULL", i) for s in DEF_SCOPES for i in n]

    def pick(value):
        return "CASE " + " ".join(f"WHEN {t} THEN {value(i)}" for t, i in tests) + " END"

    return f"""WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
dd AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events WHERE event_type <> 'purchase'),
{', '.join(parts)}
SELECT p.event_id, {pick(lambda i: f'm{i}.def_id')} AS def_id,
       {pick(lambda i: repr(DEF_PRIORITY[i]))} AS def_kind, p.t - {pick(lambda i: f'm{i}.dt')} AS gap_us
FROM p {' '.join(joins)}"""


@query("resolve_definition", ops=("J9",), sql=_j9_sql())
def q_resolve(spark, d):
    ev = events_us(spark, d)
    uses = ev.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "t_us")
    defs = ev.filter(F.col("event_type") != "purchase").select(
        "user_id", "t_us", "event_type", F.struct("t_us", F.col("event_id").alias("def_id")).alias("v"))
    r = S.resolve_definition(uses, defs, "event_id", ["user_id"], "t_us", DEF_SCOPES, "event_type",
                             DEF_PRIORITY, "v", out="definition", bucket=float(DAY_US))
    return r.select("event_id", F.col("definition.def_id").alias("def_id"), F.col("definition_kind").alias("def_kind"),
                    (F.col("t_us") - F.col("definition.t_us")).alias("gap_us"))
