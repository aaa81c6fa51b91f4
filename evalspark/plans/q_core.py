"""Core parsing and rates over the ``runs`` view (build-plan steps 1-2, 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import rates as R
from evalspark.functions.constants import HORIZON_LABELS, REASON_LABELS
from evalspark.operators import rates as A
from evalspark.operators.tables import keyed_union, union_runs
from evalspark.plans import sqlfrag as Q
from evalspark.plans import views as V
from evalspark.plans.registry import query
from evalspark.session import table

RUNS = V.RUNS_SQL
SCORED_SQL = f"""
scored AS (SELECT *, {Q.parse_ratio('pass_ratio')} AS ratio,
                  {Q.parse_ratio('pass_ratio')} = 1.0 AS is_pass FROM runs)"""

MODEL_FAMILY = {"src0": "family_a", "src1": "family_a", "src2": "family_b", "src3": "family_b"}


def scored(spark, d):
    r = V.runs(spark, d)
    return r.withColumn("ratio", R.parse_ratio("pass_ratio")).withColumn("is_pass", R.is_pass("ratio"))


def W(body, *ctes):
    return V.with_views(body, *ctes)


# ---------------------------------------------------------------- A6 + A10
@query("leaderboard", ops=("A6", "A10"), sql=W("""
SELECT model, mode, CAST(sum(passed) AS BIGINT) AS n_pass, count(*) AS n_total,
       round(""" + Q.rate("sum(passed)", "count(*)") + """, 6) AS pass_rate,
       round(""" + Q.err("sum(passed)", "count(*)") + """, 6) AS err95
FROM runs GROUP BY model, mode""", RUNS))
def q_leaderboard(spark, d):
    return A.leaderboard(V.runs(spark, d), by=["model", "mode"], passed="passed")


@query("leaderboard_rollup", ops=("A6",), sql=W("""
SELECT model, mode, CAST(sum(passed) AS BIGINT) AS n_pass, count(*) AS n_total,
       round(""" + Q.rate("sum(passed)", "count(*)") + """, 6) AS pass_rate,
       round(""" + Q.err("sum(passed)", "count(*)") + """, 6) AS err95
FROM runs GROUP BY ROLLUP (model, mode)""", RUNS))
def q_leaderboard_rollup(spark, d):
    return A.leaderboard(V.runs(spark, d), by=["model", "mode"], passed="passed", with_totals=True)


@query("error_bar", ops=("A10",), sql=W("""
SELECT model, CAST(sum(k_passed) AS BIGINT) AS k, CAST(sum(n_tests) AS BIGINT) AS n,
       round(""" + Q.err("sum(k_passed)", "sum(n_tests)") + """, 6) AS err95
FROM runs GROUP BY model""", RUNS))
def q_error_bar(spark, d):
    r = V.runs(spark, d).groupBy("model").agg(F.sum("k_passed").cast("long").alias("k"),
                                              F.sum("n_tests").cast("long").alias("n"))
    return r.select("model", "k", "n", F.round(R.error_bar("k", "n"), 6).alias("err95"))


@query("bootstrap_error_bar", ops=("A11",))
def q_bootstrap(spark, d):
    lb = A.leaderboard(V.runs(spark, d), by=["model"], passed="passed")
    boot = A.bootstrap_error_bar(lb, ["model"], reps=10_000)
    return lb.join(boot, "model").select("model", "n_pass", "n_total", "err95",
                                         F.round("boot_rate", 6).alias("boot_rate"),
                                         F.round("boot_err95", 6).alias("boot_err95"))


# ---------------------------------------------------------------- P1 / P2 / P3
@query("parse_run_name", ops=("P1",), sql=W(f"""
SELECT doc_id, run_name, {Q.run_name_group('run_name', 1)} AS model_name,
       {Q.run_name_group('run_name', 2)} AS gen_mode, {Q.run_name_group('run_name', 3)} AS task,
       {Q.run_name_group('run_name', 4)} AS stamp
FROM runs""", RUNS))
def q_parse_run_name(spark, d):
    r = V.runs(spark, d)
    return r.select("doc_id", "run_name", R.parse_run_name("run_name").alias("p")).select(
        "doc_id", "run_name", F.col("p.model").alias("model_name"), F.col("p.mode").alias("gen_mode"),
        F.col("p.task").alias("task"), F.col("p.stamp").alias("stamp"))


@query("parse_run_name_positional", ops=("P2",), sql=W("""
SELECT doc_id, parts[1] AS model_name, array_to_string(parts[2:3], '_') AS gen_mode,
       parts[4] AS task, array_to_string(parts[5:], '_') AS stamp
FROM (SELECT doc_id, string_split(run_name, '_') AS parts FROM runs)""", RUNS))
def q_parse_run_parts(spark, d):
    r = V.runs(spark, d)
    return r.select("doc_id", R.parse_run_parts("run_name").alias("p")).select(
        "doc_id", F.col("p.model").alias("model_name"), F.col("p.mode").alias("gen_mode"),
        F.col("p.task").alias("task"), F.col("p.stamp").alias("stamp"))


@query("alias_models", ops=("P3",), sql=W(f"""
SELECT coalesce(m.family, r.model) AS family, count(*) AS n_rows, CAST(sum(passed) AS BIGINT) AS n_pass
FROM runs r LEFT JOIN ({Q.values(MODEL_FAMILY.items())}) m(model, family) ON m.model = r.model
GROUP BY 1""", RUNS))
def q_alias_models(spark, d):
    r = V.runs(spark, d)
    return r.groupBy(R.alias_models("model", MODEL_FAMILY).alias("family")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("passed").cast("long").alias("n_pass"))


# ---------------------------------------------------------------- P4 / P5
@query("parse_ratio", ops=("P4",), sql=W(f"""
SELECT doc_id, pass_ratio, round({Q.parse_ratio('pass_ratio')}, 6) AS ratio FROM runs""", RUNS))
def q_parse_ratio(spark, d):
    return V.runs(spark, d).select("doc_id", "pass_ratio", F.round(R.parse_ratio("pass_ratio"), 6).alias("ratio"))


@query("is_pass", ops=("P5",), sql=W("""
SELECT model, count_if(is_pass) AS n_pass, count(*) AS n_rows FROM scored GROUP BY model""", RUNS, SCORED_SQL))
def q_is_pass(spark, d):
    return scored(spark, d).groupBy("model").agg(F.count_if("is_pass").alias("n_pass"),
                                                 F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- P17 / P18
@query("format_rate", ops=("P17",), sql=W(f"""
SELECT model, mode, {Q.fmt_rate('sum(passed)', 'count(*)')} AS rate_text,
       {Q.fmt_short('sum(passed)', 'count(*)')} AS short_text
FROM runs GROUP BY model, mode""", RUNS))
def q_format_rate(spark, d):
    g = V.runs(spark, d).groupBy("model", "mode").agg(F.sum("passed").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("model", "mode", R.format_rate("k", "n").alias("rate_text"),
                    R.format_rate_short("k", "n").alias("short_text"))


@query("unformat_rate", ops=("P18",), sql=W(f"""
SELECT model, mode,
       coalesce(TRY_CAST(regexp_extract(t, '\\((\\d+)/(\\d+)\\)', 1) AS BIGINT), 0) AS passed_back,
       coalesce(TRY_CAST(regexp_extract(t, '\\((\\d+)/(\\d+)\\)', 2) AS BIGINT), 0) AS total_back
FROM (SELECT model, mode, {Q.fmt_rate('sum(passed)', 'count(*)')} AS t FROM runs GROUP BY model, mode)""", RUNS))
def q_unformat_rate(spark, d):
    g = V.runs(spark, d).groupBy("model", "mode").agg(F.sum("passed").alias("k"), F.count(F.lit(1)).alias("n"))
    t = g.select("model", "mode", R.format_rate("k", "n").alias("t"))
    return t.select("model", "mode", R.unformat_rate("t").alias("u")).select(
        "model", "mode", F.col("u.passed").alias("passed_back"), F.col("u.total").alias("total_back"))


# ---------------------------------------------------------------- A1 / A2
STATUS_SQL = """
status AS (
  SELECT doc_id, model, list_transform(range(1, n_tests + 1), lambda i:
           CASE WHEN i <= k_passed THEN 'Success: Final output matches the expected results.'
                ELSE 'Failure: Final output does not match.' END) AS results
  FROM runs)"""


def status_lists(spark, d):
    r = V.runs(spark, d)
    res = F.transform(F.sequence(F.lit(1), F.col("n_tests")), lambda i: F.when(
        i <= F.col("k_passed"), F.lit("Success: Final output matches the expected results."))
        .otherwise(F.lit("Failure: Final output does not match.")))
    return r.select("doc_id", "model", res.alias("results"))


@query("pass_ratio_from_results", ops=("A1",), sql=W("""
SELECT doc_id, CAST(len(list_filter(results, lambda x: starts_with(x, 'Success'))) AS VARCHAR) || '/' ||
       CAST(len(results) AS VARCHAR) AS pass_ratio_text
FROM status""", RUNS, STATUS_SQL))
def q_pass_ratio_from_results(spark, d):
    return status_lists(spark, d).select("doc_id", R.pass_ratio_from_results("results").alias("pass_ratio_text"))


@query("pass_rate_check", ops=("A2",), sql=W(f"""
SELECT model, count(ratio) AS n_total, count_if(ratio = 1.0) AS n_pass,
       printf('%.2f%%', {Q.rate('count_if(ratio = 1.0)', 'count(ratio)')} * 100) AS pct
FROM scored GROUP BY model""", RUNS, SCORED_SQL))
def q_rate_check(spark, d):
    return A.rate_check(V.runs(spark, d), "pass_ratio", by=["model"])


# ---------------------------------------------------------------- A3 / A4
HW_SQL = """
hw AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(label, ' ')) AS w FROM horizon_long))"""

RANGE_CASE = ("CASE WHEN w = 'Short-Range' THEN 1 WHEN w = 'Medium-Range' THEN 2 "
              "WHEN w = 'Long-Range' THEN 3 END")
RANK_TO_LABEL = "CASE {x} WHEN 1 THEN 'Short-Range' WHEN 2 THEN 'Medium-Range' WHEN 3 THEN 'Long-Range' END"

# boolean presence of horizon labels with use_max: non-range words + the row's max range
HPRES_SQL = f"""
hpres AS (
  SELECT doc_id, w AS label, CAST(1 AS BIGINT) AS w FROM hw
  WHERE w NOT IN ('Short-Range', 'Medium-Range', 'Long-Range')
  UNION ALL
  SELECT doc_id, {RANK_TO_LABEL.format(x='max(' + RANGE_CASE + ')')} AS label, CAST(1 AS BIGINT) AS w
  FROM hw WHERE w IN ('Short-Range', 'Medium-Range', 'Long-Range') GROUP BY doc_id)"""

# weighted: word weight = sum of counts of keys holding it; max range weight = row total
HWPRES_SQL = f"""
hwpres AS (
  SELECT doc_id, w AS label, CAST(sum(freq) AS BIGINT) AS w
  FROM (SELECT DISTINCT doc_id, label AS k, freq, unnest(string_split(label, ' ')) AS w FROM horizon_long)
  WHERE w NOT IN ('Short-Range', 'Medium-Range', 'Long-Range') GROUP BY doc_id, w
  UNION ALL
  SELECT h.doc_id, {RANK_TO_LABEL.format(x='m.top')} AS label, CAST(sum(h.freq) AS BIGINT) AS w
  FROM horizon_long h JOIN (SELECT doc_id, max({RANGE_CASE}) AS top FROM hw GROUP BY doc_id) m
    ON m.doc_id = h.doc_id WHERE m.top IS NOT NULL GROUP BY h.doc_id, m.top)"""


def _label_rate_sql(pres: str, labels, extra_ctes=()):
    return W(f"""
SELECT v.label, CAST(coalesce(sum(CASE WHEN s.is_pass THEN p.w ELSE 0 END), 0) AS BIGINT) AS n_pass,
       CAST(coalesce(sum(p.w), 0) AS BIGINT) AS n_total
FROM ({Q.values([(x,) for x in labels])}) v(label)
LEFT JOIN ({pres}) p ON p.label = v.label
LEFT JOIN scored s ON s.doc_id = p.doc_id
GROUP BY v.label""", RUNS, SCORED_SQL, V.REASON_LONG_SQL, V.HORIZON_LONG_SQL, *extra_ctes)


@query("label_pass_rate_reason", ops=("A3",), sql=_label_rate_sql(
    "SELECT doc_id, label, CAST(1 AS BIGINT) AS w FROM reason_long", REASON_LABELS))
def q_label_rate_reason(spark, d):
    return A.label_pass_rate(scored(spark, d), "reason_freq", "reason", REASON_LABELS)


@query("label_pass_rate_horizon", ops=("A3", "W2"), sql=_label_rate_sql(
    "SELECT * FROM hpres", HORIZON_LABELS, (HW_SQL, HPRES_SQL)))
def q_label_rate_horizon(spark, d):
    return A.label_pass_rate(scored(spark, d), "horizon_freq", "horizon", HORIZON_LABELS, use_max=True)


@query("weighted_label_pass_rate", ops=("A4",), sql=_label_rate_sql(
    "SELECT * FROM hwpres", HORIZON_LABELS, (HW_SQL, HWPRES_SQL)))
def q_weighted_rate(spark, d):
    return A.label_pass_rate(scored(spark, d), "horizon_freq", "horizon", HORIZON_LABELS,
                             use_max=True, weighted=True)


@query("weighted_label_pass_rate_reason", ops=("A4",), sql=_label_rate_sql(
    "SELECT doc_id, label, CAST(freq AS BIGINT) AS w FROM reason_long", REASON_LABELS))
def q_weighted_rate_reason(spark, d):
    return A.label_pass_rate(scored(spark, d), "reason_freq", "reason", REASON_LABELS, weighted=True)


# ---------------------------------------------------------------- W2
@query("max_range_label", ops=("W2",), sql=W(f"""
SELECT r.doc_id, {RANK_TO_LABEL.format(x='m.top')} AS max_range
FROM runs r LEFT JOIN (SELECT doc_id, max({RANGE_CASE}) AS top FROM hw GROUP BY doc_id) m ON m.doc_id = r.doc_id
""", RUNS, V.HORIZON_LONG_SQL, HW_SQL))
def q_max_range(spark, d):
    return V.runs(spark, d).select("doc_id", A.max_range_label("horizon_freq").alias("max_range"))


# ---------------------------------------------------------------- A5 / A7
def _pivot_sql(group_cols: list[str], pres: str, labels, prefix: str, fmt) -> str:
    """Conditional-aggregation pivot: one text column per label."""
    def cond(lbl, passing):
        extra = " AND s.is_pass" if passing else ""
        return f"sum(CASE WHEN p.label = '{lbl}'{extra} THEN p.w ELSE 0 END)"
    cols = ",\n  ".join(f"{fmt(cond(lbl, True), cond(lbl, False))} AS {prefix}{A.label_col(lbl)}"
                        for lbl in labels)
    gs = ", ".join(f"s.{c}" for c in group_cols)
    return f"""SELECT {gs}, {cols}
FROM scored s LEFT JOIN ({pres}) p ON p.doc_id = s.doc_id
GROUP BY {gs}"""


def _run_summary_sql():
    reason = _pivot_sql(["run_name"], "SELECT doc_id, label, CAST(1 AS BIGINT) AS w FROM reason_long",
                        REASON_LABELS, "r_", Q.fmt_rate)
    horizon = _pivot_sql(["run_name"], "SELECT * FROM hpres", HORIZON_LABELS, "h_", Q.fmt_rate)
    rcols = ", ".join(f"a.r_{A.label_col(x)}" for x in REASON_LABELS)
    hcols = ", ".join(f"b.h_{A.label_col(x)}" for x in HORIZON_LABELS)
    body = f"""
SELECT o.run_name, {Q.run_name_group('o.run_name', 1)} AS model, {Q.run_name_group('o.run_name', 2)} AS mode,
       {Q.run_name_group('o.run_name', 3)} AS task, {Q.run_name_group('o.run_name', 4)} AS stamp,
       o.all_pass, {rcols}, {hcols}
FROM (SELECT run_name, {Q.fmt_rate('count_if(is_pass)', 'count(*)')} AS all_pass FROM scored GROUP BY run_name) o
JOIN ({reason}) a ON a.run_name = o.run_name
JOIN ({horizon}) b ON b.run_name = o.run_name"""
    return W(body, RUNS, SCORED_SQL, V.REASON_LONG_SQL, V.HORIZON_LONG_SQL, HW_SQL, HPRES_SQL)


@query("run_summary", ops=("A5",), sql=_run_summary_sql())
def q_run_summary(spark, d):
    return A.run_summary(scored(spark, d))


def _strat_sql():
    reason = _pivot_sql(["model", "mode"], "SELECT doc_id, label, CAST(1 AS BIGINT) AS w FROM reason_long",
                        REASON_LABELS, "", Q.fmt_short)
    return W(reason, RUNS, SCORED_SQL, V.REASON_LONG_SQL)


@query("stratified_leaderboard", ops=("A7",), sql=_strat_sql())
def q_stratified(spark, d):
    return A.stratified_leaderboard(scored(spark, d), ["model", "mode"], "reason_freq", "reason", REASON_LABELS)


def _strat_h_sql():
    horizon = _pivot_sql(["model", "mode"], "SELECT * FROM hpres", HORIZON_LABELS, "", Q.fmt_short)
    return W(horizon, RUNS, SCORED_SQL, V.HORIZON_LONG_SQL, HW_SQL, HPRES_SQL)


@query("stratified_leaderboard_horizon", ops=("A7",), sql=_strat_h_sql())
def q_stratified_h(spark, d):
    return A.stratified_leaderboard(scored(spark, d), ["model", "mode"], "horizon_freq", "horizon", HORIZON_LABELS)


# ---------------------------------------------------------------- A16 / U1 / U2
@query("group_row_counts", ops=("A16",), sql=W(
    "SELECT model, mode, count(*) AS n_rows FROM runs GROUP BY model, mode", RUNS))
def q_group_counts(spark, d):
    return A.group_counts(V.runs(spark, d), ["model", "mode"])


@query("union_runs", ops=("U1",), sql="""
SELECT doc_id, source, lang, NULL::BIGINT AS n_chars FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, source, lang, n_chars FROM documents WHERE lang <> 'en'""")
def q_union_runs(spark, d):
    docs = table(spark, d, "documents")
    a = docs.filter(F.col("lang") == "en").select("doc_id", "source", "lang")
    b = docs.filter(F.col("lang") != "en").select("doc_id", "source", "lang", "n_chars")
    return union_runs([a, b])


@query("keyed_union", ops=("U2",), sql=W("""
SELECT 'quality' AS outcome, model, CAST(sum(passed) AS BIGINT) AS n_pass, count(*) AS n_total FROM runs GROUP BY model
UNION ALL
SELECT 'toxic' AS outcome, model, CAST(sum(toxic) AS BIGINT) AS n_pass, count(*) AS n_total FROM runs GROUP BY model""", RUNS))
def q_keyed_union(spark, d):
    r = V.runs(spark, d)
    a = A.leaderboard(r, by=["model"], passed="passed").select("model", "n_pass", "n_total")
    b = A.leaderboard(r, by=["model"], passed="toxic").select("model", "n_pass", "n_total")
    return keyed_union({"quality": a, "toxic": b}, key="outcome")


# ---------------------------------------------------------------- §2.9 SQL-callable functions
@query("sql_callable_functions", ops=("P4", "P5", "A10"), sql=W(f"""
SELECT model, CAST(count(*) AS BIGINT) AS n, CAST(count_if(is_pass) AS BIGINT) AS k,
       round({Q.rate('count_if(is_pass)', 'count(*)')}, 6) AS rate,
       round({Q.err('count_if(is_pass)', 'count(*)')}, 6) AS err95,
       round(sum(ratio), 6) AS ratio_sum
FROM scored GROUP BY model""", RUNS, SCORED_SQL))
def q_sql_functions(spark, d):
    from evalspark.functions.sql_functions import register_sql_functions
    register_sql_functions(spark)
    V.runs(spark, d).select("doc_id", "model", "pass_ratio").createOrReplaceTempView("evalspark_runs")
    return spark.sql("""
        SELECT model, n, k, round(pass_rate(k, n), 6) AS rate, round(error_bar(k, n), 6) AS err95, ratio_sum
        FROM (SELECT model, count(*) AS n, count_if(is_pass(pass_ratio)) AS k,
                     round(sum(parse_ratio(pass_ratio)), 6) AS ratio_sum
              FROM evalspark_runs GROUP BY model)""")
