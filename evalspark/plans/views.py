"""Canonical views over the driver tables.

The evaluation operators work on run results, dependency records, source
lines and dialogs. The driver tables are bound to those shapes here, once,
as deterministic projections; every view exists twice -- as a DataFrame
builder and as the equivalent SQL text used inside the DuckDB oracles.

* ``runs``     documents JOIN labels: one row per (run, task row)
* ``lines``    documents split into numbered lines
* ``lags``     lineitem JOIN orders: a use line, a definition line, a scope
* ``sessions`` events as numbered steps per user
* ``turns``    conversations as before / between / after triples
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.functions.constants import (
    HORIZON_RANGES, HORIZON_TYPES, REASON_LABELS)
from evalspark.plans.sqlfrag import values as _values
from evalspark.session import table

# Generation modes attached to the languages of ``documents`` when a run file
# name is built; ``es`` maps to a mode the name pattern does not know, so the
# name parser's no-match path is exercised too.
LANG_MODE = [("en", "with_afterlines"), ("fr", "no_afterlines"),
             ("de", "no_instruction"), ("es", "few_shot")]

EPOCH = "1992-01-01"
SCOPE_OF_FLAG = [("A", "local"), ("N", "function"), ("R", "library")]


# ---------------------------------------------------------------- runs
# The label maps are written as one SQL expression each (parsed once in the
# JVM) instead of hundreds of Python-side Column calls.
def _reason_count(k: int) -> str:
    return f"CASE WHEN (doc_id * 7 + n_chars + {k * 13}) % 5 = 0 THEN 1 + (n_chars + {k}) % 4 ELSE 0 END"


def _horizon_count(t: int, r: int) -> str:
    return f"CASE WHEN (doc_id * 3 + n_chars * {t + 1} + {r * 11}) % 7 < 2 THEN 1 + (doc_id + {t + r}) % 3 ELSE 0 END"


def _loop_count(r: int) -> str:
    return f"CASE WHEN (doc_id + {r}) % 9 = 0 THEN 1 ELSE 0 END"


def _freq_map(entries: list[tuple[str, str]]) -> Column:
    arr = ", ".join(f"named_struct('key', '{k}', 'value', CAST({c} AS INT))" for k, c in entries)
    return F.expr(f"map_from_entries(filter(array({arr}), e -> e.value > 0))")


def horizon_entries() -> list[tuple[str, str]]:
    out = []
    for t, typ in enumerate(HORIZON_TYPES):
        for r, rng in enumerate(HORIZON_RANGES):
            out.append((f"{typ} {rng}", _horizon_count(t, r)))
    for r, rng in enumerate(HORIZON_RANGES):
        out.append((f"Variable Loop {rng}", _loop_count(r)))
    return out


def runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels")
    mode_of = "CASE lang " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LANG_MODE) + " END"
    n_tests = "CAST(1 + doc_id % 3 AS INT)"
    k_passed = f"CAST(CASE WHEN quality = 1 THEN {n_tests} ELSE doc_id % {n_tests} END AS INT)"
    # one stamp per task: a run is (model, mode, task, stamp)
    t = "CAST(doc_id % 15 AS INT)"
    stamp = f"format_string('%02d_%02d_%02d_%02d', {t} % 12 + 1, {t} + 1, {t} % 24, ({t} * 4) % 60)"
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("source").alias("model"),
        F.col("lang").alias("mode"),
        F.expr(f"concat('task_', CAST({t} AS STRING))").alias("code_task"),
        F.col("quality").alias("passed"),
        F.col("toxic"),
        F.expr(n_tests).alias("n_tests"),
        F.expr(k_passed).alias("k_passed"),
        F.expr(f"""CASE WHEN doc_id % 20 = 7 THEN '0/0'
                        WHEN doc_id % 20 = 11 THEN CAST(CAST(quality AS DOUBLE) AS STRING)
                        WHEN doc_id % 20 = 13 THEN 'abc'
                        ELSE concat(CAST({k_passed} AS STRING), '/', CAST({n_tests} AS STRING)) END""").alias("pass_ratio"),
        F.expr(stamp).alias("stamp"),
        F.expr(f"concat_ws('_', source, {mode_of}, concat('Task_', CAST({t} AS STRING)), {stamp})").alias("run_name"),
        F.col("n_chars"),
        _freq_map([(lbl, _reason_count(k)) for k, lbl in enumerate(REASON_LABELS)]).alias("reason_freq"),
        _freq_map(horizon_entries()).alias("horizon_freq"),
    )




RUNS_SQL = f"""
runs AS (
  SELECT d.doc_id, d.source AS model, d.lang AS mode,
         'task_' || CAST(d.doc_id % 15 AS VARCHAR) AS code_task,
         l.quality AS passed, l.toxic AS toxic,
         CAST(1 + d.doc_id % 3 AS INTEGER) AS n_tests,
         CAST(CASE WHEN l.quality = 1 THEN 1 + d.doc_id % 3 ELSE d.doc_id % (1 + d.doc_id % 3) END AS INTEGER) AS k_passed,
         CASE WHEN d.doc_id % 20 = 7 THEN '0/0'
              WHEN d.doc_id % 20 = 11 THEN CASE WHEN l.quality = 1 THEN '1.0' ELSE '0.0' END
              WHEN d.doc_id % 20 = 13 THEN 'abc'
              ELSE CAST(CASE WHEN l.quality = 1 THEN 1 + d.doc_id % 3 ELSE d.doc_id % (1 + d.doc_id % 3) END AS VARCHAR)
                   || '/' || CAST(1 + d.doc_id % 3 AS VARCHAR) END AS pass_ratio,
         printf('%02d_%02d_%02d_%02d', d.doc_id % 15 % 12 + 1, d.doc_id % 15 + 1, d.doc_id % 15 % 24, (d.doc_id % 15 * 4) % 60) AS stamp,
         d.source || '_' || m.gen_mode || '_Task_' || CAST(d.doc_id % 15 AS VARCHAR) || '_' ||
           printf('%02d_%02d_%02d_%02d', d.doc_id % 15 % 12 + 1, d.doc_id % 15 + 1, d.doc_id % 15 % 24, (d.doc_id % 15 * 4) % 60) AS run_name,
         d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  JOIN ({_values(LANG_MODE)}) m(lang, gen_mode) ON m.lang = d.lang
)"""

# Long form of the label maps: (doc_id, label, freq), one row per map entry.
REASON_LONG_SQL = f"""
reason_long AS (
  SELECT r.doc_id, v.label, CAST(1 + (r.n_chars + v.k) % 4 AS INTEGER) AS freq, v.k AS pos
  FROM runs r, ({_values([(lbl, k) for k, lbl in enumerate(REASON_LABELS)])}) v(label, k)
  WHERE (r.doc_id * 7 + r.n_chars + v.k * 13) % 5 = 0
)"""

HORIZON_LONG_SQL = f"""
horizon_long AS (
  SELECT r.doc_id, v.typ || ' ' || v.rng AS label, CAST(1 + (r.doc_id + v.t + v.r) % 3 AS INTEGER) AS freq,
         v.t * 3 + v.r AS pos
  FROM runs r, ({_values([(typ, t, rng, ri) for t, typ in enumerate(HORIZON_TYPES) for ri, rng in enumerate(HORIZON_RANGES)])}) v(typ, t, rng, r)
  WHERE (r.doc_id * 3 + r.n_chars * (v.t + 1) + v.r * 11) % 7 < 2
  UNION ALL
  SELECT r.doc_id, 'Variable Loop ' || v.rng AS label, 1 AS freq, 18 + v.r AS pos
  FROM runs r, ({_values([(rng, ri) for ri, rng in enumerate(HORIZON_RANGES)])}) v(rng, r)
  WHERE (r.doc_id + v.r) % 9 = 0
)"""


# ---------------------------------------------------------------- lines
def lines(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    docs = docs if docs is not None else table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


LINES_SQL = """
lines AS (
  SELECT doc_id, CAST(generate_subscripts(arr, 1) AS INTEGER) AS line_no, unnest(arr) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents)
)"""


# ---------------------------------------------------------------- lags
def lags(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    od = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    scope = F.create_map(*[F.lit(x) for kv in SCOPE_OF_FLAG for x in kv])
    use = F.datediff(F.col("l_shipdate"), F.lit(EPOCH))
    dfn = F.datediff(F.col("o_orderdate"), F.lit(EPOCH))
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity",
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"),
        use.alias("usage_line"), dfn.alias("def_line"),
        F.abs(use - dfn).alias("abs_diff"),
        scope[F.col("l_returnflag")].alias("scope_type"),
        (F.col("o_orderstatus") == "F").alias("passed"),
    )


LAGS_SQL = f"""
lags AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity,
         'p' || CAST(l_partkey AS VARCHAR) AS name,
         CAST(date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) AS INTEGER) AS usage_line,
         CAST(date_diff('day', DATE '{EPOCH}', CAST(o_orderdate AS DATE)) AS INTEGER) AS def_line,
         CAST(abs(date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE))
                - date_diff('day', DATE '{EPOCH}', CAST(o_orderdate AS DATE))) AS INTEGER) AS abs_diff,
         s.scope_type,
         o_orderstatus = 'F' AS passed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN ({_values(SCOPE_OF_FLAG)}) s(flag, scope_type) ON s.flag = l_returnflag
)"""


# ---------------------------------------------------------------- sessions
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events as numbered steps per user. The step number is a running count
    computed per (user, day) with a carry of earlier days' counts, so one very
    active user is spread over its days instead of one task."""
    from evalspark.functions.time import day_bucket
    from evalspark.operators.vectors import running_sum
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    day = day_bucket(ev, "ts")
    c = running_sum(ev.withColumn("_one", F.lit(1).cast("long")), "user_id", ["ts", "event_id"], "_one", day, "_n")
    return c.select("user_id", "event_id", "ts", "event_type", "value",
                    (F.col("_n") - 1).cast("int").alias("step"),
                    (F.col("event_type") == "purchase").alias("success"))


SESSIONS_SQL = """
sessions AS (
  SELECT user_id, event_id, ts, event_type, value,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step,
         event_type = 'purchase' AS success
  FROM events
)"""


# ---------------------------------------------------------------- turns
def turns(spark: SparkSession, d: str) -> DataFrame:
    cv = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return cv.select("conv_id", "turn", "role",
                     F.lag("text").over(w).alias("before"),
                     F.col("text").alias("between"),
                     F.lead("text").over(w).alias("after")).filter(F.col("role") == "assistant")


TURNS_SQL = """
turns AS (
  SELECT * FROM (
    SELECT conv_id, turn, role,
           lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS "before",
           text AS "between",
           lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS "after"
    FROM conversations) t
  WHERE role = 'assistant'
)"""


def with_views(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
