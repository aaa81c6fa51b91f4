"""Table surgery, I/O round trips, label filters and renames (build-plan steps 4-5)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions import labels as L
from evalspark.functions.text import select_step
from evalspark.functions.constants import POST_STEPS, REASON_LABELS, REASON_PATTERN_LABELS
from evalspark.operators import rates as A
from evalspark.operators import tables as TB
from evalspark.plans import sqlfrag as Q
from evalspark.plans import views as V
from evalspark.plans.q_core import RUNS, SCORED_SQL, W, _pivot_sql, scored
from evalspark.plans.registry import query
from evalspark.session import table
from evalspark.sources import io

HW_SQL = """
hw AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(label, ' ')) AS w FROM horizon_long))"""


# ---------------------------------------------------------------- S1 + K1 / S8 / S9 / W9
RUN_CSV_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("code_task", T.StringType()),
                               T.StructField("passed", T.IntegerType()), T.StructField("pass_ratio", T.StringType())])


@query("scan_runs", ops=("S1", "K1"), sql=W(f"""
SELECT doc_id, {Q.run_name_group('run_name', 1)} AS model, {Q.run_name_group('run_name', 2)} AS mode,
       {Q.run_name_group('run_name', 3)} AS task, {Q.run_name_group('run_name', 4)} AS stamp, passed, pass_ratio
FROM runs""", RUNS))
def q_scan_runs(spark, d):
    path = io.scratch_path(spark, "runs-csv")
    io.write_run_files(V.runs(spark, d).select("doc_id", "code_task", "passed", "pass_ratio", "run_name"), path)
    df = io.scan_runs(spark, path, RUN_CSV_SCHEMA)
    return df.select("doc_id", "model", "mode", "task", "stamp", "passed", "pass_ratio")


@query("scan_single_or_folder", ops=("S2",), sql=W("""
SELECT doc_id, code_task, passed, pass_ratio, 'single_file' AS "group" FROM runs
UNION ALL SELECT doc_id, code_task, passed, pass_ratio, NULL AS "group" FROM runs""", RUNS))
def q_scan_single(spark, d):
    """The same rows as one file and as a folder of files."""
    runs = V.runs(spark, d).select("doc_id", "code_task", "passed", "pass_ratio", "run_name")
    one, many = io.scratch_path(spark, "runs-one"), io.scratch_path(spark, "runs-many")
    runs.drop("run_name").coalesce(1).write.option("header", True).option("escape", '"').csv(one)
    io.write_run_files(runs, many)
    file = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(one).select("path").first()
    paths = ([file["path"]] if file else []) + [many]
    return io.union_scans(spark, paths, RUN_CSV_SCHEMA).select("doc_id", "code_task", "passed", "pass_ratio", "group")


DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                           T.StructField("n_chars", T.LongType())])


@query("scan_dataset_parquet", ops=("S8",), sql="SELECT doc_id, lang, n_chars FROM documents")
def q_scan_dataset(spark, d):
    return io.scan_dataset(spark, f"{d}/documents.parquet", DOC_SCHEMA)


@query("prune_runs", ops=("S9",), sql=W(
    "SELECT doc_id, model, mode, passed FROM runs WHERE model = 'src3' AND mode = 'en'", RUNS))
def q_prune_runs(spark, d):
    path = io.scratch_path(spark, "runs-parquet")
    io.write_runs(V.runs(spark, d).select("doc_id", "model", "mode", "passed"), path)
    df = spark.read.parquet(path)
    return df.filter((F.col("model") == "src3") & (F.col("mode") == "en")).select("doc_id", "model", "mode", "passed")


LANGUAGE_OF = {"en": "Python", "de": "Java"}


@query("scan_task_catalogue", ops=("S5",), sql=W("""
SELECT language, task, base_path, CASE lower(language) WHEN 'python' THEN '.py' WHEN 'java' THEN '.java' END AS extension,
       base_path || '/' || task || '.json' AS test_path
FROM (SELECT DISTINCT CASE mode WHEN 'en' THEN 'Python' WHEN 'de' THEN 'Java' ELSE mode END AS language, code_task AS task,
             '/tasks/' || mode AS base_path FROM runs)""", RUNS))
def q_scan_catalogue(spark, d):
    r = V.runs(spark, d)
    language = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])[F.col("mode")], F.col("mode"))
    tasks = r.select(language.alias("language"), F.col("code_task").alias("task"), F.concat(F.lit("/tasks/"), "mode").alias("base")).distinct()
    # one JSON document: languages and their tasks
    by = tasks.groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("task", "base"))).alias("tasks"))
    one = by.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("language", "tasks")))).alias("value"))
    path = io.scratch_path(spark, "catalogue")
    one.write.text(path)
    return io.scan_catalogue(spark, path)


@query("scan_json_dir", ops=("S7",), sql="""
SELECT source AS key, count(*) AS n_docs, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source""")
def q_scan_json_dir(spark, d):
    path = io.scratch_path(spark, "json-dir")
    g = table(spark, d, "documents").groupBy(F.col("source").alias("key")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sort_array(F.collect_set("lang")).alias("langs"))
    g.write.partitionBy("key").json(path)
    back = io.scan_json_dir(spark, path, "n_docs long, langs array<string>, key string")
    return back.select("key", "n_docs", F.array_join("langs", ",").alias("langs"))


@query("split_by_key", ops=("W9",), sql=W("SELECT mode, count(*) AS n_rows FROM runs GROUP BY mode", RUNS))
def q_split_by(spark, d):
    path = io.scratch_path(spark, "split")
    TB.split_by(V.runs(spark, d).select("doc_id", "mode"), "mode", path)
    return spark.read.parquet(path).groupBy("mode").agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- S6 / K4 (events.props)
def _cases_map(spark, d):
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    n = 1 + k % 3
    idx = F.filter(F.sequence(F.lit(1), n), lambda i: ~((k % 7 == 0) & (i == 2)))
    ent = F.flatten(F.transform(idx, lambda i: F.array(
        F.struct(F.concat(F.lit("test_case"), i.cast("string")).alias("key"),
                 F.concat(F.col("event_type"), i.cast("string")).alias("value")),
        F.struct(F.concat(F.lit("expected_output"), i.cast("string")).alias("key"),
                 F.concat(F.col("user_id").cast("string"), F.lit(":"), i.cast("string")).alias("value")))))
    return ev.select("event_id", F.map_from_entries(ent).alias("cases"))


@query("scan_test_cases", ops=("S6",), sql="""
SELECT event_id, CAST(i AS INTEGER) AS idx, event_type || CAST(i AS VARCHAR) AS test_case,
       CAST(user_id AS VARCHAR) || ':' || CAST(i AS VARCHAR) AS expected
FROM (SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
             unnest(range(1, 2 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 3)) AS i FROM events)
WHERE NOT (k % 7 = 0 AND i >= 2)""")
def q_scan_test_cases(spark, d):
    return io.test_case_pairs(_cases_map(spark, d), "event_id", "cases")


@query("write_expected_output", ops=("K4",), sql="""
SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","expected_output1":"' || event_type
       || '","test_case1":""}' AS json_text
FROM events""")
def q_add_expected(spark, d):
    ev = table(spark, d, "events")
    m = F.from_json("props", "map<string,string>")
    return ev.select("event_id", F.to_json(io.add_expected(m, "expected_output1", F.col("event_type"))).alias("json_text"))


# ---------------------------------------------------------------- K2 / K3
@query("write_grouped_report", ops=("K2",), sql=W("""
SELECT model, mode, CAST(sum(passed) AS BIGINT) AS n_pass, count(*) AS n_total FROM runs GROUP BY model, mode
UNION ALL SELECT DISTINCT model, NULL, NULL, NULL FROM runs""", RUNS))
def q_grouped_report(spark, d):
    lb = A.leaderboard(V.runs(spark, d)).select("model", "mode", "n_pass", "n_total")
    return io.grouped_report(lb, "model", ["mode"])


NOW = "12_31_23_59"


@query("restamp_output", ops=("K3",), sql=W(f"""
SELECT doc_id, array_to_string(string_split(run_name, '_')[1:greatest(len(string_split(run_name, '_')) - 4, 0)]
       || string_split('{NOW}', '_'), '_') AS out_name FROM runs""", RUNS))
def q_restamp(spark, d):
    return V.runs(spark, d).select("doc_id", io.output_name("run_name", NOW).alias("out_name"))


# ---------------------------------------------------------------- P6 / P8
@query("drop_incomplete", ops=("P6",), sql="""
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL""")
def q_drop_incomplete(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    j = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    kept, _report = TB.drop_incomplete(j, ["quality"])
    return kept


@query("drop_inverted_ranges", ops=("P8",), sql="""
SELECT l_orderkey, l_linenumber, l_suppkey AS start_line, l_partkey AS end_line FROM lineitem
WHERE NOT (l_suppkey > l_partkey)""")
def q_valid_ranges(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("start_line"),
                                            F.col("l_partkey").alias("end_line"))
    return TB.valid_ranges(li)


# ---------------------------------------------------------------- P7
@query("filter_by_label", ops=("P7",), sql=W("""
SELECT doc_id, model FROM runs WHERE doc_id IN (SELECT doc_id FROM reason_long WHERE label = 'If Body')""",
                                              RUNS, V.REASON_LONG_SQL))
def q_filter_label(spark, d):
    r = V.runs(spark, d)
    return r.filter(L.has_label("reason_freq", "If Body", "reason")).select("doc_id", "model")


@query("filter_by_label_horizon", ops=("P7",), sql=W("""
SELECT doc_id, model,
       doc_id IN (SELECT doc_id FROM hw WHERE w = 'Function') AS has_function,
       doc_id IN (SELECT doc_id FROM hw GROUP BY doc_id HAVING max(CASE w WHEN 'Short-Range' THEN 1
                  WHEN 'Medium-Range' THEN 2 WHEN 'Long-Range' THEN 3 END) = 3) AS max_long
FROM runs""", RUNS, V.HORIZON_LONG_SQL, HW_SQL))
def q_filter_label_h(spark, d):
    r = V.runs(spark, d)
    return r.select("doc_id", "model", L.has_label("horizon_freq", "Function", "horizon").alias("has_function"),
                    L.has_label("horizon_freq", "Long-Range", "horizon", use_max=True).alias("max_long"))


# ---------------------------------------------------------------- P9
@query("drop_constant_columns", ops=("P9",), sql=W(_pivot_sql(
    ["model", "mode"], "SELECT doc_id, label, CAST(1 AS BIGINT) AS w FROM reason_long",
    [x for x in REASON_PATTERN_LABELS if x in REASON_LABELS], "", Q.fmt_short), RUNS, SCORED_SQL, V.REASON_LONG_SQL))
def q_drop_constant(spark, d):
    wide = A.stratified_leaderboard(scored(spark, d), ["model", "mode"], "reason_freq", "reason",
                                    REASON_PATTERN_LABELS)
    return A.drop_constant_columns(wide, "0.0 ± 0.0", keep=["model", "mode"])


# ---------------------------------------------------------------- P10
def _gen_code(spark, d):
    t = V.turns(spark, d)
    return t.select("conv_id", "turn", F.struct(
        F.coalesce("between", F.lit("")).alias("original_code"),
        F.when(F.col("turn") % 2 == 1, F.trim("between")).otherwise(F.lit("")).alias("cleaned_code"),
        F.coalesce("after", F.lit("")).alias("trimmed_code"),
        F.lit("").alias("indented_code")).alias("gen"))


@query("select_last_step", ops=("P10",), sql=W("""
SELECT conv_id, turn,
  CASE WHEN coalesce("after", '') <> '' THEN 'trimmed_code'
       WHEN turn % 2 = 1 AND trim("between") <> '' THEN 'cleaned_code'
       WHEN coalesce("between", '') <> '' THEN 'original_code' ELSE '' END AS step_default,
  CASE WHEN turn % 2 = 1 AND trim("between") <> '' THEN 'cleaned_code' ELSE '' END AS step_given,
  CAST(length(CASE WHEN turn % 2 = 1 AND trim("between") <> '' THEN trim("between") ELSE '' END) AS INTEGER) AS len_given
FROM turns""", V.TURNS_SQL))
def q_select_step(spark, d):
    g = _gen_code(spark, d)
    return g.select("conv_id", "turn", select_step("gen").alias("a"), select_step("gen", ["cleaned_code"]).alias("b")) \
        .select("conv_id", "turn", F.col("a.step").alias("step_default"), F.col("b.step").alias("step_given"),
                F.length("b.code").alias("len_given"))


# ---------------------------------------------------------------- P14
KNOWN_CLASSES = ["fr"]
KNOWN_PACKAGES = ["com.example.th", "net.example.m"]


def _import_path_sql():
    host = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
    seg = "regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1)"
    rev = f"array_to_string(list_reverse(string_split({host}, '.')), '.')"
    return f"(CASE WHEN page_id % 5 = 0 THEN {rev} || '.*' ELSE {rev} || '.' || {seg} END)"


@query("skip_known_libraries", ops=("P14",), sql=f"""
SELECT page_id, import_path,
  NOT (import_path IN ('fr') OR ends_with(import_path, '.fr')
       OR starts_with(import_path, 'com.example.th') OR starts_with(import_path, 'net.example.m')
       OR (ends_with(import_path, '*') AND (starts_with(rtrim(import_path, '*'), 'com.example.th')
                                           OR starts_with(rtrim(import_path, '*'), 'net.example.m')))) AS report
FROM (SELECT page_id, {_import_path_sql()} AS import_path FROM pages)""")
def q_report_library(spark, d):
    p = table(spark, d, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    seg = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1)
    rev = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    path = F.when(F.col("page_id") % 5 == 0, F.concat(rev, F.lit(".*"))).otherwise(F.concat_ws(".", rev, seg))
    return p.select("page_id", path.alias("import_path")).select(
        "page_id", "import_path", L.report_library("import_path", KNOWN_CLASSES, KNOWN_PACKAGES).alias("report"))


# ---------------------------------------------------------------- P19 / P20
RENAME = {"If Condition": "If", "If Body": "If", "Elif Condition": "Elif", "Elif Body": "Elif"}
FIRST_WORD = {"Global_Variable": "Variable", "Interface": "Class"}


@query("rename_labels", ops=("P19",), sql=W(f"""
SELECT doc_id, label, freq FROM (
  SELECT doc_id, coalesce(m.new, r.label) AS label, freq,
         row_number() OVER (PARTITION BY doc_id, coalesce(m.new, r.label) ORDER BY pos DESC) AS rn
  FROM reason_long r LEFT JOIN ({Q.values(RENAME.items())}) m(old, new) ON m.old = r.label)
WHERE rn = 1""", RUNS, V.REASON_LONG_SQL))
def q_rename_labels(spark, d):
    r = V.runs(spark, d).select("doc_id", L.rename_labels("reason_freq", RENAME).alias("m"))
    return r.select("doc_id", F.explode("m").alias("label", "freq"))


@query("rename_first_word", ops=("P20",), sql=W(f"""
SELECT doc_id, label, freq FROM (
  SELECT doc_id, label, freq, row_number() OVER (PARTITION BY doc_id, label ORDER BY pos DESC) AS rn
  FROM (SELECT doc_id, coalesce(m.new, split_part(h.label, ' ', 1)) ||
               substr(h.label, length(split_part(h.label, ' ', 1)) + 1) AS label, freq, pos
        FROM horizon_long h LEFT JOIN ({Q.values(FIRST_WORD.items())}) m(old, new)
          ON m.old = split_part(h.label, ' ', 1)))
WHERE rn = 1""", RUNS, V.HORIZON_LONG_SQL))
def q_rename_first_word(spark, d):
    r = V.runs(spark, d).select("doc_id", L.rename_first_word("horizon_freq", FIRST_WORD).alias("m"))
    return r.select("doc_id", F.explode("m").alias("label", "freq"))


# ---------------------------------------------------------------- J1 / J2 / J3 / J5
@query("overwrite_columns", ops=("J1",), sql="""
SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_overwrite(spark, d):
    tgt = table(spark, d, "documents").select("doc_id", "lang", "source", F.lit(-1).alias("quality"))
    src = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return TB.overwrite_columns(src, tgt, ["quality", "toxic"], ["doc_id"], order="target")


@query("bulk_overwrite", ops=("J5",), sql="""
SELECT d.source, d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_bulk_overwrite(spark, d):
    # every source's documents are one target "file"; one join over their union
    tgt = table(spark, d, "documents").select("source", "doc_id", F.lit(None).cast("int").alias("quality"))
    src = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return TB.overwrite_all(src, tgt, "source", ["quality", "toxic"], ["doc_id"]).select(
        "source", "doc_id", "quality", "toxic")


@query("assert_keys_match", ops=("J2",), sql="""
SELECT k, 'left_only' AS side FROM (SELECT o_orderkey AS k FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem)
UNION ALL
SELECT k, 'right_only' AS side FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)""")
def q_key_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return TB.key_differences(o, li, ["k"])


@query("assert_unique_keys", ops=("J3",), sql="""
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def q_dup_keys(spark, d):
    return TB.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- W11
def _outcomes(spark, d):
    r = scored(spark, d)
    o = F.transform(F.array(*[F.lit(s) for s in POST_STEPS]), lambda s, j: F.struct(
        s.alias("step"), F.when(j == 0, F.col("is_pass"))
        .otherwise((F.col("doc_id") + j * 7) % 5 == 0).alias("passed")))
    return r.select("doc_id", o.alias("outcomes"))


@query("step_short_circuit", ops=("W11",), sql=W(f"""
SELECT doc_id,
  CASE WHEN is_pass THEN 'original_code' WHEN (doc_id + 7) % 5 = 0 THEN 'cleaned_code'
       WHEN (doc_id + 14) % 5 = 0 THEN 'trimmed_code' ELSE 'indented_code' END AS step,
  is_pass OR (doc_id + 7) % 5 = 0 OR (doc_id + 14) % 5 = 0 OR (doc_id + 21) % 5 = 0 AS passed
FROM scored""", RUNS, SCORED_SQL))
def q_first_passing(spark, d):
    o = _outcomes(spark, d).select("doc_id", TB.first_passing_step("outcomes").alias("c"))
    return o.select("doc_id", F.col("c.step").alias("step"), F.col("c.passed").alias("passed"))


# ---------------------------------------------------------------- A13 / A17 / A18
LANGS = ["en", "fr", "de", "es"]


@query("category_census", ops=("A13",), sql="""
SELECT source, count(*) AS n_tasks, round(avg(len(string_split(text, chr(10)))), 6) AS avg_lines,
       count_if(lang = 'en') AS n_en, count_if(lang = 'fr') AS n_fr, count_if(lang = 'de') AS n_de,
       count_if(lang = 'es') AS n_es
FROM documents GROUP BY source""")
def q_category_census(spark, d):
    docs = table(spark, d, "documents").withColumn("n_lines", F.size(F.split("text", "\n")))
    return A.category_census(docs, "source", "lang", "n_lines", LANGS)


STATUS_OF = [("click", "Success: All Output matches the expected results."),
             ("view", "Failure: All Output does not match."),
             ("purchase", "Error: Compilation error: cannot find symbol"),
             ("signup", "Error: Traceback (most recent call last)")]


def _status_col():
    m = F.create_map(*[F.lit(x) for kv in STATUS_OF for x in kv])
    return F.when(F.col("event_type") == "error", F.when(
        F.col("value") < 20, F.lit("Unexpected error during execution: boom"))
        .otherwise(F.lit("Timeout: Execution exceeded time limit."))).otherwise(m[F.col("event_type")])


@query("error_outcome_census", ops=("A17",), sql=f"""
SELECT model, outcome, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY model), 6) AS share
FROM (SELECT 'm' || CAST(user_id % 4 AS VARCHAR) AS model,
        CASE WHEN st IS NULL THEN 'missing' WHEN starts_with(st, 'Success') THEN 'success'
             WHEN starts_with(st, 'Failure') THEN 'wrong_output'
             WHEN starts_with(st, 'Error: Compilation error') THEN 'compile_error'
             WHEN starts_with(st, 'Error') THEN 'runtime_error'
             WHEN starts_with(st, 'Timeout') THEN 'timeout' ELSE 'unexpected' END AS outcome
      FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN CASE WHEN value < 20
                  THEN 'Unexpected error during execution: boom' ELSE 'Timeout: Execution exceeded time limit.' END
                  ELSE m.st END AS st
            FROM events LEFT JOIN ({Q.values(STATUS_OF)}) m(et, st) ON m.et = events.event_type))
GROUP BY model, outcome""")
def q_outcome_census(spark, d):
    ev = table(spark, d, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
                                          _status_col().alias("status"))
    return A.outcome_census(ev, "status", by=["model"])


@query("token_count_per_dialog", ops=("A18",), sql="""
SELECT conv_id, CAST(sum(3 + len(list_filter(regexp_split_to_array(role, '\\s+'), lambda x: x <> ''))
                      + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) + 3 AS BIGINT) AS n_tokens
FROM conversations GROUP BY conv_id""")
def q_dialog_tokens(spark, d):
    return A.dialog_tokens(table(spark, d, "conversations"), "conv_id", ["role", "text"])


# ---------------------------------------------------------------- S3 / S4 on driver-derived files
TASKS_OF_ORDERS = 50   # dependency files: one folder per derived task


@query("scan_dependency_records", ops=("S3",), sql=W(f"""
SELECT 'task_' || CAST(l_orderkey % {TASKS_OF_ORDERS} AS VARCHAR) AS code_task, 'Python' AS language, scope_type,
       count(*) AS n, CAST(sum(usage_line) AS BIGINT) AS sum_use, CAST(sum(def_line) AS BIGINT) AS sum_def
FROM lags GROUP BY 1, 2, 3""", V.LAGS_SQL))
def q_scan_records(spark, d):
    """Dependency records written as verified CSVs (one folder per task) under
    <scratch>/Python/Verified, then read back by the record scanner."""
    base = io.scratch_path(spark, "records")
    lg = V.lags(spark, d).select(F.col("name").alias("var_name"), "usage_line", "def_line", "scope_type",
                                 F.lit("Short-range").alias("range_type"),
                                 F.concat(F.lit("task_"), (F.col("l_orderkey") % TASKS_OF_ORDERS).cast("string"))
                                 .alias("code_task"))
    lg.hint("rebalance", "code_task").write.mode("overwrite").partitionBy("code_task").option("header", True) \
        .csv(f"{base}/Python/Verified")
    r = io.scan_records(spark, f"{base}/Python/Verified")
    return r.groupBy("code_task", "language", "scope_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("usage_line").cast("long").alias("sum_use"),
        F.sum("def_line").cast("long").alias("sum_def"))


@query("scan_checkpoints", ops=("S4",), sql="""
SELECT 'order_' || CAST(l_orderkey AS VARCHAR) AS task, count(*) AS n_ckpt,
       CAST(sum(l_linenumber) AS BIGINT) AS sum_start,
       CAST(sum(l_linenumber + CAST(l_quantity AS INTEGER) % 5) AS BIGINT) AS sum_end
FROM lineitem GROUP BY 1""")
def q_scan_checkpoints(spark, d):
    """Checkpoint task JSON derived from lineitem (each line item an infilling
    range of its order), written as JSON Lines and read back by the scanner."""
    base = io.scratch_path(spark, "checkpoints")
    li = table(spark, d, "lineitem")
    rng = F.array(F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5)
    tasks = li.select(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("Task_Name"),
                      F.array(F.array(F.lit(1), F.lit(7))).alias("LN_range"), F.lit("final_output").alias("output_to_check"),
                      F.array(rng).alias("checkpoint_LN_infilling"), F.array().cast("array<array<int>>")
                      .alias("checkpoint_LN_Completion"))
    tasks.write.mode("overwrite").json(base)
    c = io.scan_checkpoints(spark, base, "infilling", multiline=False)
    return c.groupBy("task").agg(F.count(F.lit(1)).alias("n_ckpt"), F.sum("start_line").cast("long").alias("sum_start"),
                                 F.sum("end_line").cast("long").alias("sum_end"))
