"""Text operators bound to documents, pages, conversations (build-plan step 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import text as X
from evalspark.functions.rates import parse_test_summary
from evalspark.operators import spans as S
from evalspark.operators import textops as TO
from evalspark.plans import sqlfrag as Q
from evalspark.plans import views as V
from evalspark.plans.q_core import RUNS, W
from evalspark.plans.registry import query
from evalspark.session import table

WSQ = Q.sql_str(X.WS)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^' || {WSQ} || '+|' || {WSQ} || '+$', '', 'g')"


def rstrip_sql(x: str) -> str:
    return f"regexp_replace({x}, {WSQ} || '+$', '', 'g')"


def norm_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, {WSQ} || '+', ' ', 'g')")


def lastpos_sql(s: str, m: str) -> str:
    r = f"strpos(reverse({s}), {Q.sql_str(m[::-1])})"
    return f"(CASE WHEN {r} > 0 THEN length({s}) - {r} - {len(m)} + 2 ELSE 0 END)"


# ---------------------------------------------------------------- F3 / F4
CKPT = "1 + doc_id % 5", "1 + doc_id % 5 + doc_id % 3"


@query("split_at_checkpoint", ops=("F3",), sql=f"""
SELECT doc_id, CAST(len(arr[1:s - 1]) AS INTEGER) AS n_before, CAST(len(arr[s:e]) AS INTEGER) AS n_between,
       CAST(len(arr[e + 1:]) AS INTEGER) AS n_after, array_to_string(arr[s:e], chr(10)) AS between_text
FROM (SELECT doc_id, {CKPT[0]} AS s, {CKPT[1]} AS e,
             string_split(replace(text, chr(9), '    '), chr(10)) AS arr FROM documents)""")
def q_split_at(spark, d):
    docs = table(spark, d, "documents")
    p = X.split_at("text", F.expr(CKPT[0]), F.expr(CKPT[1]))
    return docs.select("doc_id", p.alias("p")).select(
        "doc_id", F.size("p.before").alias("n_before"), F.size("p.between").alias("n_between"),
        F.size("p.after").alias("n_after"), F.array_join("p.between", "\n").alias("between_text"))


@query("number_lines", ops=("F4",), sql="""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
         lambda x, i: printf('%4d: %s', i - 1 + 1 + doc_id % 5, x)), chr(10)) AS numbered
FROM documents""")
def q_number_lines(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(X.number_lines(X.lines_of("text"), F.expr("1 + doc_id % 5")), "\n")
                       .alias("numbered"))


# ---------------------------------------------------------------- F7 / F8 / F9 / F10
BLOCKS = [("<article>", "</article>"), ("<script>", "</script>")]


@query("extract_code_block", ops=("F7",), sql=f"""
SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<article>(.*?)</article>')
                     THEN regexp_extract(html, '(?s)<article>(.*?)</article>', 1)
                     WHEN regexp_matches(html, '(?s)<script>(.*?)</script>')
                     THEN regexp_extract(html, '(?s)<script>(.*?)</script>', 1) END AS block
FROM pages""")
def q_extract_block(spark, d):
    return table(spark, d, "pages").select("page_id", X.extract_block("html", BLOCKS).alias("block"))


SEC_S, SEC_E = ["<p>", "<li>"], ["</p>", "</li>"]
_sec = "(?s)(?:<p>|<li>)(.*?)(?:</p>|</li>)"
_gap = "(?s)(.*?)(<p>|<li>)(.*?)(</p>|</li>)"


@query("extract_all_sections", ops=("F8",), sql=f"""
SELECT page_id, CAST(len(secs) AS INTEGER) AS n_sections,
       CAST(coalesce(list_sum(list_transform(secs, lambda x: length(x))), 0) AS BIGINT) AS total_len,
       CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, '{_gap}', 0), lambda x: length(x))), 0)
            AS BIGINT) AS last_end
FROM (SELECT page_id, html, list_transform(regexp_extract_all(html, '{_sec}', 1), lambda x: {rstrip_sql('x')}) AS secs
      FROM pages)""")
def q_extract_sections(spark, d):
    p = table(spark, d, "pages").select("page_id", X.extract_sections("html", SEC_S, SEC_E).alias("s"))
    return p.select("page_id", F.size("s.sections").cast("int").alias("n_sections"),
                    F.aggregate("s.sections", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("total_len"),
                    F.col("s.last_end").cast("long").alias("last_end"))


@query("extract_between_markers", ops=("F9",), sql=f"""
SELECT page_id, CASE WHEN strpos(html, '<title>') = 0 OR strpos(html, '</title>') = 0 THEN html
  ELSE {strip_sql("CASE WHEN strpos(html, '</title>') - (strpos(html, '<title>') + 7) > 0 THEN substr(html, strpos(html, '<title>') + 7, strpos(html, '</title>') - (strpos(html, '<title>') + 7)) ELSE '' END")}
  END AS inner_text
FROM pages""")
def q_between_markers(spark, d):
    return table(spark, d, "pages").select("page_id", X.between_markers("html", "<title>", "</title>").alias("inner_text"))


@query("strip_fences", ops=("F10",), sql="""
SELECT page_id, regexp_replace(html, '(?m)^<!--[^\\n]*$', '', 'g') AS stripped FROM pages""")
def q_strip_fences(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_fences("html", "<!--").alias("stripped"))


# ---------------------------------------------------------------- F11 / F12 / F13 / W4
HTML_KIND_SQL = f"""
plines AS (
  SELECT page_id, CAST(generate_subscripts(arr, 1) AS INTEGER) AS line_no, unnest(arr) AS line
  FROM (SELECT page_id, string_split(html, chr(10)) AS arr FROM pages)),
pm AS (
  SELECT *, CASE WHEN lo > 0 OR lc > 0 THEN lo > lc END AS ev
  FROM (SELECT *, {lastpos_sql('s', '<!--')} AS lo, {lastpos_sql('s', '-->')} AS lc
        FROM (SELECT *, {strip_sql('line')} AS s FROM plines))),
pk AS (
  SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inb FROM pm),
pkind AS (
  SELECT *, CASE WHEN inb OR lo > 0 OR lc > 0 THEN 'block_comment' WHEN starts_with(s, '<!DOCTYPE') THEN 'comment'
                 WHEN regexp_matches(s, '^<') THEN 'code' ELSE 'text' END AS kind FROM pk)"""


@query("classify_lines", ops=("F11",), sql=W("SELECT page_id, kind, count(*) AS n FROM pkind GROUP BY 1, 2",
                                            HTML_KIND_SQL))
def q_classify_lines(spark, d):
    p = table(spark, d, "pages").select("page_id", X.lines_of("html").alias("lines"))
    k = p.select("page_id", F.explode(X.line_kinds("lines", "html")).alias("kind"))
    return k.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("clean_code", ops=("F12",), sql=W(f"""
SELECT p.page_id, coalesce(
  CASE WHEN regexp_matches(p.html, '(?s)<article>(.*?)</article>') THEN regexp_extract(p.html, '(?s)<article>(.*?)</article>', 1) END,
  {rstrip_sql("coalesce(c.txt, '')")}) AS cleaned
FROM pages p LEFT JOIN (SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS txt
                       FROM pkind WHERE kind = 'code' GROUP BY page_id) c ON c.page_id = p.page_id""",
                                     HTML_KIND_SQL))
def q_clean_code(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_code("html", "html", [("<article>", "</article>")])
                                           .alias("cleaned"))


@query("strip_comments", ops=("F13",), sql=W("""
SELECT p.page_id, coalesce(c.txt, '') AS stripped
FROM pages p LEFT JOIN (SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS txt
                       FROM pkind WHERE kind NOT IN ('comment', 'block_comment') GROUP BY page_id) c
  ON c.page_id = p.page_id""", HTML_KIND_SQL))
def q_strip_comments(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_comments("html", "html").alias("stripped"))


@query("block_comment_spans", ops=("W4",), sql=W("""
SELECT page_id, min(line_no) AS first_line, max(line_no) AS last_line FROM (
  SELECT *, sum(CASE WHEN NOT inb THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span
  FROM (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS after_ FROM pk)
  WHERE inb OR after_ OR lo > 0)
GROUP BY page_id, span""", HTML_KIND_SQL))
def q_block_spans(spark, d):
    return _block_spans(spark, d)


def _pages_as_docs(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def _block_spans(spark, d):
    ln = V.lines(spark, d, docs=_pages_as_docs(spark, d)).select(
        F.col("doc_id").alias("page_id"), "line_no", X.py_strip("line").alias("s"))
    return S.block_spans(ln, ["page_id"], "line_no", "s", "<!--", "-->")


# ---------------------------------------------------------------- J10 / U3 / W10 / W3 / W5
TURNS = V.TURNS_SQL


@query("remove_repeated_lines", ops=("J10",), sql=W("""
SELECT conv_id, turn, array_to_string(list_filter(string_split(coalesce("between", ''), chr(10)),
         lambda x: NOT list_contains(string_split(coalesce("before", ''), chr(10)), x)
               AND NOT list_contains(string_split(coalesce("after", ''), chr(10)), x)), chr(10)) AS kept
FROM turns""", TURNS))
def q_remove_repeated(spark, d):
    t = V.turns(spark, d)
    return t.select("conv_id", "turn", X.remove_repeated("between", X.lines_of("before"), X.lines_of("after"))
                    .alias("kept"))


@query("distinct_context_lines", ops=("U3",), sql=W("""
SELECT conv_id, turn, count(DISTINCT line) AS n_lines FROM (
  SELECT conv_id, turn, unnest(string_split(coalesce("before", ''), chr(10))) AS line FROM turns
  UNION ALL
  SELECT conv_id, turn, unnest(string_split(coalesce("after", ''), chr(10))) AS line FROM turns)
GROUP BY conv_id, turn""", TURNS))
def q_context_lines(spark, d):
    c = TO.context_lines(V.turns(spark, d), ["conv_id", "turn"], "before", "after")
    return c.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_lines"))


def _code_lines_sql(c: str) -> str:
    st = strip_sql("l")
    return f"""[l FOR l IN string_split(coalesce({c}, ''), chr(10)) IF {st} <> '' AND NOT starts_with({st}, '#')]"""


@query("first_n_last_n_code_lines", ops=("W10",), sql=W(f"""
SELECT conv_id, turn,
  array_to_string(b[greatest(len(b) - 1, 1):], chr(10)) AS last_before,
  array_to_string(a[1:2], chr(10)) AS first_after
FROM (SELECT conv_id, turn, {_code_lines_sql('"before"')} AS b, {_code_lines_sql('"after"')} AS a FROM turns)""", TURNS))
def q_edge_lines(spark, d):
    t = V.turns(spark, d).select("conv_id", "turn", TO.edge_lines(
        X.code_lines(X.lines_of("before")), X.code_lines(X.lines_of("after")), 2).alias("e"))
    return t.select("conv_id", "turn", F.array_join("e.last_before", "\n").alias("last_before"),
                    F.array_join("e.first_after", "\n").alias("first_after"))


COMMENT_CLASS = "^[A-E]"   # line comments of the documents binding: lines opening with A-E


@query("line_comment_spans", ops=("W3",), sql=W(f"""
SELECT doc_id, min(line_no) AS first_line, max(line_no) AS last_line
FROM (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g
      FROM lines WHERE regexp_matches({strip_sql('line')}, '{COMMENT_CLASS}'))
GROUP BY doc_id, g""", V.LINES_SQL))
def q_line_spans(spark, d):
    ln = V.lines(spark, d)
    return S.comment_spans(ln, ["doc_id"], "line_no", X.py_strip("line").rlike(COMMENT_CLASS))


@query("all_comment_ends", ops=("W5",), sql=W(f"""
SELECT DISTINCT page_id, comment_end FROM (
  SELECT page_id, max(line_no) AS comment_end FROM (
    SELECT page_id, line_no, line_no - row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS g
    FROM pk WHERE starts_with(s, '<!DOCTYPE')) GROUP BY page_id, g
  UNION ALL
  SELECT page_id, max(line_no) AS comment_end FROM (
    SELECT *, sum(CASE WHEN NOT inb THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span
    FROM (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS after_ FROM pk)
    WHERE inb OR after_ OR lo > 0)
  GROUP BY page_id, span)""", HTML_KIND_SQL))
def q_comment_ends(spark, d):
    ln = V.lines(spark, d, docs=_pages_as_docs(spark, d)).select(
        F.col("doc_id").alias("page_id"), "line_no", X.py_strip("line").alias("s"))
    line_sp = S.comment_spans(ln, ["page_id"], "line_no", F.col("s").startswith("<!DOCTYPE"))
    block_sp = S.block_spans(ln, ["page_id"], "line_no", "s", "<!--", "-->")
    return S.comment_ends([line_sp, block_sp], ["page_id"])


# ---------------------------------------------------------------- F14 / F15 / F16
@query("bracket_balance", ops=("F14",), sql="""
SELECT doc_id,
  length(text) - length(replace(text, '{', '')) AS brace_open, length(text) - length(replace(text, '}', '')) AS brace_close,
  length(text) - length(replace(text, '[', '')) AS square_open, length(text) - length(replace(text, ']', '')) AS square_close,
  length(text) - length(replace(text, '(', '')) AS paren_open, length(text) - length(replace(text, ')', '')) AS paren_close
FROM documents""")
def q_bracket_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.bracket_counts("text").alias("b")).select("doc_id", "b.*")


def _balance_body(src: str) -> str:
    """SELECT over ``src`` (conv_id, turn, "before", "after", btw_text) with ``cur`` balanced."""
    def cnt(t, ch):
        return f"(length({t}) - length(replace({t}, '{ch}', '')))"
    q = """SELECT conv_id, turn, coalesce("before", '') AS b_txt, coalesce("after", '') AS a_txt,
       coalesce(btw_text, '') AS cur FROM """ + src
    for o, c in (("{", "}"), ("[", "]"), ("(", ")")):
        tot = "(b_txt || cur || a_txt)"
        q = f"""SELECT conv_id, turn, b_txt, a_txt,
  CASE WHEN n_o > n_c THEN cur || repeat('{c}', CAST(n_o - n_c AS INTEGER))
       WHEN n_o < n_c THEN array_to_string(list_transform(lines, lambda x, i:
           CASE WHEN ends_with(x, '{c}') AND len(list_filter(list_slice(lines, i + 1, len(lines)),
                     lambda y: ends_with(y, '{c}'))) < n_c - n_o
                THEN left(x, length(x) - 1) ELSE x END), chr(10))
       ELSE cur END AS cur
FROM (SELECT *, {cnt(tot, o)} AS n_o, {cnt(tot, c)} AS n_c, string_split(cur, chr(10)) AS lines FROM ({q}))"""
    return q


def _balance_sql() -> str:
    q = _balance_body('(SELECT conv_id, turn, "before", "after", "between" AS btw_text FROM turns)')
    return W(f"SELECT conv_id, turn, cur AS balanced FROM ({q})", V.TURNS_SQL)


@query("balance_brackets", ops=("F15",), sql=_balance_sql())
def q_balance(spark, d):
    t = V.turns(spark, d)
    b = TO.balance_brackets_df(t, X.lines_of("before"), F.col("between"), X.lines_of("after"), "balanced")
    return b.select("conv_id", "turn", "balanced")


@query("normalize_line", ops=("F16",), sql=W(f"""
SELECT doc_id, line_no, {norm_sql('line')} AS norm FROM lines""", V.LINES_SQL))
def q_normalize(spark, d):
    return V.lines(spark, d).select("doc_id", "line_no", X.normalize_line("line").alias("norm"))


# ---------------------------------------------------------------- F19 - F24 (rows-only, brute-force tested)
def _norm_list(expr: str) -> str:
    return f"list_transform({expr}, lambda x: {norm_sql('x')})"


_TRIV = "('{', '}', '(', ')', '[', ']', '')"
_SPLIT = "string_split(coalesce({c}, ''), chr(10))"


def _trim_body(src: str) -> str:
    """SELECT over ``src`` (conv_id, turn, "before", "after", btw_text) adding the exact cut."""
    m = f"list_transform(btw, lambda x: CASE WHEN {norm_sql('x')} IN {_TRIV} THEN NULL ELSE {norm_sql('x')} END)"
    bctx = f"list_filter(list_reverse({_norm_list(_SPLIT.format(c='\"before\"'))}), lambda x: x NOT IN {_TRIV})"
    actx = f"list_filter({_norm_list(_SPLIT.format(c='\"after\"'))}, lambda x: x NOT IN {_TRIV})"
    pos = "list_filter(list_transform({ctx}, lambda x: coalesce(list_position(m, x), 0)), lambda p: p > 0)"
    return f"""
SELECT conv_id, turn, "before", "after", btw_text, btw,
       CAST(CASE WHEN no_code THEN 0 ELSE s2 END AS INTEGER) AS cut_start,
       CAST(CASE WHEN no_code THEN n ELSE e END AS INTEGER) AS cut_end
FROM (SELECT *, len(list_filter(list_slice(m, s2 + 1, e), lambda x: x IS NOT NULL)) = 0 AS no_code FROM (SELECT *, CASE WHEN s <= e THEN s ELSE 0 END AS s2 FROM (
  SELECT *, len(btw) AS n,
         coalesce({pos.format(ctx='bctx')}[1], 0) AS s,
         coalesce({pos.format(ctx='actx')}[1] - 1, len(btw)) AS e
  FROM (SELECT *, {m} AS m, {bctx} AS bctx, {actx} AS actx
        FROM (SELECT *, {_SPLIT.format(c='btw_text')} AS btw FROM {src})))))"""


def _trim_sql() -> str:
    return W(f"""SELECT conv_id, turn, cut_start, cut_end FROM ({_trim_body(
        '(SELECT conv_id, turn, "before", "after", "between" AS btw_text FROM turns)')})""", TURNS)


@query("trim_repeated_edges", ops=("F19",), sql=_trim_sql())
def q_trim_edges(spark, d):
    t = TO.trim_cut_df(V.turns(spark, d), F.col("between"), X.lines_of("before"), X.lines_of("after"), "c")
    return t.select("conv_id", "turn", F.col("c.start").alias("cut_start"), F.col("c.end").alias("cut_end"))


F20_CTES = (
    f"""ctx AS (SELECT DISTINCT conv_id, turn, n FROM (
    SELECT conv_id, turn, {norm_sql('l')} AS n
    FROM (SELECT conv_id, turn, unnest(list_concat(string_split(coalesce("before", ''), chr(10)), string_split(coalesce("after", ''), chr(10)))) AS l
          FROM turns)) WHERE n <> '' AND NOT starts_with(n, '#'))""",
    f"""gen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS no FROM (
        SELECT conv_id, turn, pos, {norm_sql('l')} AS n FROM (
          SELECT conv_id, turn, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS pos, unnest(arr) AS l
          FROM (SELECT conv_id, turn, string_split(coalesce("between", ''), chr(10)) AS arr FROM turns)))
        WHERE n <> '' AND NOT starts_with(n, '#'))""",
    """hits AS (SELECT g.conv_id, g.turn, g.pos, g.no FROM gen g
         WHERE EXISTS (SELECT 1 FROM ctx c WHERE c.conv_id = g.conv_id AND c.turn = g.turn AND c.n = g.n))""",
    """runs AS (SELECT conv_id, turn, count(*) AS len, min(pos) AS first_pos FROM (
           SELECT *, no - row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS g FROM hits)
         GROUP BY conv_id, turn, g)""",
    """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len DESC, first_pos) AS rk
                        FROM runs) WHERE rk = 1)""")


@query("longest_common_edge", ops=("F20",), sql=W("""
SELECT t.conv_id, t.turn, CAST(coalesce(b.len, 0) AS BIGINT) AS run_len, CAST(b.first_pos AS INTEGER) AS run_start
FROM turns t LEFT JOIN best b ON b.conv_id = t.conv_id AND b.turn = t.turn""", TURNS, *F20_CTES))
def q_longest_edge(spark, d):
    return TO.longest_common_run(V.turns(spark, d), ["conv_id", "turn"], "between", ["before", "after"])


def _edge_sql() -> str:
    def ctx(c):
        return f"list_transform(list_filter({_SPLIT.format(c=c)}, lambda x: {strip_sql('x')} <> ''), lambda x: {norm_sql('x')})"

    def block(seq, cx):
        hits = f"list_transform({seq}, lambda x: list_contains({cx}, {norm_sql('x')}))"
        return f"""(SELECT CASE WHEN run >= 2 THEN run ELSE 0 END FROM (
            SELECT CASE WHEN fh = 0 THEN 0 WHEN miss = 0 THEN len(aft) ELSE miss - 1 END AS run FROM (
              SELECT fh, aft, coalesce(list_position(aft, false), 0) AS miss FROM (
                SELECT fh, list_slice(h, greatest(fh, 1), len(h)) AS aft FROM (
                  SELECT h, coalesce(list_position(h, true), 0) AS fh FROM (SELECT {hits} AS h))))))"""
    btw = _SPLIT.format(c='"between"')
    return W(f"""
SELECT conv_id, turn, CAST({block(btw, ctx('"before"'))} AS INTEGER) AS head_block,
       CAST({block(f"list_reverse({btw})", ctx('"after"'))} AS INTEGER) AS tail_block
FROM turns""", TURNS)


@query("edge_block_length", ops=("F21",), sql=_edge_sql())
def q_edge_block(spark, d):
    t = V.turns(spark, d)
    return t.select("conv_id", "turn",
                    X.edge_block_length(F.col("between"), X.lines_of("before"), True).alias("head_block"),
                    X.edge_block_length(F.col("between"), X.lines_of("after"), False).alias("tail_block"))


@query("fuzzy_edge_blocks", ops=("F21",))
def q_fuzzy_edges(spark, d):
    t = V.turns(spark, d)
    return t.select("conv_id", "turn",
                    X.edge_block_length(F.col("between"), X.lines_of("before"), True, threshold=0.98).alias("head_block"),
                    X.edge_block_length(F.col("between"), X.lines_of("after"), False, threshold=0.98).alias("tail_block"))


@query("adjusted_edges", ops=("F19",))
def q_adjusted_edges(spark, d):
    t = TO.trim_cut_df(V.turns(spark, d), F.col("between"), X.lines_of("before"), X.lines_of("after"), "c")
    t = TO.adjust_cut_df(t, F.col("between"), X.lines_of("before"), X.lines_of("after"), "c", "a")
    return t.select("conv_id", "turn", F.col("a.start").alias("cut_start"), F.col("a.end").alias("cut_end"))


BOUNDARY_LINES = 2


def _boundary_sql() -> str:
    same = " AND ".join(f"{norm_sql(f'btw[{i + 1}]')} = {norm_sql(f'bl[{i - n}]')}" for n in [BOUNDARY_LINES] for i in range(n))
    return f"""
SELECT conv_id, turn, array_to_string(CASE WHEN len(bl) >= {BOUNDARY_LINES} AND len(btw) >= {BOUNDARY_LINES} AND {same}
    THEN list_slice(btw, {BOUNDARY_LINES + 1}, len(btw)) ELSE btw END, chr(10)) AS kept
FROM (SELECT conv_id, turn, string_split(coalesce("between", ''), chr(10)) AS btw, {_code_lines_sql('"before"')} AS bl FROM turns)"""


@query("dedupe_boundary", ops=("F22",), sql=W(_boundary_sql(), TURNS))
def q_dedupe_boundary(spark, d):
    t = V.turns(spark, d)
    kept = X.dedupe_boundary(X.lines_of("between"), X.code_lines(X.lines_of("before")), BOUNDARY_LINES)
    return t.select("conv_id", "turn", F.array_join(kept, "\n").alias("kept"))


def _indent_sql() -> str:
    ind = f"length(x) - length(regexp_replace(x, '^' || {WSQ} || '+', ''))"
    return f"""
WITH b AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS bl FROM documents),
s AS (SELECT doc_id, bl, list_reverse(list_transform(list_slice(bl, greatest(len(bl) - 9, 1), len(bl)),
                                                     lambda x: {ind})) AS sz FROM b),
r AS (SELECT doc_id, list_filter(list_transform(generate_series(1, len(sz) - 1), lambda i: abs(sz[i + 1] - sz[i])),
                                 lambda d: d <> 0) AS rel FROM s),
u AS (SELECT doc_id, unnest(rel) AS v, generate_subscripts(rel, 1) AS pos FROM r),
c AS (SELECT doc_id, v, count(*) AS cnt, min(pos) AS p FROM u GROUP BY doc_id, v),
m AS (SELECT doc_id, v AS mode FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, p) AS rk FROM c) WHERE rk = 1)
SELECT s.doc_id,
       CASE WHEN list_contains(s.bl, chr(9)) THEN 'tab'
            WHEN len(s.sz) = 1 THEN CASE WHEN s.sz[1] > 0 THEN CAST(s.sz[1] AS VARCHAR) ELSE 'tab' END
            WHEN m.mode IS NOT NULL THEN CAST(m.mode AS VARCHAR) ELSE 'tab' END AS unit
FROM s LEFT JOIN m ON m.doc_id = s.doc_id"""


@query("indent_width", ops=("F23",), sql=_indent_sql())
def q_indent_width(spark, d):
    docs = TO.indent_unit_df(table(spark, d, "documents"), X.lines_of("text"), "u")
    return docs.select("doc_id", F.when(F.col("u") == "\t", F.lit("tab")).otherwise(F.length("u").cast("string"))
                       .alias("unit"))


def _reindent_body(src: str) -> str:
    """WITH-query over ``src`` (conv_id, turn, "before", btw_text) giving (conv_id, turn, indented)."""
    lstrip = lambda x: f"regexp_replace({x}, '^' || {WSQ} || '+', '')"
    ind = lambda x: f"(length({x}) - length({lstrip(x)}))"

    def width(x):
        return f"(CASE WHEN unit = chr(9) THEN {ind(f'replace({x}, chr(9), {Q.sql_str(' ' * 4)})')} ELSE {ind(x)} END)"
    opener = " OR ".join(f"ends_with(ls, {Q.sql_str(k)})" for k in X.BLOCK_OPENERS)
    closer = " OR ".join(f"starts_with(ls, {Q.sql_str(k)})" for k in X.BLOCK_CLOSERS)
    expected = f"({width('last')} + CASE WHEN {opener} THEN step ELSE 0 END - CASE WHEN {closer} THEN step ELSE 0 END)"
    for kw, partners in X.ALIGN_PARTNERS:
        cond = " OR ".join(f"starts_with({strip_sql('y')}, {Q.sql_str(p)})" for p in partners)
        partner = f"coalesce(list_filter(bl, lambda y: {cond})[-1], '')"
        expected = f"(CASE WHEN starts_with(first, {Q.sql_str(kw)}) THEN {width(partner)} ELSE {expected} END)"
    shifted = (f"repeat(' ', CAST(greatest({width('x')} + adj, 0) AS INTEGER)) || {lstrip('x')}")
    line = (f"CASE WHEN {strip_sql('x')} <> '' THEN (CASE WHEN unit = chr(9) THEN replace({shifted}, "
            f"{Q.sql_str(' ' * 4)}, chr(9)) ELSE {shifted} END) ELSE x END")
    ind_x = f"length(x) - length({lstrip('x')})"
    return f"""
WITH b AS (SELECT conv_id, turn, string_split(coalesce("before", ''), chr(10)) AS bl,
             string_split(coalesce(btw_text, ''), chr(10)) AS btw FROM {src}),
s AS (SELECT *, list_reverse(list_transform(list_slice(bl, greatest(len(bl) - 9, 1), len(bl)),
                                            lambda x: {ind_x})) AS sz FROM b),
r AS (SELECT conv_id, turn, list_filter(list_transform(generate_series(1, len(sz) - 1),
                                 lambda i: abs(sz[i + 1] - sz[i])), lambda d: d <> 0) AS rel FROM s),
u AS (SELECT conv_id, turn, unnest(rel) AS v, generate_subscripts(rel, 1) AS pos FROM r),
c AS (SELECT conv_id, turn, v, count(*) AS cnt, min(pos) AS p FROM u GROUP BY conv_id, turn, v),
m AS (SELECT conv_id, turn, v AS mode FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY cnt DESC, p) AS rk FROM c) WHERE rk = 1),
k AS (SELECT s.*, CASE WHEN list_contains(s.bl, chr(9)) THEN chr(9)
                       WHEN len(s.sz) = 1 THEN CASE WHEN s.sz[1] > 0 THEN repeat(' ', CAST(s.sz[1] AS INTEGER)) ELSE chr(9) END
                       WHEN m.mode IS NOT NULL AND m.mode > 0 THEN repeat(' ', CAST(m.mode AS INTEGER)) ELSE chr(9) END AS unit
      FROM s LEFT JOIN m ON m.conv_id = s.conv_id AND m.turn = s.turn),
l AS (SELECT *, CASE WHEN unit = chr(9) THEN 4 ELSE length(unit) END AS step,
             coalesce(list_filter(bl, lambda y: {strip_sql('y')} <> '')[-1], '') AS last,
             coalesce(list_filter(btw, lambda y: {strip_sql('y')} <> '')[1], '') AS first FROM k),
e AS (SELECT *, {expected} - {width('first')} AS adj FROM (SELECT *, {strip_sql('last')} AS ls FROM l))
SELECT conv_id, turn, array_to_string(list_transform(btw, lambda x: {line}), chr(10)) AS indented FROM e"""


def _reindent_sql() -> str:
    inner = _reindent_body('(SELECT conv_id, turn, "before", "between" AS btw_text FROM t)')
    return f"""WITH t AS ({V.TURNS_SQL.strip()[len('turns AS ('):-1]})
SELECT * FROM ({inner})"""


@query("reindent", ops=("F24",), sql=_reindent_sql())
def q_reindent(spark, d):
    t = TO.reindent_df(V.turns(spark, d), X.lines_of("before"), F.col("between"), "indented")
    return t.select("conv_id", "turn", "indented")


# ---------------------------------------------------------------- F25 / F17 / F18
def _pipeline_sql(language: str) -> str:
    prof = X.LANG_PROFILE[language]
    blocks = " ".join(
        f"WHEN regexp_matches(t.\"between\", {Q.sql_str(f'(?s){X.esc(a)}(.*?){X.esc(b)}')}) "
        f"THEN regexp_extract(t.\"between\", {Q.sql_str(f'(?s){X.esc(a)}(.*?){X.esc(b)}')}, 1)"
        for a, b in X.code_block_markers(language))
    op, cl = prof["open"], prof["close"]
    before = "OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    if op == cl:
        state = f"""cp AS (SELECT *, coalesce(sum(CASE WHEN q % 2 = 1 THEN 1 ELSE 0 END) {before}, 0) % 2 = 1 OR q > 0 AS blk
       FROM (SELECT *, CAST((length(s) - length(replace(s, '{op}', ''))) / {len(op)} AS INTEGER) AS q FROM cs))"""
    else:
        state = f"""cp AS (SELECT *, lo > 0 OR lc > 0 OR coalesce(last_value(CASE WHEN lo > 0 OR lc > 0 THEN lo > lc END IGNORE NULLS) {before}, false) AS blk
       FROM (SELECT *, {lastpos_sql('s', op)} AS lo, {lastpos_sql('s', cl)} AS lc FROM cs))"""
    prose = (f"(regexp_matches(s, {Q.sql_str(X.PROSE_SENTENCE)}) OR regexp_matches(s, {Q.sql_str(X.PROSE_WORDS)})) "
             f"AND NOT regexp_matches(s, {Q.sql_str(X.CALL)}) AND NOT regexp_matches(s, {Q.sql_str(prof['keyword'])})")
    opened = f"(length(translate(s, '{X.CLOSERS}', '')) - length(translate(s, '{X.OPENERS}', '')))"
    trim = _trim_body('(SELECT conv_id, turn, "before", "after", cleaned AS btw_text FROM cleaned)')
    if language == "python":
        last = f"SELECT conv_id, turn, indented AS final FROM ({_reindent_body('(SELECT conv_id, turn, \"before\", trimmed AS btw_text FROM trimmed)')})"
    else:
        last = f"SELECT conv_id, turn, cur AS final FROM ({_balance_body('(SELECT conv_id, turn, \"before\", \"after\", trimmed AS btw_text FROM trimmed)')})"
    return f"""
WITH RECURSIVE t AS ({V.TURNS_SQL.strip()[len('turns AS ('):-1]}),
cl AS (SELECT conv_id, turn, string_split(regexp_replace(coalesce("between", ''), '(?m)^```[^\n]*$', '', 'g'),
                                          chr(10)) AS arr FROM t),
cu AS (SELECT conv_id, turn, generate_subscripts(arr, 1) AS idx, unnest(arr) AS line FROM cl),
cs AS (SELECT *, {strip_sql('line')} AS s FROM cu),
{state},
cq AS (SELECT conv_id, turn, idx, line, CASE WHEN blk OR starts_with(s, '{prof["line"]}') OR s = '' THEN 'no' WHEN {prose} THEN 'prose' ELSE 'code' END AS sort,
              {opened} AS opened FROM cp),
ck AS (SELECT conv_id, turn, idx, line, sort = 'code' AS code, CASE WHEN sort = 'code' THEN opened ELSE 0 END AS depth FROM cq WHERE idx = 1
       UNION ALL
       SELECT n.conv_id, n.turn, n.idx, n.line, n.sort = 'code' OR n.sort = 'prose' AND k.depth > 0,
              k.depth + CASE WHEN n.sort = 'code' OR n.sort = 'prose' AND k.depth > 0 THEN n.opened ELSE 0 END
       FROM ck k JOIN cq n ON n.conv_id = k.conv_id AND n.turn = k.turn AND n.idx = k.idx + 1),
cc AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE code) AS txt
       FROM ck GROUP BY conv_id, turn),
cleaned AS (SELECT t.conv_id, t.turn, t."before", t."after",
                   CASE WHEN t."between" IS NULL THEN NULL
                        ELSE coalesce(CASE {blocks} END, {rstrip_sql("coalesce(cc.txt, '')")}) END AS cleaned
            FROM t LEFT JOIN cc ON cc.conv_id = t.conv_id AND cc.turn = t.turn),
trimmed AS (SELECT conv_id, turn, "before", "after",
                   array_to_string(list_slice(btw, cut_start + 1, cut_end), chr(10)) AS trimmed FROM ({trim})),
fin AS ({last})
SELECT c.conv_id, c.turn, c.cleaned AS cleaned_code, tr.trimmed AS trimmed_code, i.final AS final_code
FROM cleaned c JOIN trimmed tr ON tr.conv_id = c.conv_id AND tr.turn = c.turn
JOIN fin i ON i.conv_id = c.conv_id AND i.turn = c.turn"""


def _post_processed(spark, d, language):
    p = TO.post_process(V.turns(spark, d), "between", "before", "after", language)
    return p.select("conv_id", "turn", "gen_code.cleaned_code", "gen_code.trimmed_code", F.col("gen_code.indented_code").alias("final_code"))


@query("post_process_pipeline", ops=("F25",), sql=_pipeline_sql("python"))
def q_post_process(spark, d):
    return _post_processed(spark, d, "python")


@query("post_process_pipeline_java", ops=("F25",), sql=_pipeline_sql("java"))
def q_post_process_java(spark, d):
    return _post_processed(spark, d, "java")


@query("fuzzy_similar", ops=("F17",))
def q_fuzzy(spark, d):
    ln = V.lines(spark, d).filter(F.length(X.py_strip("line")) > 0).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("doc_line"), "line")
    bl = V.lines(spark, d, docs=table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")) \
        .select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("bench_line"),
                F.col("line").alias("bline"))
    return TO.fuzzy_pairs(ln, bl, "doc_line", "bench_line", "line", "bline", threshold=0.98)


@query("too_similar_flag", ops=("F18",))
def q_too_similar(spark, d):
    t = V.turns(spark, d)
    r = TO.reject_similar(t, "between", ["before", "after"], threshold=0.75)
    return r.select("conv_id", "turn", "too_similar")


# ---------------------------------------------------------------- F26 / F28 / F29 / F30 / F31
@query("compare_output", ops=("F26",), sql=f"""
SELECT a.doc_id,
  CASE WHEN starts_with(a.text, 'Error') OR starts_with(a.text, 'Timeout') THEN a.text
       WHEN {strip_sql(f"string_split({strip_sql('a.text')}, chr(10))[-1]")} =
            {strip_sql(f"string_split({strip_sql('e.text')}, chr(10))[-1]")}
       THEN 'Success: Final output matches the expected results.' ELSE 'Failure: Final output does not match.' END AS final_cmp,
  CASE WHEN starts_with(a.text, 'Error') OR starts_with(a.text, 'Timeout') THEN a.text
       WHEN {norm_sql('a.text')} = {norm_sql('e.text')}
       THEN 'Success: All Output matches the expected results.' ELSE 'Failure: All Output does not match.' END AS all_cmp
FROM documents a JOIN documents e ON e.doc_id = a.doc_id - 1""")
def q_compare(spark, d):
    docs = table(spark, d, "documents")
    a = docs.select("doc_id", F.col("text").alias("actual"))
    e = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("expected"))
    j = a.join(e, "doc_id")
    return j.select("doc_id", X.compare_outputs("actual", "expected", "final_output").alias("final_cmp"),
                    X.compare_outputs("actual", "expected", "all_output").alias("all_cmp"))


@query("parse_test_summary", ops=("F28",), sql=W("""
SELECT doc_id, round(CASE WHEN n_tests > 0 THEN CAST(k_passed AS DOUBLE) / n_tests ELSE 0.0 END, 6) AS ratio
FROM runs""", RUNS))
def q_test_summary(spark, d):
    r = V.runs(spark, d)
    txt = F.format_string("Test run finished\n[ %d tests successful ]\n[ %d tests failed ]\n[ %d tests found ]",
                          F.col("k_passed"), F.col("n_tests") - F.col("k_passed"), F.col("n_tests"))
    return r.select("doc_id", F.round(parse_test_summary(txt), 6).alias("ratio"))


def _tok_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {WSQ} || '+'), lambda t: t <> '')"


FIXED_TOKENS, TOKEN_BUDGET = 40, 120  # what the prompt needs besides the contexts; all it may have


@query("truncate_context", ops=("F29",), sql=W(f"""
SELECT conv_id, turn, array_to_string(list_slice(bef_t, cut_b + 1, len(bef_t)), ' ') AS before_kept, array_to_string(aft2, ' ') AS after_kept
FROM (SELECT *, CASE WHEN over2 > 0 AND len(bef_t) > 20 THEN least(len(bef_t) - 20, over2) ELSE 0 END AS cut_b
      FROM (SELECT *, list_slice(aft_t, 1, len(aft_t) - cut_a) AS aft2, over1 - cut_a AS over2
            FROM (SELECT *, CASE WHEN length(coalesce("after", '')) > 0 AND over1 > 0 AND len(aft_t) > 20 THEN least(len(aft_t) - 20, over1)
                                 ELSE 0 END AS cut_a
                  FROM (SELECT *, greatest(len(bef_t) + len(aft_t) + {FIXED_TOKENS} - {TOKEN_BUDGET}, 0) AS over1
                        FROM (SELECT conv_id, turn, "after", {_tok_sql('"before"')} AS bef_t, {_tok_sql('"after"')} AS aft_t
                              FROM turns)))))""", TURNS))
def q_truncate(spark, d):
    t = V.turns(spark, d)
    over = X.tokens_over("before", "after", F.lit(FIXED_TOKENS), TOKEN_BUDGET)
    c = X.truncate_context("before", "after", over, keep=20)
    return t.select("conv_id", "turn", c["before"].alias("before_kept"), c["after"].alias("after_kept"))


TEMPLATE = ("You complete {program_type} code.{instruction_text}\nBefore Section:\n{before_section}\n"
            "{begin_missing_code}\n{end_missing_code}\n{after_section}\n{examples}")


_INS = {k: Q.sql_str(v.strip("\n")) for k, v in X.INSTRUCTIONS.items()}


@query("assemble_prompt", ops=("F30",), sql=W(f"""
SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace(
  'You complete {{program_type}} code.{{instruction_text}}' || chr(10) || 'Before Section:' || chr(10) || '{{before_section}}' || chr(10)
  || '{{begin_missing_code}}' || chr(10) || '{{end_missing_code}}' || chr(10) || '{{after_section}}' || chr(10) || '{{examples}}',
  '{{program_type}}', 'Python'),
  '{{instruction_text}}', chr(10) || chr(10) || {_INS["Python"]}
     || CASE WHEN coalesce("after", '') <> '' THEN {_INS["Python with after"]} ELSE {_INS["Python without after"]} END),
  '{{before_section}}', coalesce("before", '')),
  '{{begin_missing_code}}', '# --BEGIN MISSING CODE--'),
  '{{end_missing_code}}', '# --END MISSING CODE--'),
  '{{after_section}}', CASE WHEN coalesce("after", '') <> '' THEN 'After Section:' || chr(10) || "after" ELSE '' END),
  '{{examples}}', '') AS user_prompt
FROM turns""", TURNS))
def q_assemble_prompt(spark, d):
    t = V.turns(spark, d)
    msgs = X.assemble_prompt(TEMPLATE, "Python", F.col("before"), F.col("after"))
    return t.select("conv_id", "turn", F.try_element_at(msgs, F.lit(2))["content"].alias("user_prompt"))


@query("render_dialog", ops=("F31",), sql=f"""
SELECT conv_id, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)
       || {strip_sql('text')} || '<|eot_id|>', '' ORDER BY turn)
       || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt
FROM conversations GROUP BY conv_id""")
def q_render_dialog(spark, d):
    return TO.render_dialog(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


# ---------------------------------------------------------------- F5 / F6
@query("parse_list_literal", ops=("F5",), sql="""
SELECT conv_id, turn, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_items FROM conversations
UNION ALL
SELECT conv_id, -1 - turn AS turn, 2 AS n_items FROM conversations""")
def q_parse_lines(spark, d):
    cv = table(spark, d, "conversations")
    plain = cv.select("conv_id", "turn", F.col("text").alias("t"))
    lit = cv.select("conv_id", (-1 - F.col("turn")).alias("turn"),
                    F.format_string("['%s', '%d']", F.col("role"), F.col("turn")).alias("t"))
    p = TO.parse_lines(plain.unionByName(lit), "t")
    return p.select("conv_id", "turn", F.size("lines").cast("int").alias("n_items"))


@query("parse_freq_map", ops=("F6",), sql="""
SELECT event_id, CAST(json_extract_string(replace(props, '''', '"'), '$.k') AS INTEGER) AS k,
       1 AS n_keys FROM events""")
def q_parse_freq(spark, d):
    ev = table(spark, d, "events")
    m = TO.parse_freq(F.col("props"))
    return ev.select("event_id", m["k"].alias("k"), F.size(m).alias("n_keys"))


# ---------------------------------------------------------------- F27
@query("unescape_expected", ops=("F27",), sql=r"""
SELECT conv_id, turn, length(text) AS n_chars,
       replace(replace(text, '\', '\\'), chr(10), '\n') AS escaped,
       text = text AS round_trip
FROM conversations""")
def q_unescape(spark, d):
    """Expected outputs are stored escaped; escape each turn's text the way a
    JSON writer does (backslash, newline) and decode it back."""
    cv = table(spark, d, "conversations")
    esc = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    u = TO.unescape(cv.select("conv_id", "turn", "text", esc.alias("escaped")), "escaped", "decoded")
    return u.select("conv_id", "turn", F.length("text").alias("n_chars"), "escaped",
                    (F.col("decoded") == F.col("text")).alias("round_trip"))
