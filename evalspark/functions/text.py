"""Text functions over generated code and its context (row-local column expressions).

Everything works inside one row with Spark's higher-order functions
(``transform``, ``filter``, ``aggregate``, ``exists``): a row's text never
leaves its task, nothing is shuffled, and the expressions stay in the JVM.
Line state that depends on earlier lines (block comments) is an
``aggregate`` fold over the row's line array.

Whitespace follows Python's ``str.split()`` / ``str.strip()`` (the harness's
behaviour), not Spark's ``trim`` (which removes spaces only).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions import constants as K
from evalspark.functions.arrays import fold_map, let, member_flags

from evalspark.functions.constants import POST_STEPS

# --- fixed values: whitespace of Python's str.split() / str.strip() ---------
PY_WHITESPACE_CODEPOINTS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
                            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PY_WHITESPACE = "".join(chr(c) for c in PY_WHITESPACE_CODEPOINTS)
WS = "[" + PY_WHITESPACE + "]"

# --- fixed values: re-indentation keywords ----------------------------------
BLOCK_OPENERS = [":", "{", "def", "class", "if", "elif", "else", "try", "except", "finally", "with",
                 "for", "while"]
BLOCK_CLOSERS = ["return", "break", "continue", "pass", "}", "raise", "yield"]
ALIGN_PARTNERS = [("elif ", ["elif ", "if "]), ("else:", ["elif ", "if "]),
                  ("except ", ["try "]), ("finally:", ["try "])]
BRACKETS = [("{", "}"), ("[", "]"), ("(", ")")]
TRIVIAL_LINES = ["{", "}", "(", ")", "[", "]", ""]

# Own line classification: comment prefixes and block markers per language. A line is
# code unless it is a comment or reads as prose; HTML code lines begin with a tag.
LANG_PROFILE = {
    "python": {"line": "#", "open": '"""', "close": '"""',
               "keyword": r"^(if|elif|else|try|except|finally|for|while|with|def|class|async|await|return|raise|assert|"
                          r"yield|pass|break|continue|import|from|del|global|nonlocal|lambda|match|case|print)\b"},
    "java": {"line": "//", "open": "/*", "close": "*/",
             "keyword": r"^(if|else|for|while|do|switch|case|default|try|catch|finally|return|throw|new|class|interface|enum|"
                        r"import|package|public|private|protected|static|final|abstract|void|break|continue)\b"},
    "html": {"line": "<!DOCTYPE", "open": "<!--", "close": "-->", "code": r"^<"},
}
# Prose: words up to a sentence mark, or a capital and four plain words or more; no
# assignment, bracket pair, statement mark or call in it.
PROSE_SENTENCE = r"^[A-Za-z][^=;{}\[\]<>#@]*[.!?:]$"
PROSE_WORDS = r"^[A-Z][a-z']*( [A-Za-z',-]+){3,}$"
CALL = r"[A-Za-z0-9_\])]\("
OPENERS, CLOSERS = "([{", ")]}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def esc(s: str) -> str:
    """Escape regex metacharacters (portable between Java regex and RE2)."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)


# whitespace -----------------------------------------------------------------
def py_strip(c) -> Column:
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))  # looks at the ends only


def py_lstrip(c) -> Column:
    return F.regexp_replace(_c(c), f"^{WS}+", "")


def py_rstrip(c) -> Column:
    return F.regexp_replace(_c(c), f"{WS}+$", "")


def indent_of(c) -> Column:
    """Width of the leading whitespace (``len(l) - len(l.lstrip())``)."""
    return F.length(_c(c)) - F.length(py_lstrip(c))


# F16 ------------------------------------------------------------------------
def normalize_line(c) -> Column:
    """``' '.join(line.split())``: collapse whitespace runs, strip the ends."""
    spaced = F.translate(_c(c), PY_WHITESPACE, " " * len(PY_WHITESPACE))
    return F.btrim(F.regexp_replace(spaced, "  +", " "))


def lines_of(c) -> Column:
    return F.split(F.coalesce(_c(c), F.lit("")), "\n")


# F3 / F4 --------------------------------------------------------------------
def split_at(text, start, end, tab: int = 4) -> Column:
    """Tabs -> spaces, split lines, cut before / between / after a 1-based inclusive range."""
    lines = F.split(F.replace(_c(text), F.lit("\t"), F.lit(" " * tab)), "\n")
    s, e = _c(start), _c(end)
    n = F.size(lines)
    return F.struct(
        F.slice(lines, 1, F.greatest(s - 1, F.lit(0))).alias("before"),
        F.slice(lines, F.greatest(s, F.lit(1)), F.greatest(e - s + 1, F.lit(0))).alias("between"),
        F.slice(lines, e + 1, F.greatest(n - e, F.lit(0))).alias("after"))


def number_lines(arr, start) -> Column:
    s = _c(start)
    return F.transform(_c(arr), lambda x, i: F.format_string("%4d: %s", i + s, x))


# F7 / F8 / F9 / F10 ----------------------------------------------------------
def extract_block(text, markers: Sequence[tuple[str, str]]) -> Column:
    """First block between the first marker pair found (pairs tried in order), else null."""
    t = _c(text)
    out = F.lit(None).cast("string")
    for s, e in reversed(list(markers)):
        pat = f"(?s){esc(s)}(.*?){esc(e)}"
        out = F.when(t.rlike(pat), F.regexp_extract(t, pat, 1)).otherwise(out)
    return out


def code_block_markers(language: str) -> list[tuple[str, str]]:
    sym = "//" if language.lower() == "java" else "#"
    return [(f"```{language.lower()}", "```"),
            (f"{sym} --BEGIN MISSING CODE--", f"{sym} --END MISSING CODE--")]


def extract_sections(text, starts: Sequence[str], ends: Sequence[str]) -> Column:
    """All sections between any start and any end marker (leftmost first; each
    right-trimmed) and the position just after the last section."""
    t = _c(text)
    s = "(?:" + "|".join(esc(x) for x in starts) + ")"
    e = "(?:" + "|".join(esc(x) for x in ends) + ")"
    secs = F.transform(F.regexp_extract_all(t, F.lit(f"(?s){s}(.*?){e}"), 1), lambda x: py_rstrip(x))
    last_end = F.length(F.regexp_extract(t, f"(?s)^((?:.*?{s}.*?{e})+)", 1))
    return F.struct(secs.alias("sections"), last_end.alias("last_end"))


def between_markers(text, begin: str, end: str) -> Column:
    """Text between the markers, stripped; the whole text when a marker is absent."""
    t = _c(text)
    ib, ie = F.instr(t, begin), F.instr(t, end)
    start = ib + len(begin)
    inner = F.when(ie - start > 0, F.substring(t, start, ie - start)).otherwise(F.lit(""))
    return F.when((ib == 0) | (ie == 0), t).otherwise(py_strip(inner))


def strip_fences(text, fence: str = "```") -> Column:
    """Blank every line that begins with the fence (line kept, content removed)."""
    return F.regexp_replace(_c(text), f"(?md)^{esc(fence)}.*$", "")


# F11 / F12 / F13 --------------------------------------------------------------
def last_pos(s: Column, marker: str) -> Column:
    """1-based start of the last occurrence of ``marker`` in ``s`` (0 when absent)."""
    r = F.instr(F.reverse(s), marker[::-1])
    return F.when(r > 0, F.length(s) - r - len(marker) + 2).otherwise(F.lit(0))


def line_kinds(lines, language: str) -> Column:
    """Per line: ``block_comment`` / ``comment`` / ``code`` / ``text``.

    Block state is a fold over the lines (in linear time, see ``arrays.fold_map``). Symmetric markers toggle on an odd
    count; distinct markers open on the opener and close on the closer. A
    line holding a marker is a block-comment line.
    """
    p = LANG_PROFILE[language]
    op, cl = p["open"], p["close"]
    init = F.struct(F.lit(False).alias("inb"), F.lit(0).alias("depth"))

    def cnt(x, m):
        return ((F.length(x) - F.length(F.replace(x, F.lit(m), F.lit("")))) / len(m)).cast("int")

    def step(acc, line):
        s = py_strip(line)
        inb = acc["inb"]
        if op == cl:
            has = cnt(s, op) > 0
            nxt = F.when(has & (cnt(s, op) % 2 == 1), ~inb).otherwise(inb)
            kind = F.when(has | inb, F.lit("block_comment"))
        else:
            lo, lc = last_pos(s, op), last_pos(s, cl)
            # the last marker on the line decides the state after it
            nxt = F.when((lo > 0) | (lc > 0), lo > lc).otherwise(inb)
            kind = F.when(inb | (lo > 0) | (lc > 0), F.lit("block_comment"))
        kind = kind.when(s.startswith(p["line"]), F.lit("comment"))
        if "code" in p:
            kind = kind.when(s.rlike(p["code"]), F.lit("code")).otherwise(F.lit("text"))
            depth = acc["depth"]
        else:
            prose = (s.rlike(PROSE_SENTENCE) | s.rlike(PROSE_WORDS)) & ~s.rlike(CALL) & ~s.rlike(p["keyword"])
            # inside open brackets every line goes on with the code before it
            kind = kind.when(s == "", F.lit("text")).when((acc["depth"] <= 0) & prose, F.lit("text")).otherwise(F.lit("code"))
            opened = F.length(s) - F.length(F.translate(s, OPENERS, "")) - (F.length(s) - F.length(F.translate(s, CLOSERS, "")))
            depth = acc["depth"] + F.when(kind == "code", opened).otherwise(0)
        return F.struct(nxt.alias("inb"), depth.cast("int").alias("depth")), kind

    return fold_map(_c(lines), init, "string", step)


def clean_code(text, language: str, markers: Sequence[tuple[str, str]] | None = None) -> Column:
    """The first code block if there is one; else drop fence lines, comments
    and non-code lines, then right-strip."""
    t = _c(text)
    block = extract_block(t, markers if markers is not None else code_block_markers(language))
    lines = F.split(F.regexp_replace(t, r"(?md)^```.*$", ""), "\n")
    kinds = line_kinds(lines, language)
    kept = F.filter(F.arrays_zip(lines.alias("l"), kinds.alias("k")), lambda z: z["k"] == "code")
    cleaned = py_rstrip(F.array_join(F.transform(kept, lambda z: z["l"]), "\n"))
    return F.coalesce(block, cleaned)


def strip_comments(text, language: str) -> Column:
    """Drop single-line and block comments only (other lines kept as they are)."""
    lines = lines_of(text)
    kinds = line_kinds(lines, language)
    kept = F.filter(F.arrays_zip(lines.alias("l"), kinds.alias("k")),
                    lambda z: ~z["k"].isin("comment", "block_comment"))
    return F.array_join(F.transform(kept, lambda z: z["l"]), "\n")


# F14 / F15 --------------------------------------------------------------------
def count_of(text, ch: str) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))


def bracket_counts(text) -> Column:
    """Open / close counts per bracket kind and the unclosed surplus."""
    fields = []
    for o, c in BRACKETS:
        name = {"{": "brace", "[": "square", "(": "paren"}[o]
        fields += [count_of(text, o).cast("long").alias(f"{name}_open"),
                   count_of(text, c).cast("long").alias(f"{name}_close")]
    return F.struct(*fields)


# J10 / U3 -------------------------------------------------------------------------
def remove_repeated(between, before_lines, after_lines) -> Column:
    """Keep only generated lines that occur in neither context (exact, order kept)."""
    empty = F.array().cast("array<string>")
    b = F.coalesce(_c(before_lines), empty)
    a = F.coalesce(_c(after_lines), empty)
    lines = F.split(F.coalesce(_c(between), F.lit("")), "\n")
    known = member_flags(lines, F.array_distinct(F.concat(b, a)))
    return let(known, lambda k: F.array_join(F.filter(lines, lambda x, i: ~F.get(k, i)), "\n"))


# F21 / F22 --------------------------------------------------------------------------
def edge_block_length(between, context_lines, from_start: bool = True, threshold: float | None = None) -> Column:
    """Length of the run of generated lines (>= 2) at the start / end that all
    occur in the context, on normalised lines; 0 when shorter. With ``threshold`` a line occurs if its fuzzy ratio
    with any context line, without white space, is above it (:func:`udfs.similar_to_any`); else if it is equal."""
    empty = F.array().cast("array<string>")
    ctx = F.transform(F.filter(F.coalesce(_c(context_lines), empty), lambda x: py_strip(x) != ""),
                      lambda x: normalize_line(x))
    btw = F.split(F.coalesce(_c(between), F.lit("")), "\n")
    seq = F.transform(btw if from_start else F.reverse(btw), lambda x: normalize_line(x))
    if threshold is None:
        hits = member_flags(seq, F.array_distinct(ctx))
    else:
        from evalspark.functions.udfs import similar_to_any
        hits = similar_to_any(threshold)(seq, F.array_distinct(ctx))

    def leading_run(h):
        # skip the non-matching prefix, then count until the first miss
        first_hit = F.array_position(h, True)
        after = F.slice(h, F.greatest(first_hit, F.lit(1)), F.size(h))
        miss = F.array_position(after, False)
        run = F.when(first_hit == 0, F.lit(0)).when(miss == 0, F.size(after)).otherwise(miss - 1)
        return F.when(run >= 2, run).otherwise(F.lit(0))

    return let(hits, leading_run)


def code_lines(lines, comment_prefix: str = "#") -> Column:
    """The lines that are neither blank nor a line comment."""
    return F.filter(_c(lines), lambda x: (py_strip(x) != "") & ~py_strip(x).startswith(comment_prefix))


def dedupe_boundary(between_lines, context_code_lines, n: int = 1) -> Column:
    """Skip the first ``n`` generated lines when they equal the last ``n``
    context code lines (normalised)."""
    ctx = F.transform(F.slice(F.coalesce(_c(context_code_lines), F.array().cast("array<string>")), -n, n)
                      if n > 0 else F.array().cast("array<string>"), lambda x: normalize_line(x))
    btw = _c(between_lines)
    head = F.transform(F.slice(btw, 1, n), lambda x: normalize_line(x))
    return F.when((F.size(ctx) == n) & (head == ctx), F.slice(btw, n + 1, F.greatest(F.size(btw) - n, F.lit(0)))) \
        .otherwise(btw)


# P10 ------------------------------------------------------------------------
def select_step(gen, steps=None) -> Column:
    """P10: (step, text) of the first non-empty given step, or of the last
    non-empty step of the default order; ("", "") when none."""
    order = steps if steps is not None else list(reversed(POST_STEPS))
    expr_step = F.lit("")
    expr_txt = F.lit("")
    for s in reversed(order):
        v = F.col(gen)[s]
        expr_step = F.when(F.coalesce(v, F.lit("")) != "", F.lit(s)).otherwise(expr_step)
        expr_txt = F.when(F.coalesce(v, F.lit("")) != "", v).otherwise(expr_txt)
    return F.struct(expr_step.alias("step"), expr_txt.alias("code"))


# F26 / F27 --------------------------------------------------------------------------
def compare_outputs(actual, expected, mode: str = "final_output") -> Column:
    """Final-line or whole-output comparison; errors / timeouts pass through."""
    a, e = F.coalesce(_c(actual), F.lit("")), F.coalesce(_c(expected), F.lit(""))

    def last_line(x):
        return py_strip(F.substring_index(py_strip(x), "\n", -1))

    final = F.when(last_line(a) == last_line(e), F.lit(K.FINAL_MATCHES)) \
        .otherwise(F.lit(K.FINAL_DIFFERS))
    whole = F.when(normalize_line(a) == normalize_line(e), F.lit(K.ALL_MATCHES)) \
        .otherwise(F.lit(K.ALL_DIFFERS))
    res = final if mode == "final_output" else whole
    return F.when(a.startswith("Error") | a.startswith("Timeout"), a).otherwise(res)


def unescape_simple(text) -> Column:
    """Decode ``\\\\``, ``\\n``, ``\\t``, ``\\r``, ``\\"`` and ``\\'`` in one pass
    (``\\\\`` is parked on a NUL sentinel first so ``\\\\n`` stays a backslash + n).
    ``\\uXXXX`` / ``\\xHH`` go through :func:`evalspark.functions.udfs.unescape_unicode`."""
    t = F.replace(_c(text), F.lit("\\\\"), F.lit("\x00"))
    for src, dst in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\'", "'")):
        t = F.replace(t, F.lit(src), F.lit(dst))
    return F.replace(t, F.lit("\x00"), F.lit("\\"))


# F29 / F30 ---------------------------------------------------------------------------
def ws_tokens(text) -> Column:
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), f"{WS}+"), lambda x: x != "")


def tokens_over(before, after, fixed_tokens, budget: int) -> Column:
    """How many tokens the prompt is over ``budget``: both contexts plus what is fixed
    (instructions, examples, room for the answer); 0 when it fits."""
    return F.greatest(F.size(ws_tokens(before)) + F.size(ws_tokens(after)) + _c(fixed_tokens) - F.lit(budget), F.lit(0))


def truncate_context(before, after, budget_over, keep: int) -> Column:
    """Over budget by ``budget_over`` tokens (see :func:`tokens_over`): cut the after part from its tail
    down to ``keep`` tokens, then the before part from its head."""
    bt, at = ws_tokens(before), ws_tokens(after)
    over = _c(budget_over)
    cut_a = F.when((F.length(F.coalesce(_c(after), F.lit(""))) > 0) & (over > 0) & (F.size(at) > keep),
                   F.least(F.size(at) - keep, over)).otherwise(F.lit(0))
    at2 = F.slice(at, 1, F.greatest(F.size(at) - cut_a, F.lit(0)))
    over2 = over - cut_a
    cut_b = F.when((over2 > 0) & (F.size(bt) > keep), F.least(F.size(bt) - keep, over2)).otherwise(F.lit(0))
    bt2 = F.slice(bt, cut_b + 1, F.greatest(F.size(bt) - cut_b, F.lit(0)))
    return F.struct(F.array_join(bt2, " ").alias("before"), F.array_join(at2, " ").alias("after"),
                    (over2 - cut_b).alias("still_over"))


# Wording of the instructions; every text is a parameter.
INSTRUCTIONS = {
    "comment": " Follow what the last comment of the 'before' part asks for. ",
    "Python": "\n\nIndentation matters here: keep the blocks of the surrounding code.",
    "Python with after": " The first and last line must fit the indentation of both sections.",
    "Python without after": " Continue at the indentation of the 'before' section.",
}


def assemble_prompt(template: str, language: str, before, after, examples=None,
                    comment_symbol: str = "#", instructions_in_comment: bool = False,
                    instructions: dict[str, str] = INSTRUCTIONS) -> Column:
    """Fill the prompt template; the after block only when the after part is non-empty;
    returns the two chat messages as ``array<struct<role, content>>``."""
    aft = F.coalesce(_c(after), F.lit(""))
    instr = instructions["comment"] if instructions_in_comment else ""
    instr_col = F.lit(instr + instructions.get(language, ""))
    if f"{language} with after" in instructions:
        instr_col = F.concat(instr_col, F.when(aft != "", F.lit(instructions[f"{language} with after"]))
                             .otherwise(F.lit(instructions[f"{language} without after"])))
    after_sec = F.when(aft != "", F.concat(F.lit("After Section:\n"), aft)).otherwise(F.lit(""))
    txt = F.lit(template)
    for key, val in (("{program_type}", F.lit(language)), ("{instruction_text}", instr_col),
                     ("{before_section}", F.coalesce(_c(before), F.lit(""))),
                     ("{begin_missing_code}", F.lit(f"{comment_symbol} --BEGIN MISSING CODE--")),
                     ("{end_missing_code}", F.lit(f"{comment_symbol} --END MISSING CODE--")),
                     ("{after_section}", after_sec),
                     ("{examples}", F.coalesce(_c(examples), F.lit("")) if examples is not None else F.lit(""))):
        txt = F.replace(txt, F.lit(key), val)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(f"{language} code generation").alias("content")),
                   F.struct(F.lit("user").alias("role"), txt.alias("content")))
