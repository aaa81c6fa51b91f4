"""Dependency records: filters, sentences and sentence parsing (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.constants import (
    COMPREHENSION_SCOPES, DISTANCE_PATTERN, HORIZON_PATTERN, JAVA_SENTENCE, PY_SENTENCE,
    REASON_PATTERN)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# P13 ------------------------------------------------------------------------
def usable(use, def_, scope, drop_null_def: bool = False) -> Column:
    """Keep a use unless it sits on its own definition line (comprehension
    scopes excepted) or refers to a builtin; optionally drop null definitions."""
    use, def_, scope = _c(use), _c(def_), _c(scope)
    same_line = (use == def_) & ~scope.isin(*COMPREHENSION_SCOPES)
    keep = ~F.coalesce(same_line, F.lit(False)) & (F.coalesce(scope, F.lit("")) != "builtin")
    if drop_null_def:
        keep = keep & def_.isNotNull()
    return keep


# P15 ------------------------------------------------------------------------
def render_dependency(name, use, def_, scope, range_, language: str = "python") -> Column:
    """Record -> sentence, wording per scope type and language."""
    name, use, def_, scope, range_ = _c(name), _c(use), _c(def_), _c(scope), _c(range_)
    if language == "python":
        expr = None
        for sc, (subject, middle) in PY_SENTENCE.items():
            s = F.format_string(f"{subject} '%s' used at line %d {middle} %d and has a %s dependency.",
                                name, use, def_, range_)
            expr = F.when(scope == sc, s) if expr is None else expr.when(scope == sc, s)
        undefined = F.format_string("Variable '%s' used at line %d is undefined and has a %s dependency.",
                                    name, use, range_)
        return F.when(scope == "builtin", F.lit(None).cast("string")).otherwise(expr.otherwise(undefined))
    expr = None
    for sc, (subject, part) in JAVA_SENTENCE.items():
        head = F.format_string(f"{subject} '%s' used at line %d{part}", name, use)
        expr = F.when(scope == sc, head) if expr is None else expr.when(scope == sc, head)
    tail = F.when(def_.isNull(), F.lit("is undefined")).otherwise(
        F.format_string("is defined at line %d", def_))
    return F.when(scope == "builtin", F.lit(None).cast("string")).otherwise(
        F.concat_ws(" ", expr, F.concat(tail, F.lit(" and has a "), range_, F.lit(" dependency."))))


# P16 ------------------------------------------------------------------------
def render_reason(reason, line) -> Column:
    return F.format_string("'%s' detected at line %d.", _c(reason), _c(line))


# F1 -------------------------------------------------------------------------
def extract_distances(text) -> Column:
    """All ``Type 'x' used at line U is defined at line D`` -> array<struct<type,usage_line,def_line>>.

    Null text gives an empty array. ``imported`` and ``part of a ...`` sentences do not match.
    """
    t = F.coalesce(_c(text), F.lit(""))
    p = F.lit(DISTANCE_PATTERN)
    z = F.arrays_zip(F.regexp_extract_all(t, p, 1).alias("type"),
                     F.regexp_extract_all(t, p, 2).alias("u"),
                     F.regexp_extract_all(t, p, 3).alias("d"))
    return F.transform(z, lambda s: F.struct(s["type"].alias("type"),
                                             s["u"].cast("int").alias("usage_line"),
                                             s["d"].cast("int").alias("def_line")))


# A12 ------------------------------------------------------------------------
def horizon_categories(text, compat: bool = False) -> Column:
    """Category per horizon sentence found in the text: ``Type Range`` or ``Type Comp Range``.

    Default matches within lines; ``compat=True`` runs the pattern over the
    whole text with DOTALL like the harness, gluing an unmatched sentence to
    the next one.
    """
    t = F.coalesce(_c(text), F.lit(""))
    pat = ("(?s)" if compat else "") + HORIZON_PATTERN
    # one pass finds the matches; each (short) match is rewritten to its
    # category in a second, anchored pass -- groups that did not take part
    # are replaced by nothing, so "$1 $2$3 $4" yields "Type Range" or
    # "Type Comp Range" (trailing space trimmed)
    return F.transform(F.regexp_extract_all(t, F.lit(pat), 0), lambda m: F.rtrim(
        F.regexp_replace(m, "^" + ("(?s)" if compat else "") + "(?:" + HORIZON_PATTERN + ")$", "$1 $2$3 $4")))


def reason_categories(text) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return F.regexp_extract_all(t, F.lit("(?s)" + REASON_PATTERN), 1)


def frequency_map(categories) -> Column:
    """Array of categories -> map category -> count (row-local, no shuffle)."""
    cats = _c(categories)
    keys = F.array_distinct(cats)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(cats, lambda x: x == k))))
