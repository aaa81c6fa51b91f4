"""Arrow-batched pandas UDFs: the few row functions with no built-in expression.

(Kept free of ``from __future__ import annotations`` so Spark can read the
pandas type hints.)
"""

import pandas as pd
from pyspark.sql.functions import pandas_udf


@pandas_udf("double")
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``difflib.SequenceMatcher(None, a, b).ratio()`` per row."""
    from difflib import SequenceMatcher
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


@pandas_udf("array<string>")
def parse_literal_list(s: pd.Series) -> pd.Series:
    """Python list literal text -> list of strings (None when not a list literal)."""
    import ast

    def one(x):
        try:
            v = ast.literal_eval(x)
        except (ValueError, SyntaxError, TypeError):
            return None
        return [str(e) for e in v] if isinstance(v, (list, tuple)) else None
    return s.map(one)


@pandas_udf("string")
def unescape_unicode(s: pd.Series) -> pd.Series:
    """Decode backslash escapes including ``\\uXXXX`` / ``\\xHH`` (ASCII-safe:
    non-ASCII characters pass through unchanged)."""
    import re
    pat = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[\\nrt\"'])")
    simple = {"\\": "\\", "n": "\n", "r": "\r", "t": "\t", '"': '"', "'": "'"}

    def rep(m):
        g = m.group(1)
        return chr(int(g[1:], 16)) if g[0] in "ux" else simple[g]
    return s.map(lambda x: None if x is None else pat.sub(rep, x))


@pandas_udf("double")
def ratio_above(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
    """The exact ratio when it can exceed ``t``; otherwise an upper bound <= t.

    ``real_quick_ratio`` and ``quick_ratio`` are upper bounds of ``ratio``, so
    skipping the full computation when a bound is <= t never loses a pair.
    """
    from difflib import SequenceMatcher
    out = []
    for x, y, th in zip(a, b, t):
        sm = SequenceMatcher(None, x or "", y or "")
        r = sm.real_quick_ratio()
        if r > th:
            r = sm.quick_ratio()
            if r > th:
                r = sm.ratio()
        out.append(r)
    return pd.Series(out, dtype="float64")


def similar_to_any(threshold: float = 0.98):
    """Column function (lines, others) -> array of booleans: lines whose ratio with any of the others, all without
    white space, is above ``threshold``. Null arrays count as empty."""
    from evalspark.functions.similar import by_length, close

    @pandas_udf("array<boolean>")
    def flags(lines: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for some, known in zip(lines, others):
            known = by_length("".join((t or "").split()) for t in ([] if known is None else known))
            seen = {}
            row = []
            for t in [] if some is None else some:
                t = "".join((t or "").split())
                if t not in seen:
                    seen[t] = close(t, known, threshold)
                row.append(seen[t])
            out.append(row)
        return pd.Series(out)
    return flags


def first_similar(threshold: float = 0.98):
    """Column function (lines, wanted) -> position from 0 of the first line similar to the first wanted text that has one
    (as in :func:`similar_to_any`); null if none has."""
    from evalspark.functions.similar import by_length, close

    @pandas_udf("int")
    def place(lines: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for some, texts in zip(lines, wanted):
            bare = ["".join((t or "").split()) for t in ([] if some is None else some)]
            found = None
            for w in [] if texts is None else texts:
                w = "".join((w or "").split())  # the ratio is not symmetric: the wanted text is the first one
                found = next((i for i, t in enumerate(bare) if close(w, by_length([t]), threshold)), None)
                if found is not None:
                    break
            out.append(found)
        return pd.Series(out, dtype="Int32")
    return place


def fourier_features(gamma: float, size: int, seed: int):
    """Column function array -> array of ``size`` random Fourier features of the Gaussian kernel, drawn from ``seed``."""
    import numpy as np

    @pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        res = np.empty(len(x), object)
        if known.any():
            rows = np.stack(x[known].to_list())
            draw = np.random.RandomState(seed)
            w = draw.normal(scale=(2 * gamma) ** 0.5, size=(rows.shape[1], size))
            z = np.cos(rows @ w + draw.uniform(0, 2 * np.pi, size)) * (2 / size) ** 0.5
            for i, row in zip(np.flatnonzero(known), z):
                res[i] = row
        return pd.Series(res)
    return mapped
