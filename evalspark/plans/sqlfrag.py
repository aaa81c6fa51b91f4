"""SQL fragments shared by the DuckDB oracles (same semantics as the column functions)."""

from __future__ import annotations

from evalspark.functions.constants import RUN_NAME_PATTERN


def parse_ratio(c: str) -> str:
    parts = f"string_split({c}, '/')"
    k = f"TRY_CAST({parts}[1] AS DOUBLE)"
    n = f"TRY_CAST({parts}[2] AS DOUBLE)"
    return (f"(CASE WHEN {c} IS NULL THEN NULL ELSE coalesce(TRY_CAST({c} AS DOUBLE), "
            f"CASE WHEN len({parts}) = 2 AND {k} IS NOT NULL AND {n} IS NOT NULL THEN "
            f"CASE WHEN {n} = 0 THEN 0.0 ELSE {k} / {n} END END, 0.0) END)")


def rate(k: str, n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN CAST({k} AS DOUBLE) / {n} ELSE 0.0 END)"


def err(k: str, n: str) -> str:
    p = f"(CAST({k} AS DOUBLE) / {n})"
    return f"(CASE WHEN {n} > 0 THEN 1.96 * sqrt({p} * (1 - {p}) / {n}) ELSE 0.0 END)"


def fmt_rate(k: str, n: str) -> str:
    return (f"(CASE WHEN {n} > 0 THEN printf('%.2f%% ± %.2f (%d/%d)', {rate(k, n)} * 100, "
            f"{err(k, n)} * 100, CAST({k} AS BIGINT), CAST({n} AS BIGINT)) ELSE 'N/A' END)")


def fmt_short(k: str, n: str) -> str:
    return f"printf('%.1f ± %.1f', {rate(k, n)} * 100, {err(k, n)} * 100)"


def run_name_group(c: str, i: int) -> str:
    pat = RUN_NAME_PATTERN
    g = f"regexp_extract({c}, '{pat}', {i})"
    if i == 3:
        g = f"replace({g}, '_', ' ')"
    return f"(CASE WHEN regexp_matches({c}, '{pat}') THEN {g} ELSE 'Unknown' END)"


def range_class(d: str, s: int, m: int) -> str:
    return (f"(CASE WHEN {d} <= {s} THEN 'Short-Range' WHEN {d} <= {m} THEN 'Medium-Range' "
            f"ELSE 'Long-Range' END)")


def values(rows) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
