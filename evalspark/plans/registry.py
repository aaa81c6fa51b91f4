"""Registry of the queries bound to the driver tables.

Each registered query is a callable ``(spark, sf_dir) -> DataFrame`` built
from the library operators, plus -- when the semantics are expressible in
plain SQL -- an oracle statement for DuckDB over the same parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    op_ids: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def _bigint_counts(sql: str) -> str:
    """DuckDB types ``count_if`` as HUGEINT; Spark's is BIGINT. Wrap every call
    in a BIGINT cast so the oracle's schema matches (values are unchanged)."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tok)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _bigint_counts(sql[j + len(tok):k - 1])
        out.append(sql[i:j] + "CAST(" + tok + inner + ") AS BIGINT)")
        i = k


def query(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, _bigint_counts(sql) if sql else None, ops)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # Importing the modules registers their queries.
    from evalspark.plans import (  # noqa: F401
        q_core, q_distance, q_tables, q_text, q_tier_b, q_iterative)
    return REGISTRY
