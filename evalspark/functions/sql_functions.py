"""SQL-callable names for the row functions (survey §2.9).

Registered as SQL-bodied temporary functions, so ``spark.sql`` users get the
same semantics as the column functions with no Python in the plan (the body
is inlined into the query by the analyzer).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from evalspark.functions.constants import Z95
from evalspark.functions.text import WS

_PARSE_RATIO = """CASE WHEN r IS NULL THEN NULL ELSE coalesce(try_cast(r AS DOUBLE),
  CASE WHEN size(split(r, '/')) = 2 AND try_cast(split(r, '/')[0] AS DOUBLE) IS NOT NULL
            AND try_cast(split(r, '/')[1] AS DOUBLE) IS NOT NULL
       THEN CASE WHEN try_cast(split(r, '/')[1] AS DOUBLE) = 0 THEN 0.0
                 ELSE try_cast(split(r, '/')[0] AS DOUBLE) / try_cast(split(r, '/')[1] AS DOUBLE) END END,
  0.0) END"""

FUNCTIONS = {
    "parse_ratio": ("r STRING", "DOUBLE", _PARSE_RATIO),
    "is_pass": ("r STRING", "BOOLEAN", f"({_PARSE_RATIO}) = 1.0"),
    "range_class": ("d INT, s INT, m INT", "STRING",
                    "CASE WHEN d <= s THEN 'Short-Range' WHEN d <= m THEN 'Medium-Range' ELSE 'Long-Range' END"),
    "near_far": ("d BIGINT, s BIGINT", "STRING",
                 "CASE WHEN d IS NULL THEN NULL WHEN d <= s THEN 'Short' ELSE 'Long' END"),
    "normalize_line": ("x STRING", "STRING",
                       f"regexp_replace(regexp_replace(x, '{WS}+', ' '), '^{WS}+|{WS}+$', '')"),
    "error_bar": ("k BIGINT, n BIGINT", "DOUBLE",
                  f"CASE WHEN n > 0 THEN {Z95} * sqrt((k / n) * (1 - k / n) / n) ELSE 0.0 END"),
    "pass_rate": ("k BIGINT, n BIGINT", "DOUBLE", "CASE WHEN n > 0 THEN k / n ELSE 0.0 END"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
