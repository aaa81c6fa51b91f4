"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name-substring ...]

Mirrors the driver's gate: row count, column names (sorted) and an
order-insensitive multiset of values (floats rounded to 6 places).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from evalspark.plans.registry import load_all  # noqa: E402
from evalspark.session import TABLES, build_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    filters = sys.argv[2:]
    spark = build_session(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    reg = load_all()
    bad = 0
    for name, e in sorted(reg.items()):
        if filters and not any(f in name for f in filters):
            continue
        t0 = time.time()
        try:
            sdf = e.fn(spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as ex:  # noqa: BLE001
            with open(f"/tmp/oracle_err_{name}.txt", "w") as fh:
                fh.write(str(ex))
            print(f"FAIL {name}: spark error {str(ex)[:300]} (full text in /tmp/oracle_err_{name}.txt)")
            bad += 1
            continue
        ts = time.time() - t0
        if e.sql is None:
            print(f"rows {name}: {len(srows)} rows ({ts:.1f}s), no oracle")
            continue
        try:
            cur = con.execute(e.sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(ex)[:800]}")
            bad += 1
            continue
        msgs = []
        if sorted(scols) != sorted(dcols):
            msgs.append(f"cols spark={scols} duck={dcols}")
        if len(srows) != len(drows):
            msgs.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not msgs:
            a, b = rows_key(scols, srows), rows_key(dcols, drows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                msgs.append(f"values differ, e.g. {diff}")
        if msgs:
            bad += 1
            print(f"FAIL {name}: " + "; ".join(msgs)[:1500])
        else:
            print(f"ok   {name}: {len(srows)} rows ({ts:.1f}s)")
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
