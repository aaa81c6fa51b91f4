"""Every registered query against its DuckDB oracle (sf0.001), and every
query without an oracle at least runs with a stable schema."""

import datetime as dt
import math

import duckdb
import pytest

from conftest import SF0001
from evalspark.plans.registry import load_all
from evalspark.session import TABLES

REG = load_all()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, e in REG.items() if e.sql))
def test_matches_oracle(spark, duck, name):
    e = REG[name]
    sdf = e.fn(spark, SF0001)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(e.sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _key(sdf.columns, srows) == _key(dcols, drows)


@pytest.mark.parametrize("name", sorted(n for n, e in REG.items() if not e.sql))
def test_runs_without_oracle(spark, name):
    df = REG[name].fn(spark, SF0001)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_contract(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.count() > 0
    assert set(se.oracle_sql()) <= set(se.queries())
