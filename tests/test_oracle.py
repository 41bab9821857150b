"""Every driver key against its DuckDB oracle on sf0.001 (the driver does
the same at sf0.01); keys without SQL must at least run."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["l_returnflag", "l_linestatus", "total_price", "row_count", "avg_qty", "min_qty", "max_qty"]


def test_every_oracle_key_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_key_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF0001)
    srows = df.collect()
    sql = E.oracle_sql().get(key)
    if sql is None:
        assert df.columns
        return
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, res.fetchall())
