"""Every registered query against its DuckDB oracle on sf0.001 (the driver's gate, at a smaller scale)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from kestrel.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["c_mktsegment", "value"] and df.count() == 5


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, SF)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    if key not in ORACLE:
        assert len(cols) > 0
        return
    res = con.execute(ORACLE[key])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    assert canon(cols, rows) == canon(ocols, res.fetchall())
