"""The oracle sweep again with the strategies a large cluster uses: no broadcast joins, AQE off,
more shuffle partitions than some groups have rows. Catches results that depend on the plan."""

import duckdb
import pytest

import __spark_entry__ as E
from kestrel.sources.tables import DRIVER_TABLES
from tests.test_oracle_queries import SF, canon

ORACLE = E.oracle_sql()
QUERIES = E.queries()
AT_SCALE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "32"}


@pytest.fixture(scope="module")
def at_scale(spark):
    old = {k: spark.conf.get(k, None) for k in AT_SCALE}
    for k, v in AT_SCALE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_at_scale_plans(at_scale, con, key):
    df = QUERIES[key](at_scale, SF)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[key])
    ocols = [d[0] for d in res.description]
    assert canon(cols, rows) == canon(ocols, res.fetchall())
