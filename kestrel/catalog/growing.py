"""Growing tables: newest rows and totals folded arrival by arrival, clustered snapshots, lookups and footers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.catalog.aggregations import money_sql
from kestrel.catalog.base import query
from kestrel.catalog.incremental import sandbox
from kestrel.catalog.loads import AR_SQL
from kestrel.catalog.models import AR_MODEL
from kestrel.operators.newest import fold_newest
from kestrel.operators.rollups import add_load, totals
from kestrel.session import work_dir
from kestrel.sources import matview as MV
from kestrel.sources.footers import extremes
from kestrel.sources.lookup import lookup, write_indexed

ARRIVALS = 3


def arrivals(df: DataFrame, key: str) -> list[DataFrame]:
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(ARRIVALS)) == i) for i in range(ARRIVALS)]


@query("newest_folded", oracle="""
SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey""")
def newest_folded(reg):
    """Newest order per customer from three arrivals, the second one twice, each folded into the stored newest rows."""
    store = sandbox(reg, "newest")
    first, second, third = arrivals(reg.table("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_orderkey")
    for arrival in (second, first, second, third):
        fold_newest(store, "newest", arrival, ["o_custkey"], "o_orderdate", "o_orderkey", buckets=8)
    return store.read("newest")


@query("totals_folded", oracle=f"""
SELECT l_returnflag, l_linestatus, COUNT(*) AS rows, {money_sql('l_extendedprice')} AS l_extendedprice_sum,
  CAST(ROUND(AVG(CAST(l_extendedprice AS DECIMAL(38,10))), 2) AS DOUBLE) AS l_extendedprice_avg, COUNT(l_extendedprice) AS l_extendedprice_n,
  MIN(l_extendedprice) AS l_extendedprice_min, MAX(l_extendedprice) AS l_extendedprice_max FROM lineitem GROUP BY ALL""")
def totals_folded(reg):
    """Totals per flag and status from the kept parts of three loads."""
    store, keys, measures = sandbox(reg, "totals"), ["l_returnflag", "l_linestatus"], ["l_extendedprice"]
    for load in arrivals(reg.table("lineitem").select(*keys, *measures, "l_orderkey"), "l_orderkey"):
        add_load(store, "totals", load, keys, measures)
    return totals(store, "totals", keys, measures)


@query("matview_clustered", oracle=AR_SQL)
def matview_clustered(reg):
    """The AR model as a snapshot along a Z-order curve over its date and foreign keys."""
    store = sandbox(reg, "matview-clustered")
    MV.build(store, reg, AR_MODEL, cluster=True)
    return store.read(AR_MODEL.name)


@query("lookup_indexed", oracle="SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 1024, 4242, -1)")
def lookup_indexed(reg):
    """Orders by key from a copy in the order of customers, by Bloom filters of the key."""
    path = f"{work_dir(reg.spark, 'indexed')}/orders"
    write_indexed(reg.table("orders").select("o_orderkey", "o_custkey", "o_totalprice").repartition("o_custkey"), path, ["o_orderkey"])
    return lookup(reg.spark.read.parquet(path), "o_orderkey", [7, 1024, 4242, -1])


FOOTERS = {"customer": "c_custkey", "events": "event_id", "lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey"}


@query("footer_extremes", oracle=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, MIN({c}) AS least, MAX({c}) AS greatest FROM {t}" for t, c in FOOTERS.items()))
def footer_extremes(reg):
    """Row count, least and greatest key of five tables, from their footers."""
    rows = [extremes(reg.spark, reg.path(t), c).select(F.lit(t).alias("table_name"), "row_count", F.col("least").cast("long").alias("least"),
                                                       F.col("greatest").cast("long").alias("greatest")) for t, c in FOOTERS.items()]
    return reduce(DataFrame.unionByName, rows)
