"""Aggregation, window and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.catalog import standins as S
from kestrel.catalog.base import query
from kestrel.catalog.models import AR_MODEL, LATEST_ORDER_MODEL
from kestrel.functions import primitives as P
from kestrel.functions.scalars import money_avg, money_sum
from kestrel.operators import aggregates as A
from kestrel.operators import filters as FL
from kestrel.operators.windows import latest_by, latest_per_key, with_share_of_total
from kestrel.plans.model import build_model

AR_FROM = """orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""


def money_sql(x: str) -> str:
    return f"CAST(ROUND(SUM(CAST({x} AS DECIMAL(38,10))), 2) AS DOUBLE)"


def ar(reg, cols):
    return build_model(reg, AR_MODEL, needed=cols)


# ------------------------------------------------------------------ the five primitives
@query("fn_aggregate", oracle=f"""
SELECT c.c_mktsegment, {money_sql('o.o_totalprice')} AS value FROM {AR_FROM}
GROUP BY c.c_mktsegment ORDER BY value DESC NULLS LAST, c_mktsegment ASC NULLS LAST""")
def fn_aggregate(reg):
    """aggregate(sum, o_totalprice, group_by=c_mktsegment) over the AR model (orders ⟕ customer)."""
    params = {"agg": "sum", "measure": "o_totalprice", "group_by": "c_mktsegment"}
    return P.aggregate(ar(reg, ["o_totalprice", "c_mktsegment"]), params)


@query("fn_aggregate_range", oracle=f"""
SELECT r.r_name, o.o_orderstatus, {money_sql('o.o_totalprice')} AS value FROM {AR_FROM}
WHERE o.o_orderdate >= TIMESTAMP '1996-01-01' AND o.o_orderdate <= TIMESTAMP '1998-12-31'
GROUP BY r.r_name, o.o_orderstatus ORDER BY value DESC NULLS LAST, r_name, o_orderstatus LIMIT 12""")
def fn_aggregate_range(reg):
    """aggregate(sum, o_totalprice, group_by=r_name,o_orderstatus, date_col=o_orderdate, from..to, limit 12)."""
    params = {"agg": "sum", "measure": "o_totalprice", "group_by": "r_name,o_orderstatus", "date_col": "o_orderdate",
              "from": "1996-01-01", "to": "1998-12-31", "limit": "12"}
    return P.aggregate(ar(reg, ["o_totalprice", "r_name", "o_orderstatus", "o_orderdate"]), params)


@query("fn_aggregate_count", oracle=f"""
SELECT n.n_name, COUNT(*) AS value FROM {AR_FROM}
GROUP BY n.n_name ORDER BY value DESC NULLS LAST, n_name""")
def fn_aggregate_count(reg):
    """aggregate(count, group_by=n_name): count needs no measure."""
    return P.aggregate(ar(reg, ["n_name"]), {"agg": "count", "group_by": "n_name"})


@query("fn_aggregate_avg", oracle="""
SELECT l_returnflag, CAST(ROUND(AVG(CAST(l_quantity AS DECIMAL(38,10))), 2) AS DOUBLE) AS value FROM lineitem
GROUP BY l_returnflag ORDER BY value DESC NULLS LAST, l_returnflag""")
def fn_aggregate_avg(reg):
    """aggregate(avg, l_quantity, group_by=l_returnflag) over lineitem."""
    return P.aggregate(reg.table("lineitem"), {"agg": "avg", "measure": "l_quantity", "group_by": "l_returnflag"})


@query("fn_timeseries", oracle=f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, {money_sql('o_totalprice')} AS value
FROM orders GROUP BY 1 ORDER BY 1""")
def fn_timeseries(reg):
    """timeseries(sum, o_totalprice, date_col=o_orderdate, bucket=month) over orders."""
    params = {"agg": "sum", "measure": "o_totalprice", "date_col": "o_orderdate", "bucket": "month"}
    return P.timeseries(reg.table("orders"), params)


@query("fn_timeseries_day", oracle="""
SELECT CAST(ts AS DATE) AS bucket, COUNT(*) AS value FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1 ORDER BY 1""")
def fn_timeseries_day(reg):
    """timeseries(count, date_col=ts, bucket=day, from, to) over events; bare-date `to` = midnight."""
    params = {"agg": "count", "date_col": "ts", "bucket": "day", "from": "2024-01-05", "to": "2024-01-20"}
    return P.timeseries(reg.table("events"), params)


@query("fn_top", oracle=f"""
SELECT c.c_name, {money_sql('o.o_totalprice')} AS value FROM {AR_FROM}
GROUP BY c.c_name ORDER BY value DESC NULLS LAST, c_name LIMIT 10""")
def fn_top(reg):
    """top(measure=o_totalprice, group_by=c_name): sum, default limit 10."""
    return P.top(ar(reg, ["o_totalprice", "c_name"]), {"measure": "o_totalprice", "group_by": "c_name"})


@query("fn_aging", oracle="""
SELECT bucket, value FROM (
  SELECT CASE WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') <= 90 THEN '0-90'
              WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') <= 365 THEN '91-365'
              WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') <= 730 THEN '366-730'
              ELSE '731+' END AS bucket,
         CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(38,10))), 2) AS DOUBLE) AS value,
         MIN(datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01')) AS m
  FROM orders WHERE DATE '2001-08-01' >= CAST(o_orderdate AS DATE) AND o_orderstatus <> 'F'
  GROUP BY 1) ORDER BY m""")
def fn_aging(reg):
    """aging(date_col=o_orderdate, measure=o_totalprice, buckets='365,90,730,90' (sorted and de-duplicated
    to 90,365,730), where=o_orderstatus!=F, as_of=2001-08-01)."""
    params = {"date_col": "o_orderdate", "measure": "o_totalprice", "buckets": "365,90,730,90",
              "where": "o_orderstatus!=F", "as_of": "2001-08-01"}
    return P.aging(reg.table("orders"), params)


@query("fn_breakdown", oracle="""
SELECT o_orderpriority, COUNT(*) AS count,
  ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 4) AS ratio
FROM orders GROUP BY o_orderpriority ORDER BY count DESC, o_orderpriority LIMIT 3""")
def fn_breakdown(reg):
    """breakdown(group_by=o_orderpriority, limit=3): ratio over ALL groups, not the 3 returned."""
    return P.breakdown(reg.table("orders"), {"group_by": "o_orderpriority", "limit": "3"})


@query("agg_rounded", oracle="""
SELECT l_returnflag, l_linestatus, CAST(ROUND(SUM(CAST(l_extendedprice AS DECIMAL(38,10))), 2) AS DOUBLE) AS sum_price,
  CAST(ROUND(AVG(CAST(l_quantity AS DECIMAL(38,10))), 2) AS DOUBLE) AS avg_qty, COUNT(*) AS n
FROM lineitem GROUP BY 1, 2""")
def agg_rounded(reg):
    """ROUND(agg, 2) in exact decimal; count is a bare count."""
    li = reg.table("lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        money_sum("l_extendedprice").alias("sum_price"), money_avg("l_quantity").alias("avg_qty"),
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ log rollups
@query("status_counts", oracle="""
SELECT event_type, COUNT(*) AS count, (SELECT COUNT(*) FROM events) AS total FROM events GROUP BY event_type""")
def status_counts(reg):
    """All-time count per status with the grand total."""
    return A.status_counts(reg.table("events"), "event_type")


@query("series_by_status", oracle="""
SELECT date_trunc('hour', ts) AS time, event_type, COUNT(*) AS count FROM events
WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-09 12:00:00' GROUP BY 1, 2""")
def series_by_status(reg):
    """Hourly count per status inside a time range."""
    return A.series_by_status(reg.table("events"), "ts", "event_type", "2024-01-03", "2024-01-09 12:00:00")


# ------------------------------------------------------------------ key quality and watermarks
@query("count_nulls", oracle="""
SELECT COUNT(*) FILTER (WHERE l_orderkey IS NULL) AS l_orderkey_nulls,
  COUNT(*) FILTER (WHERE l_linenumber IS NULL) AS l_linenumber_nulls,
  COUNT(*) FILTER (WHERE l_shipdate IS NULL) AS l_shipdate_nulls FROM lineitem""")
def count_nulls(reg):
    """NULL counts for several key columns in one pass."""
    return A.count_nulls(reg.table("lineitem"), ["l_orderkey", "l_linenumber", "l_shipdate"])


@query("count_duplicate_keys", oracle="""
SELECT COUNT(*) AS duplicate_keys, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS rows_in_duplicates FROM (
  SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1)""")
def count_duplicate_keys(reg):
    """Key groups with more than one row for (l_orderkey, l_linenumber)."""
    return A.count_duplicate_keys(reg.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("has_duplicates", oracle="""
SELECT k, EXISTS (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1) AS has_duplicates
FROM (VALUES ('l_orderkey,l_linenumber')) t(k)
UNION ALL SELECT 'o_orderkey', EXISTS (SELECT 1 FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1)""")
def has_duplicates(reg):
    """Is a proposed key non-unique? Each probe stops at the first duplicate group (limit 1)."""
    def probe(df, keys):
        return A.duplicate_key_groups(df, keys).limit(1).select(F.count(F.lit(1))).scalar() > 0

    one = reg.spark.range(1)
    return one.select(F.lit("l_orderkey,l_linenumber").alias("k"),
                      probe(reg.table("lineitem"), ["l_orderkey", "l_linenumber"]).alias("has_duplicates")).unionByName(
        one.select(F.lit("o_orderkey").alias("k"), probe(reg.table("orders"), ["o_orderkey"]).alias("has_duplicates")))


@query("min_max_watermark", oracle="""
SELECT strftime(MIN(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_watermark,
  strftime(MAX(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_watermark FROM orders""")
def min_max_watermark(reg):
    return A.min_max_watermark(reg.table("orders"), "o_orderdate")


@query("max_watermark_numeric", oracle=r"""
SELECT regexp_replace(CAST(MAX(TRY_CAST(NULLIF(trim(m), '') AS DECIMAL(38,10))) AS VARCHAR), '\.?0+$', '') AS max_watermark FROM (
  SELECT CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'O' THEN CAST(o_orderkey AS VARCHAR) || '.0'
              ELSE CAST(o_orderkey AS VARCHAR) || '.75' END AS m FROM orders)""")
def max_watermark_numeric(reg):
    """Numeric max over a text marker ('' = NULL, '123.0' accepted, fractions kept) from a text copy of orders."""
    o = reg.table("orders")
    text = o.select(F.when(F.col("o_orderstatus") == "P", F.lit(""))
                    .when(F.col("o_orderstatus") == "O", F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")))
                    .otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".75"))).alias("m"))
    return A.max_watermark_numeric(text, "m")


@query("max_watermark_pair", oracle="""
SELECT day AS max_day, tm AS max_time FROM (
  SELECT (year(ts) - 1900) * 1000 + dayofyear(ts) AS day,
         hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS tm FROM (SELECT CASE WHEN event_type <> 'error' THEN ts END AS ts FROM events))
ORDER BY day DESC NULLS LAST, tm DESC NULLS LAST LIMIT 1""")
def max_watermark_pair(reg):
    """Latest (CYYDDD day, HHMMSS time) pair over all events; those without a day (errors) don't count."""
    e = reg.table("events").select(F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))  # errors: no day
    pairs = e.select(((F.year("ts") - 1900) * 1000 + F.dayofyear("ts")).cast("long").alias("day"),
                     (F.hour("ts") * 10000 + F.minute("ts") * 100 + F.second("ts")).cast("long").alias("tm"))
    return A.max_watermark_pair(pairs, "day", "tm")


@query("distinct_dimension_counts", oracle="""
SELECT 'customer' AS table_name, COUNT(c_custkey) AS keys, COUNT(DISTINCT c_custkey) AS distinct_keys,
  COUNT(c_custkey) = COUNT(DISTINCT c_custkey) AS is_distinct FROM customer
UNION ALL SELECT 'supplier', COUNT(s_suppkey), COUNT(DISTINCT s_suppkey), COUNT(s_suppkey) = COUNT(DISTINCT s_suppkey)
  FROM supplier
UNION ALL SELECT 'nation', COUNT(n_nationkey), COUNT(DISTINCT n_nationkey),
  COUNT(n_nationkey) = COUNT(DISTINCT n_nationkey) FROM nation
UNION ALL SELECT 'orders.o_custkey', COUNT(o_custkey), COUNT(DISTINCT o_custkey),
  COUNT(o_custkey) = COUNT(DISTINCT o_custkey) FROM orders""")
def distinct_dimension_counts(reg):
    return A.distinct_dimension_counts({
        "customer": (reg.table("customer"), "c_custkey"), "supplier": (reg.table("supplier"), "s_suppkey"),
        "nation": (reg.table("nation"), "n_nationkey"), "orders.o_custkey": (reg.table("orders"), "o_custkey")})


TABLE_COUNT_NAMES = ["region", "nation", "customer", "supplier", "orders", "lineitem"]


@query("table_counts", oracle=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLE_COUNT_NAMES))
def table_counts(reg):
    """Exact counts of six tables in one report."""
    return A.table_counts({t: reg.table(t) for t in TABLE_COUNT_NAMES})


@query("row_count_estimate")
def row_count_estimate(reg):
    """Footer-based row count per table (metadata only: no column is read)."""
    return A.row_count_estimate({t: reg.table(t) for t in reg.names()})


# ------------------------------------------------------------------ windows
@query("latest_per_key", oracle="""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST,
    o_orderkey DESC NULLS FIRST) AS rn FROM orders) WHERE rn = 1""")
def latest_per_key_q(reg):
    """Newest order per customer; o_orderkey DESC breaks date ties."""
    o = reg.table("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest_per_key(o, "o_custkey", "o_orderdate", "o_orderkey")


@query("share_of_total", oracle="""
SELECT c_mktsegment, COUNT(*) AS count, ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 4) AS ratio
FROM customer GROUP BY c_mktsegment ORDER BY count DESC, c_mktsegment LIMIT 2""")
def share_of_total(reg):
    """Share of the grand total computed before LIMIT."""
    c = reg.table("customer")
    g = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("count"))
    out = with_share_of_total(g)
    return out.orderBy(F.col("count").desc(), "c_mktsegment").limit(2)


@query("latest_run_per_job", oracle=S.with_ctes(S.RUNS_CTE) + """
SELECT job_id, run_id, status, created_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY created_at DESC, run_id DESC) AS rn FROM job_runs)
WHERE rn = 1""")
def latest_run_per_job(reg):
    """Last run of each job (events as runs), as a max-of-struct aggregate."""
    runs = S.job_runs(reg)
    return latest_by(runs.withColumn("_o", F.struct("created_at", "run_id")), "job_id", "_o",
                     ["run_id", "status", "created_at"])


# ------------------------------------------------------------------ sorts and pages
@query("page_by_created", oracle="""
SELECT event_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 100 OFFSET 200""")
def page_by_created(reg):
    """Type A page: newest first, limit 100, offset 200."""
    e = reg.table("events").select("event_id", "ts", "event_type", "value")
    return FL.page_by_created(e, "ts", "event_id", 100, 200)


@query("page_by_key", oracle="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 4000 ORDER BY o_orderkey LIMIT 900""")
def page_by_key(reg):
    """Type B page ordered by PK: the 900 rows behind key 4000 (pages go on from the last key, not by offset)."""
    o = reg.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return FL.page_by_key(o, "o_orderkey", 900, after=FL.after_key("o_orderkey", 4000))


@query("preview_page", oracle="""
SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 5000""")
def preview_page(reg):
    """Model preview of as many rows as asked for, in key order."""
    c = reg.table("customer").select("c_custkey", "c_name", "c_mktsegment")
    return FL.preview_page(c, "c_custkey", 5000)


@query("top_k_groups", oracle=f"""
SELECT o_custkey, COUNT(*) AS value FROM orders GROUP BY o_custkey
ORDER BY value DESC NULLS LAST, o_custkey LIMIT 5000""")
def top_k_groups(reg):
    """top(agg=count, limit=5000)."""
    return P.top(reg.table("orders"), {"measure": "o_totalprice", "group_by": "o_custkey", "agg": "count",
                                       "limit": "5000"})


@query("latest_recency_check")
def latest_recency_check(reg):
    """Recency must exist in every deduplicated table and sort newest-first (number, date, datetime)."""
    from kestrel.plans.check import schema_issues
    from kestrel.plans.model import LatestConfig, ModelSpec

    specs = {
        "valid": LATEST_ORDER_MODEL,
        "missing_recency": ModelSpec("m1", LATEST_ORDER_MODEL.attributes, LATEST_ORDER_MODEL.joins,
                                     LatestConfig(recency="updated_at")),
        "text_recency": ModelSpec("m2", LATEST_ORDER_MODEL.attributes, LATEST_ORDER_MODEL.joins,
                                  LatestConfig(recency="o_orderstatus", recency_by_table={"customer": "c_name"})),
    }
    rows = [(label, *r) for label, spec in specs.items() for r in schema_issues(reg, spec) if r[1] == "recency_column"]
    rows += [(label, "ok", "recency_column", "all deduplicated tables have a sortable recency column")
             for label, spec in specs.items() if not any(r[0] == label for r in rows)]
    issues = reg.spark.createDataFrame(rows, "spec string, level string, code string, message string")
    from kestrel.plans.model import build_model

    built = build_model(reg, LATEST_ORDER_MODEL).agg(F.count(F.lit(1)).alias("n"),
                                                     F.count_distinct("o_custkey").alias("k"))
    check = built.select(F.lit("valid").alias("spec"), F.when(F.col("n") == F.col("k"), "ok").otherwise("error")
                         .alias("level"), F.lit("one_row_per_key").alias("code"),
                         F.concat(F.lit("rows="), F.col("n").cast("string")).alias("message"))
    return issues.unionByName(check)
