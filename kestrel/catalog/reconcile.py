"""Validation and reconciliation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.catalog import standins as S
from kestrel.catalog.base import query
from kestrel.catalog.models import AR_MODEL
from kestrel.operators import reconcile as RC
from kestrel.operators.windows import latest_by
from kestrel.plans.check import model_check as run_model_check
from kestrel.plans.check import pk_null_count
from kestrel.plans.model import JoinSpec, ModelSpec, attr


def ts(d: str):
    return F.lit(d).cast("timestamp_ntz")


def lineitem_checks(reg) -> DataFrame:
    """A copy of lineitem that was loaded up to a ship date, held against the whole source."""
    source = reg.table("lineitem")
    copy = source.filter(F.col("l_shipdate") < ts("1998-09-01"))
    return RC.validate_target(copy, ["l_orderkey", "l_linenumber"], "l_shipdate", source.select(F.count(F.lit(1))).scalar(), "lineitem")


LINEITEM_CHECKS_SQL = """
WITH copy AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-01'),
s AS (SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM lineitem) AS src, COUNT(*) FILTER (WHERE l_orderkey IS NULL) AS n1,
  COUNT(*) FILTER (WHERE l_linenumber IS NULL) AS n2, strftime(MIN(l_shipdate), '%Y-%m-%d %H:%M:%S') AS mn,
  strftime(MAX(l_shipdate), '%Y-%m-%d %H:%M:%S') AS mx,
  (SELECT COUNT(*) FROM (SELECT 1 FROM copy GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)) AS d
  FROM copy)
SELECT 'target_table_exists' AS check_name, 'pass' AS status, NULL AS source_value, 'lineitem' AS target_value,
  NULL AS message FROM s
UNION ALL SELECT 'target_row_count', 'pass', NULL, CAST(n AS VARCHAR), NULL FROM s
UNION ALL SELECT 'source_target_row_count', CASE WHEN n = src THEN 'pass' ELSE 'fail' END, CAST(src AS VARCHAR), CAST(n AS VARCHAR),
  CASE WHEN n = src THEN NULL ELSE 'Source row count does not match target row count' END FROM s
UNION ALL SELECT 'primary_key_null_count:l_orderkey', CASE WHEN n1 = 0 THEN 'pass' ELSE 'fail' END, NULL,
  CAST(n1 AS VARCHAR), CASE WHEN n1 = 0 THEN NULL ELSE 'Primary key column contains null values' END FROM s
UNION ALL SELECT 'primary_key_null_count:l_linenumber', CASE WHEN n2 = 0 THEN 'pass' ELSE 'fail' END, NULL,
  CAST(n2 AS VARCHAR), CASE WHEN n2 = 0 THEN NULL ELSE 'Primary key column contains null values' END FROM s
UNION ALL SELECT 'primary_key_duplicate_count', CASE WHEN d = 0 THEN 'pass' ELSE 'fail' END, NULL, CAST(d AS VARCHAR),
  CASE WHEN d = 0 THEN NULL ELSE 'Duplicate primary key values found' END FROM s
UNION ALL SELECT 'watermark_column:l_shipdate', 'pass', NULL, 'l_shipdate', NULL FROM s
UNION ALL SELECT 'target_watermark_min', CASE WHEN mn IS NULL THEN 'warning' ELSE 'pass' END, NULL, mn,
  CASE WHEN mn IS NULL THEN 'Target watermark minimum is null' END FROM s
UNION ALL SELECT 'target_watermark_max', CASE WHEN mx IS NULL THEN 'warning' ELSE 'pass' END, NULL, mx,
  CASE WHEN mx IS NULL THEN 'Target watermark maximum is null' END FROM s"""


@query("validate_target", oracle=LINEITEM_CHECKS_SQL)
def validate_target(reg):
    """Check rows for a partly loaded copy of lineitem with key (l_orderkey, l_linenumber) and watermark l_shipdate."""
    return lineitem_checks(reg)


@query("validation_rollup", oracle="""
WITH o AS (SELECT COUNT(*) FILTER (WHERE o_orderkey IS NULL) AS n1,
  (SELECT COUNT(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1)) AS d FROM orders),
l AS (SELECT (SELECT COUNT(*) FROM (SELECT 1 FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-01' GROUP BY l_orderkey, l_linenumber
              HAVING COUNT(*) > 1)) AS d, (SELECT COUNT(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-09-01') AS lacking)
SELECT 'orders' AS table_name, CASE WHEN n1 > 0 OR d > 0 THEN 'fail' ELSE 'pass' END AS validation_status FROM o
UNION ALL SELECT 'lineitem', CASE WHEN d > 0 OR lacking > 0 THEN 'fail' ELSE 'pass' END FROM l
UNION ALL SELECT 'orders_no_watermark', CASE WHEN n1 > 0 OR d > 0 THEN 'fail' ELSE 'warning' END FROM o""")
def validation_rollup(reg):
    """fail if no checks or any fail; warning if any warning; else pass — per validated table."""
    o = reg.table("orders")
    checks = [RC.validate_target(o, ["o_orderkey"], "o_orderdate", None, "orders").withColumn("table_name", F.lit("orders")),
              lineitem_checks(reg).withColumn("table_name", F.lit("lineitem")),
              # a watermark column whose values are all NULL yields warnings
              RC.validate_target(o.withColumn("wm", F.lit(None).cast("timestamp_ntz")), ["o_orderkey"], "wm", None,
                                 "orders").withColumn("table_name", F.lit("orders_no_watermark"))]
    return RC.validation_rollup(reduce(DataFrame.unionByName, checks), ["table_name"])


SPLIT_SQL = """
SELECT 'orders' AS table_name, (SELECT COUNT(*) FROM orders) AS source_count,
  (SELECT COUNT(*) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01') AS target_count
UNION ALL SELECT 'customer', (SELECT COUNT(*) FROM customer), (SELECT COUNT(*) FROM customer)"""


def split_counts(reg) -> DataFrame:
    o, c = reg.table("orders"), reg.table("customer")
    return RC.verify_counts({"orders": (o, o.filter(F.col("o_orderdate") < ts("2000-01-01"))), "customer": (c, c)})


@query("reconcile_run", oracle=f"""
SELECT table_name, source_count, target_count,
  CASE WHEN source_count = target_count THEN 'MATCH' ELSE 'MISMATCH' END AS validation_status,
  source_count - target_count AS missed FROM ({SPLIT_SQL})""")
def reconcile_run(reg):
    """MATCH / MISMATCH / PENDING with missed = source - target (orders loaded up to 2000; customer whole)."""
    return split_counts(reg)


ALTERED_SQL = """
WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'),
j AS (SELECT s.o_orderkey AS sk, t.o_orderkey AS tk,
  (s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority) IS NOT DISTINCT FROM
  (t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate, t.o_orderpriority) AS same
  FROM orders s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey)
SELECT COUNT(*) FILTER (WHERE tk IS NULL) AS missing_in_target, COUNT(*) FILTER (WHERE sk IS NULL) AS extra_in_target,
  COUNT(*) FILTER (WHERE sk IS NOT NULL AND tk IS NOT NULL AND NOT same) AS changed,
  COUNT(*) FILTER (WHERE sk IS NOT NULL AND tk IS NOT NULL AND same) AS equal FROM j"""


@query("full_reconcile", oracle=ALTERED_SQL)
def full_reconcile(reg):
    """Row-level compare of orders with an altered copy: missing, extra, changed, equal keys."""
    o = reg.table("orders")
    t = (o.filter(F.col("o_orderstatus") != "P").withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice")))
        .unionByName(o.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"))
                     .withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)))
    return RC.full_reconcile(o, t, ["o_orderkey"])


DRIFTED_SQL = """
WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4001 = 7 THEN NULL ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 5003 <> 11
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 6007 = 13),
j AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, s.o_orderkey AS sk, t.o_orderkey AS tk,
  s.o_totalprice IS NOT DISTINCT FROM t.o_totalprice AS same FROM orders s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey)"""


def drifted(o: DataFrame) -> DataFrame:
    """A copy of orders with a few amounts lost, a few orders missing and a few too many."""
    key = F.col("o_orderkey")
    return o.filter(key % 5003 != 11).withColumn("o_totalprice", F.when(key % 4001 != 7, F.col("o_totalprice"))).unionByName(
        o.filter(key % 6007 == 13).withColumn("o_orderkey", key + 1000000000))


@query("checksum_reconcile", oracle=DRIFTED_SQL + """
SELECT COUNT(*) FILTER (WHERE tk IS NULL) AS missing_in_target, COUNT(*) FILTER (WHERE sk IS NULL) AS extra_in_target,
  COUNT(*) FILTER (WHERE sk IS NOT NULL AND tk IS NOT NULL AND NOT same) AS changed,
  COUNT(*) FILTER (WHERE sk IS NOT NULL AND tk IS NOT NULL AND same) AS equal FROM j""")
def checksum_reconcile(reg):
    """Level ``checksum_sample``: orders against a copy with a few differences, opened by a tree of bucket checksums."""
    o = reg.table("orders")
    return RC.checksum_reconcile(o, drifted(o), ["o_orderkey"])


@query("differing_keys", oracle=DRIFTED_SQL + """
SELECT o_orderkey, CASE WHEN tk IS NULL THEN 'missing' WHEN sk IS NULL THEN 'extra' ELSE 'changed' END AS verdict
FROM j WHERE tk IS NULL OR sk IS NULL OR NOT same""")
def differing_keys(reg):
    """Which keys differ, and how: the rows that a repair has to load again."""
    o = reg.table("orders")
    return RC.differing_keys(o, drifted(o), ["o_orderkey"])


TOL_SQL = """SELECT l_suppkey, CAST(FLOOR(SUM(CAST(l_extendedprice AS DECIMAL(38,10)))) AS BIGINT) AS source_count,
  COUNT(*) FILTER (WHERE l_returnflag = 'R') > COUNT(*) FILTER (WHERE l_returnflag = 'A') AS replicating
  FROM lineitem GROUP BY l_suppkey"""


@query("verdict_tolerance", oracle=f"""
SELECT l_suppkey, source_count, replicating,
  CASE WHEN replicating THEN GREATEST(50, CAST(FLOOR(CAST(source_count AS DOUBLE) * CAST(0.0001 AS DOUBLE)) AS BIGINT))
       ELSE 0 END AS tolerance FROM ({TOL_SQL})""")
def verdict_tolerance(reg):
    """0 unless replicating; else max(50 rows, int(0.0001 x source)) over large per-supplier counts."""
    li = reg.table("lineitem")
    c = li.groupBy("l_suppkey").agg(F.floor(F.sum(F.col("l_extendedprice").cast("decimal(38,10)"))).cast("long")
                                    .alias("source_count"),
                                    (F.count_if(F.col("l_returnflag") == "R") > F.count_if(F.col("l_returnflag") == "A"))
                                    .alias("replicating"))
    return c.withColumn("tolerance", RC.tolerance(F.col("source_count"), F.col("replicating")))


@query("source_verdict", oracle=S.with_ctes(S.COUNTS_CTE) + """
SELECT job_id, CASE WHEN source_count IS NULL THEN 'PENDING'
  WHEN count_mode = 'exact' AND target_count IS NULL THEN 'PENDING'
  WHEN count_mode = 'exact' AND abs(source_count - target_count) <=
    (CASE WHEN replicating THEN GREATEST(50, CAST(FLOOR(CAST(source_count AS DOUBLE) * CAST(0.0001 AS DOUBLE)) AS BIGINT)) ELSE 0 END)
    THEN 'MATCH'
  WHEN count_mode = 'exact' THEN 'MISMATCH' ELSE 'ESTIMATE' END AS verdict FROM source_counts""")
def source_verdict(reg):
    """PENDING / MATCH (within tolerance) / MISMATCH; estimates are ESTIMATE, never MISMATCH."""
    c = S.source_counts(reg)
    tol = RC.tolerance(F.col("source_count"), F.col("replicating"))
    return c.select("job_id", RC.source_verdict(F.col("source_count"), F.col("count_mode"), F.lit(False),
                                                F.col("target_count"), tol).alias("verdict"))


@query("verify_table", oracle="""
WITH c AS (SELECT (SELECT COUNT(*) FROM orders) AS s, (SELECT COUNT(*) FROM orders WHERE o_orderstatus <> 'P') AS t)
SELECT 'orders' AS table_name, s AS source_count, t AS target_count,
  CASE WHEN s = t THEN 'MATCH' ELSE 'MISMATCH' END AS verdict, s - t AS missed,
  CASE WHEN s = t THEN 'pass' ELSE 'fail' END AS check_status FROM c""")
def verify_table(reg):
    """Exact source count against exact target count -> verdict, missed, check row."""
    o = reg.table("orders")
    r = RC.verify_counts({"orders": (o, o.filter(F.col("o_orderstatus") != "P"))})
    return r.select("table_name", "source_count", "target_count", F.col("validation_status").alias("verdict"), "missed",
                    F.when(F.col("validation_status") == "MATCH", "pass").otherwise("fail").alias("check_status"))


BATCH_TABLES = ["region", "nation", "customer", "supplier", "orders", "lineitem", "stg_missing"]


@query("verify_batch", oracle="""
SELECT table_name, source_count, target_count, CASE WHEN source_count IS NULL THEN 'error'
  WHEN source_count = target_count THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM (
  SELECT 'region' AS table_name, (SELECT COUNT(*) FROM region) AS source_count,
    (SELECT COUNT(*) FROM region) AS target_count
  UNION ALL SELECT 'nation', (SELECT COUNT(*) FROM nation), (SELECT COUNT(*) FROM nation)
  UNION ALL SELECT 'customer', (SELECT COUNT(*) FROM customer), (SELECT COUNT(*) FROM customer)
  UNION ALL SELECT 'supplier', (SELECT COUNT(*) FROM supplier), (SELECT COUNT(*) FROM supplier)
  UNION ALL SELECT 'orders', (SELECT COUNT(*) FROM orders), (SELECT COUNT(*) FROM orders)
  UNION ALL SELECT 'lineitem', (SELECT COUNT(*) FROM lineitem),
    (SELECT COUNT(*) FROM lineitem WHERE l_returnflag <> 'R')
  UNION ALL SELECT 'stg_missing', NULL, NULL) x""")
def verify_batch(reg):
    """Many tables in one job; a table that cannot be read becomes an `error` row and the rest go on."""
    pairs, missing = {}, []
    for t in BATCH_TABLES:
        if not reg.exists(t):
            missing.append(t)
            continue
        src = reg.table(t)
        tgt = src.filter(F.col("l_returnflag") != "R") if t == "lineitem" else src
        pairs[t] = (src, tgt)
    ok = RC.verify_counts(pairs).select("table_name", "source_count", "target_count",
                                        F.col("validation_status").alias("verdict"))
    err = reg.spark.createDataFrame([(t, None, None, "error") for t in missing],
                                    "table_name string, source_count long, target_count long, verdict string")
    return ok.unionByName(err)


ATTEMPTS_SQL = """SELECT user_id AS table_name, ts AS attempted_at, CAST(ROUND(value * 100) AS BIGINT) AS cnt,
  event_type <> 'error' AS ok FROM events"""


@query("count_cache_keep_good", oracle=f"""
WITH a AS ({ATTEMPTS_SQL})
SELECT table_name, arg_max(cnt, attempted_at) FILTER (WHERE ok) AS last_good_count,
  MAX(attempted_at) FILTER (WHERE ok) AS last_good_at, NOT arg_max(ok, attempted_at) AS stale FROM a GROUP BY table_name""")
def count_cache_keep_good(reg):
    """On a failed refresh keep the last good count and mark it stale (events as count attempts)."""
    e = reg.table("events")
    a = e.select(F.col("user_id").alias("table_name"), F.col("ts").alias("attempted_at"),
                 F.round(F.col("value") * 100).cast("long").alias("cnt"), (F.col("event_type") != "error").alias("ok"))
    return RC.keep_last_good(a, "table_name", "attempted_at", "cnt", "ok")


@query("reconciliation_report", oracle=S.with_ctes(S.JOBS_CTE, S.RUNS_CTE, S.COUNTS_CTE) + """,
lr AS (SELECT job_id, status, duration_sec FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id
  ORDER BY created_at DESC, run_id DESC) AS rn FROM job_runs) WHERE rn = 1)
SELECT c.table_name, lr.status AS last_status, s.source_count, s.target_count, s.source_count - s.target_count AS missed,
  CASE WHEN s.source_count IS NULL OR s.target_count IS NULL THEN 'PENDING'
       WHEN s.source_count = s.target_count THEN 'MATCH' ELSE 'MISMATCH' END AS verdict, lr.duration_sec
FROM job_catalogue c LEFT JOIN lr ON c.job_id = lr.job_id LEFT JOIN source_counts s ON c.job_id = s.job_id""")
def reconciliation_report(reg):
    """Per table: latest run, counts, missed, verdict, duration."""
    runs = S.job_runs(reg)
    lr = latest_by(runs.withColumn("_o", F.struct("created_at", "run_id")), "job_id", "_o", ["status", "duration_sec"])
    c = S.job_catalogue(reg).select("table_name", "job_id")
    j = c.join(lr, "job_id", "left").join(S.source_counts(reg), "job_id", "left")
    r = RC.reconcile(j)
    return r.select("table_name", F.col("status").alias("last_status"), "source_count", "target_count", "missed",
                    F.col("validation_status").alias("verdict"), "duration_sec")


@query("run_report", oracle="SELECT 'lineitem' AS table_name, COUNT(*) AS checks, COUNT(*) FILTER (WHERE status = 'fail') AS failed, "
       "string_agg(check_name || '=' || status, ',' ORDER BY check_name) AS check_rows FROM (" + LINEITEM_CHECKS_SQL + ")")
def run_report(reg):
    """One run with all of its checks nested (bounded: a run has a handful of checks)."""
    checks = lineitem_checks(reg)
    return checks.agg(F.lit("lineitem").alias("table_name"), F.count(F.lit(1)).alias("checks"),
                      F.count_if(F.col("status") == "fail").alias("failed"),
                      F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "check_name", "status"))), ",").alias("check_rows"))


@query("key_coverage", oracle=S.with_ctes(S.CATALOGUE_CTE) + """
SELECT CASE WHEN pk IS NOT NULL AND length(pk) > 0 THEN 'pk' WHEN marker IS NOT NULL AND cutoff IS NOT NULL
  THEN 'watermark' ELSE 'full' END AS repair_mode, COUNT(*) AS tables,
  COUNT(*) FILTER (WHERE pk IS NOT NULL) AS with_key, COUNT(*) FILTER (WHERE pk IS NULL) AS without_key
FROM catalogue GROUP BY 1""")
def key_coverage(reg):
    """Tables with / without a key, per repair mode."""
    from kestrel.sources.loads import repair_mode

    c = S.table_catalogue(reg)
    return (c.groupBy(repair_mode(F.col("pk"), F.col("marker"), F.col("cutoff")).alias("repair_mode"))
            .agg(F.count(F.lit(1)).alias("tables"), F.count_if(F.col("pk").isNotNull()).alias("with_key"),
                 F.count_if(F.col("pk").isNull()).alias("without_key")))


DECLARED_KEYS = [("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_linenumber"),
                 ("lineitem", "l_lineid"), ("customer", "c_custkey"), ("customer", "c_uuid"), ("events", "event_id")]
LOST_KEYS = [("lineitem", "l_lineid"), ("customer", "c_uuid")]


@query("key_columns_missing", oracle=" UNION ALL ".join(f"""
SELECT '{t}' AS table_name, '{c}' AS column_name, there, COUNT(*) AS rows, COUNT(*) FILTER (WHERE NOT there OR v IS NULL) AS rows_without
FROM (SELECT (SELECT COUNT(*) FROM information_schema.columns WHERE table_name = '{t}' AND column_name = '{c}') > 0 AS there, {c if (t, c) not in LOST_KEYS else 'NULL'} AS v FROM {t})
GROUP BY there HAVING rows_without > 0""" for t, c in DECLARED_KEYS))
def key_columns_missing(reg):
    """Declared key columns that a table does not have, or that some of its rows leave empty, with the rows concerned."""
    return RC.missing_keys({t: reg.table(t) for t in {t for t, _ in DECLARED_KEYS}}, DECLARED_KEYS)


@query("model_check")
def model_check(reg):
    """Issue rows for two models: one joining lineitem by order without allow_fanout (fan-out error)
    plus an INNER join (warning) and a nullable key (warning), and the AR model (only warnings)."""
    bad = ModelSpec("order_lines_unchecked", (attr("o_orderkey", "orders", is_pk=True), attr("l_quantity", "lineitem"),
                                              attr("c_name", "customer")),
                    (JoinSpec("orders", "o_orderkey", "lineitem", "l_orderkey"),
                     JoinSpec("orders", "o_custkey", "customer", "c_custkey", how="inner")))
    return run_model_check(reg.spark, reg, bad).unionByName(run_model_check(reg.spark, reg, AR_MODEL))


@query("pk_null_warning", oracle="""
SELECT 'customer' AS table_name, COUNT(*) FILTER (WHERE c_custkey IS NULL) AS pk_nulls FROM customer
UNION ALL SELECT 'orders', COUNT(*) FILTER (WHERE o_orderkey IS NULL) FROM orders
UNION ALL SELECT 'labels', COUNT(*) FILTER (WHERE doc_id IS NULL) FROM labels""")
def pk_null_warning(reg):
    """Count of NULL primary-key values per table."""
    parts = [pk_null_count(reg.table(t), k).select(F.lit(t).alias("table_name"), "pk_nulls")
             for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("labels", "doc_id"))]
    return reduce(DataFrame.unionByName, parts)
