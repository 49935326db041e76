"""Join queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.catalog import standins as S
from kestrel.catalog.base import query
from kestrel.catalog.models import AR_MODEL, CHAIN_MODEL, LATEST_ORDER_MODEL
from kestrel.operators import aggregates as A
from kestrel.operators import joins as J
from kestrel.operators.incremental import sync_mode, upsert_key_rule
from kestrel.operators.reconcile import source_verdict, tolerance
from kestrel.operators.windows import latest_by
from kestrel.plans.check import schema_issues
from kestrel.plans.model import JoinSpec, ModelSpec, attr, build_model
from kestrel.sources.tables import DRIVER_TABLES


@query("join_left_lookup", oracle="""
SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_left_lookup(reg):
    """orders ⟕ customer through the AR model; every base row is kept."""
    return build_model(reg, AR_MODEL, needed=["o_orderkey", "o_totalprice", "c_name", "c_mktsegment"])


@query("join_inner_lookup", oracle="""
SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM orders o
JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o.o_custkey = c.c_custkey""")
def join_inner_lookup(reg):
    """INNER variant against a lookup that lacks rows (building-segment customers): unmatched orders vanish."""
    reg.register("customer_building", reg.table("customer").filter(F.col("c_mktsegment") == "BUILDING"))
    spec = ModelSpec("orders_building", (attr("o_orderkey", "orders", is_pk=True), attr("o_totalprice", "orders"),
                                         attr("c_name", "customer_building")),
                     (JoinSpec("orders", "o_custkey", "customer_building", "c_custkey", how="inner"),))
    return build_model(reg, spec)


@query("join_chain", oracle="""
SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice, o.o_orderdate, c.c_name, n.n_name, r.r_name
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def join_chain(reg):
    """lineitem → orders → customer → nation → region, joins declared out of order."""
    return build_model(reg, CHAIN_MODEL)


@query("join_fanout_guard", oracle="""
SELECT l_orderkey, COUNT(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey HAVING COUNT(*) > 1""")
def join_fanout_guard(reg):
    """orders → lineitem on l_orderkey would fan out: the offending right keys."""
    return J.fanout_keys(reg.table("lineitem"), "l_orderkey")


@query("join_allow_fanout", oracle="""
SELECT o.o_orderkey, o.o_orderstatus, l.l_linenumber, l.l_quantity
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def join_allow_fanout(reg):
    """allow_fanout permits the 1:N join (a warning, not an error)."""
    spec = ModelSpec("order_lines", (attr("o_orderkey", "orders", is_pk=True), attr("o_orderstatus", "orders"),
                                     attr("l_linenumber", "lineitem"), attr("l_quantity", "lineitem")),
                     (JoinSpec("orders", "o_orderkey", "lineitem", "l_orderkey", allow_fanout=True),))
    return build_model(reg, spec)


@query("join_latest", oracle="""
WITH o AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey
             ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS FIRST) rn FROM orders) WHERE rn = 1),
     c AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey
             ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC NULLS FIRST) rn FROM customer) WHERE rn = 1)
SELECT o.o_custkey, o.o_orderkey, o.o_orderdate, o.o_totalprice, c.c_name, c.c_mktsegment
FROM o LEFT JOIN c ON o.o_custkey = c.c_custkey""")
def join_latest(reg):
    """Each table reduced to its newest row per key (orders by customer), then joined 1:1."""
    return build_model(reg, LATEST_ORDER_MODEL)


@query("join_conflict_check")
def join_conflict_check(reg):
    """Identical second edge -> warning; different edge to a joined table -> error (plan-time)."""
    base = (attr("o_orderkey", "orders", is_pk=True), attr("c_name", "customer"))
    same = JoinSpec("orders", "o_custkey", "customer", "c_custkey")
    other = JoinSpec("orders", "o_orderkey", "customer", "c_custkey")
    rows = []
    for label, joins in (("duplicate", (same, same)), ("conflict", (same, other))):
        rows += [(label, *r) for r in schema_issues(reg, ModelSpec(label, base, joins))
                 if r[1] in ("duplicate_join", "join_conflict")]
    issues = reg.spark.createDataFrame(rows, "spec string, level string, code string, message string")
    # the spec with the ignored duplicate edge still builds, with exactly the base rows
    built = build_model(reg, ModelSpec("duplicate", base, (same, same))).agg(F.count(F.lit(1)).alias("n"))
    base_rows = reg.table("orders").select(F.count(F.lit(1))).scalar()
    check = built.select(F.lit("duplicate").alias("spec"),
                         F.when(F.col("n") == base_rows, "info").otherwise("error").alias("level"),
                         F.lit("model_rows").alias("code"),
                         F.concat(F.lit("rows="), F.col("n").cast("string"), F.lit(" base_rows="),
                                  base_rows.cast("string")).alias("message"))
    return issues.unionByName(check)


@query("join_type_check")
def join_type_check(reg):
    """Key columns must share a platform type: text c_name joined to integer o_custkey is rejected."""
    spec = ModelSpec("bad_types", (attr("o_orderkey", "orders", is_pk=True), attr("c_name", "customer")),
                     (JoinSpec("orders", "o_custkey", "customer", "c_name"),))
    from kestrel.plans.check import model_check

    return model_check(reg.spark, reg, spec).filter(
        F.col("code").isin("join_type_mismatch", "fanout", "pk_not_unique", "pk_nulls"))


@query("join_outer_by_field", oracle="""
WITH a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
             CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(38,10))), 2) AS DOUBLE) AS ordered FROM orders GROUP BY 1),
     b AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
             CAST(ROUND(SUM(CAST(l_extendedprice AS DECIMAL(38,10))), 2) AS DOUBLE) AS shipped FROM lineitem GROUP BY 1)
SELECT COALESCE(a.month, b.month) AS month, a.ordered, b.shipped,
  CAST(ROUND(CAST(a.ordered AS DECIMAL(38,4)) - CAST(b.shipped AS DECIMAL(38,4)), 2) AS DOUBLE) AS diff
FROM a FULL OUTER JOIN b ON a.month = b.month""")
def join_outer_by_field(reg):
    """Monthly ordered vs shipped, full outer on month; diff NULL where one side is missing."""
    from kestrel.operators.reports import monthly

    a = monthly(reg.table("orders"), "o_orderdate", "o_totalprice", "ordered")
    b = monthly(reg.table("lineitem"), "l_shipdate", "l_extendedprice", "shipped")
    return J.outer_by_field(a, b, "month", "diff", "ordered", "shipped")


@query("join_missing_rows", oracle="""
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')""")
def join_missing_rows(reg):
    """Source rows absent from a target that was loaded only up to 1999 (anti-join on the key)."""
    src = reg.table("orders").select("o_orderkey", "o_orderdate")
    tgt = src.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return J.missing_rows(src, tgt, ["o_orderkey"])


FK_CHECKS = [("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"),
             ("lineitem.l_suppkey", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
             ("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"),
             ("customer.c_nationkey", "customer", "c_nationkey", "nation", "n_nationkey")]


@query("join_orphan_fk", oracle=" UNION ALL ".join(
    f"SELECT '{n}' AS fk, COUNT(*) AS orphans FROM {ft} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {dk} FROM {dt})"
    for n, ft, fk, dt, dk in FK_CHECKS))
def join_orphan_fk(reg):
    """Facts whose FK has no dimension row, per FK (acceptance: 0)."""
    parts = [J.orphan_fk(reg.table(ft), fk, reg.table(dt), dk).agg(F.count(F.lit(1)).alias("orphans"))
             .select(F.lit(n).alias("fk"), "orphans") for n, ft, fk, dt, dk in FK_CHECKS]
    return reduce(DataFrame.unionByName, parts)


@query("join_existence")
def join_existence(reg):
    """Expected tables ⟕ actual counts ⟕ defined models: exists?, rows, has a model."""
    expected = list(DRIVER_TABLES) + ["stg_supplier_missing", "stg_invoice_missing"]
    present = [t for t in expected if reg.exists(t)]
    exp = reg.spark.createDataFrame([(t,) for t in expected], "table_name string")
    counts = A.table_counts({t: reg.table(t) for t in present})
    models = reg.spark.createDataFrame([(t, True) for t in ("orders", "lineitem", "customer")],
                                       "table_name string, has_model boolean")
    return J.existence(exp, "table_name", counts, models)


def status_grid_sql(extra: tuple[tuple[str, str], ...] = ()) -> str:
    """The status grid in SQL; ``extra`` (catalogue column, output name) pairs are carried through."""
    carry = "".join(f"c.{col} AS {name}, " for col, name in extra)
    out = "".join(f"{name}, " for _, name in extra)
    return S.with_ctes(S.JOBS_CTE, S.RUNS_CTE, S.COUNTS_CTE) + f""",
last_run AS (SELECT job_id, status AS last_status, created_at AS last_run_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY created_at DESC, run_id DESC) AS rn FROM job_runs)
  WHERE rn = 1),
g AS (SELECT {carry}c.table_name, c.enabled, c.job_id, c.pk, c.marker, c.is_sequence, l.last_status, l.last_run_at,
  s.source_count, s.target_count, s.count_mode, COALESCE(s.replicating, false) AS replicating
  FROM job_catalogue c LEFT JOIN last_run l ON c.job_id = l.job_id LEFT JOIN source_counts s ON c.job_id = s.job_id)
SELECT {out}table_name, enabled, job_id, last_status, last_run_at, source_count, target_count,
  CASE WHEN source_count IS NULL THEN 'PENDING'
       WHEN count_mode = 'exact' AND target_count IS NULL THEN 'PENDING'
       WHEN count_mode = 'exact' AND abs(source_count - target_count) <=
            (CASE WHEN replicating THEN GREATEST(50, CAST(FLOOR(CAST(source_count AS DOUBLE) * CAST(0.0001 AS DOUBLE))
                                                          AS BIGINT)) ELSE 0 END)
         THEN 'MATCH'
       WHEN count_mode = 'exact' THEN 'MISMATCH' ELSE 'ESTIMATE' END AS verdict,
  CASE WHEN marker IS NOT NULL AND (CASE WHEN pk IS NOT NULL AND length(pk) > 0 THEN pk
       WHEN marker IS NOT NULL AND is_sequence THEN marker END) IS NOT NULL THEN 'incremental' ELSE 'full' END AS mode
FROM g"""


STATUS_GRID_ORACLE = status_grid_sql()


def status_grid(reg) -> DataFrame:
    cat = S.job_catalogue(reg).drop("last_run_at", "interval_sec")
    runs = S.job_runs(reg)
    last = latest_by(runs.withColumn("_o", F.struct("created_at", "run_id")), "job_id", "_o",
                     ["status", "created_at"]).select("job_id", F.col("status").alias("last_status"),
                                                      F.col("created_at").alias("last_run_at"))
    counts = S.source_counts(reg)
    g = (cat.join(last, "job_id", "left").join(counts, "job_id", "left")
         .withColumn("replicating", F.coalesce("replicating", F.lit(False))))
    key = upsert_key_rule(F.col("pk"), F.col("marker"), F.col("is_sequence"))
    tol = tolerance(F.col("source_count"), F.col("replicating"))
    return g.select("table_name", "enabled", "job_id", "last_status", "last_run_at", "source_count", "target_count",
                    source_verdict(F.col("source_count"), F.col("count_mode"), F.lit(False), F.col("target_count"),
                                   tol).alias("verdict"),
                    sync_mode(F.col("marker"), key).alias("mode"))


@query("join_status_grid", oracle=STATUS_GRID_ORACLE)
def join_status_grid(reg):
    """catalogue ⟕ latest run ⟕ source count ⟕ config -> one status row per table (replaces N point reads)."""
    return status_grid(reg)


# Sort keys of the grid: (numeric value, text value) as SQL over it; next_run has its own class before them.
SORT_KEYS = {
    "name": ("NULL", "lower(table_name)"),
    "watermark": ("NULL", "lower(coalesce(marker, ''))"),
    "load_mode": ("NULL", "mode"),
    "status": ("NULL", "coalesce(verdict, last_status, '')"),
    "latest_run": ("epoch_of(last_run_at)", "NULL"),
    "next_run": ("epoch_of(cat_last_run_at) + greatest(0, interval_sec)", "NULL"),
    "rows": ("coalesce(target_count, -1)", "NULL"),
}
SORT_CLASS = "CASE WHEN NOT enabled THEN 2 WHEN cat_last_run_at IS NULL THEN 1 ELSE 0 END"


def sort_value(key: str, engine: str) -> tuple[str, str, str]:
    """(class, number, text) by which ``key`` sorts, in the SQL of ``spark`` or ``duckdb``."""
    seconds = {"spark": "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})", "duckdb": "date_diff('second', TIMESTAMP '1970-01-01', {})"}[engine]
    number, text = SORT_KEYS[key]
    number = re.sub(r"epoch_of\((\w+)\)", lambda m: seconds.format(m[1]), number)
    string = {"spark": "STRING", "duckdb": "VARCHAR"}[engine]
    return SORT_CLASS if key == "next_run" else "0", f"CAST({number} AS BIGINT)", f"CAST({text} AS {string})"


def sorted_grid(grid: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """The whole grid by one of ``SORT_KEYS``: a range-partitioned sort of all rows, ties by name. Sorted by next
    run, never-run rows stand behind the others and disabled ones last."""
    cls, number, text = map(F.expr, sort_value(key, "spark"))
    way = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    return grid.orderBy(cls, way(number), way(text), "table_name")


@query("sort_multi_key", oracle="WITH g AS (" + status_grid_sql((("interval_sec", "interval_sec"), ("last_run_at", "cat_last_run_at"), ("marker", "marker")))
       + ") " + " UNION ALL ".join("SELECT '{}' AS sort_key, table_name, {} AS sort_class, {} AS sort_number, {} AS sort_text FROM g".format(k, *sort_value(k, "duckdb")) for k in SORT_KEYS))
def sort_multi_key(reg):
    """The whole grid under each of its seven sort keys, in that order."""
    grid = status_grid(reg)
    cfg = S.job_catalogue(reg).select("table_name", "interval_sec", "marker", F.col("last_run_at").alias("cat_last_run_at"))
    g = grid.join(cfg, "table_name")
    each = [g.select(F.lit(k).alias("sort_key"), "table_name", *[F.expr(v).alias(n) for v, n in zip(sort_value(k, "spark"), ("sort_class", "sort_number", "sort_text"))])
            for k in SORT_KEYS]
    return reduce(DataFrame.unionByName, each).orderBy("sort_key", "sort_class", F.col("sort_number").asc_nulls_last(), F.col("sort_text").asc_nulls_last(), "table_name")
