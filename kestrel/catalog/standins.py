"""Stand-in inputs derived from the driver tables, in the schema each job expects.

Each stand-in exists twice: a Spark builder (what the registered query reads) and the same rows as a
DuckDB CTE (what the oracle reads). They only rename, project and label rows; none of them does any
of a job's work. FIXTURES.md §6 gives the role of each driver table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.sources.tables import TableRegistry



def ntz_null():
    return F.lit(None).cast("timestamp_ntz")


def days30():
    return F.expr("INTERVAL 30 DAYS")


# ------------------------------------------------------------------ procurement (orders/customer/lineitem)
def po_header(reg: TableRegistry) -> DataFrame:
    return reg.table("orders").select(
        F.col("o_orderkey").alias("po_no"), F.col("o_custkey").alias("supplier_code"),
        F.col("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("po_status"),
        F.col("o_totalprice").alias("total_amount"), F.col("o_orderpriority").alias("buyer_code"),
        F.substring("o_orderpriority", 3, 20).alias("buyer_name"), (F.col("o_custkey") % 7).cast("string").alias("company_code"),
        (F.col("o_custkey") % 25).cast("string").alias("branch_plant"), F.lit("USD").alias("currency"), F.col("o_orderdate").alias("updated_at"))


def po_supplier(reg: TableRegistry) -> DataFrame:
    return reg.table("customer").select(
        F.col("c_custkey").alias("supplier_code"), F.col("c_name").alias("supplier_name"),
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("tax_code"), F.col("c_mktsegment").alias("supplier_type"),
        F.col("c_nationkey").cast("string").alias("country"), F.lit(None).cast("string").alias("city"),
        F.when(F.col("c_acctbal") < 0, "blocked").otherwise("active").alias("status"), ntz_null().alias("updated_at"))


def po_line(reg: TableRegistry) -> DataFrame:
    li = reg.table("lineitem")
    text = lambda c: F.col(c).cast("string")
    return li.select(
        F.concat(text("l_orderkey"), F.lit("-"), text("l_linenumber")).alias("po_line_id"), F.col("l_orderkey").alias("po_no"),
        F.col("l_linenumber").alias("line_no"), text("l_partkey").alias("item_code"), F.lit(None).cast("string").alias("item_description"),
        F.lit("EA").alias("uom"), F.col("l_quantity").alias("quantity_ordered"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.lit(0.0)).alias("quantity_received"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_cost"), F.col("l_extendedprice").alias("line_amount"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("line_status"),
        F.col("l_shipdate").cast("date").alias("promised_date"), F.col("l_shipdate").alias("updated_at"))


def po_invoice(reg: TableRegistry) -> DataFrame:
    li = reg.table("lineitem")
    return li.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("invoice_no"),
        F.col("l_suppkey").alias("supplier_code"),
        F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_orderkey")).alias("po_no"),
        F.col("l_shipdate").cast("date").alias("invoice_date"), F.date_add(F.col("l_shipdate").cast("date"), 30).alias("due_date"),
        F.lit("USD").alias("currency"), F.col("l_extendedprice").alias("gross_amount"),
        F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(F.lit(0.0)).alias("open_amount"),
        F.when(F.col("l_linestatus") == "O", "unpaid").otherwise("paid").alias("payment_status"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("posted").alias("invoice_status"), F.col("l_shipdate").alias("updated_at"))


PO_CTES = """
po_header AS (SELECT o_orderkey AS po_no, o_custkey AS supplier_code, o_orderdate AS order_date,
  o_orderstatus AS po_status, o_totalprice AS total_amount, o_orderpriority AS buyer_code,
  substr(o_orderpriority, 3, 20) AS buyer_name, CAST(o_custkey % 7 AS VARCHAR) AS company_code,
  CAST(o_custkey % 25 AS VARCHAR) AS branch_plant, 'USD' AS currency, o_orderdate AS updated_at FROM orders),
po_supplier AS (SELECT c_custkey AS supplier_code, c_name AS supplier_name, 'T' || c_custkey AS tax_code,
  c_mktsegment AS supplier_type, CAST(c_nationkey AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS city,
  CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE 'active' END AS status, CAST(NULL AS TIMESTAMP) AS updated_at FROM customer),
po_line AS (SELECT l_orderkey || '-' || l_linenumber AS po_line_id, l_orderkey AS po_no, l_linenumber AS line_no,
  CAST(l_partkey AS VARCHAR) AS item_code, CAST(NULL AS VARCHAR) AS item_description, 'EA' AS uom, l_quantity AS quantity_ordered,
  CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END AS quantity_received, l_extendedprice / l_quantity AS unit_cost,
  l_extendedprice AS line_amount, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'closed' END AS line_status,
  CAST(l_shipdate AS DATE) AS promised_date, l_shipdate AS updated_at FROM lineitem),
po_invoice AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS invoice_no, l_suppkey AS supplier_code,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_orderkey END AS po_no, CAST(l_shipdate AS DATE) AS invoice_date,
  CAST(l_shipdate AS DATE) + 30 AS due_date, 'USD' AS currency, l_extendedprice AS gross_amount,
  CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0.0 END AS open_amount,
  CASE WHEN l_linestatus = 'O' THEN 'unpaid' ELSE 'paid' END AS payment_status,
  CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'posted' END AS invoice_status, l_shipdate AS updated_at FROM lineitem)"""


# ------------------------------------------------------------------ accounting
def acc_invoice(reg: TableRegistry) -> DataFrame:
    o = reg.table("orders")
    return o.select(
        F.col("o_orderkey").alias("invoice_no"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("issue_date"), (F.col("o_orderdate") + days30()).alias("due_date"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "open")
        .otherwise("partial").alias("status"))


def acc_receipt(reg: TableRegistry) -> DataFrame:
    o = reg.table("orders").filter(F.col("o_orderstatus") == "F")
    return o.select(F.col("o_orderkey").alias("receipt_no"), F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderdate").alias("receipt_date"), F.col("o_totalprice").alias("amount"),
                    F.col("o_orderpriority").alias("method"))


def acc_bill(reg: TableRegistry) -> DataFrame:
    li = reg.table("lineitem")
    return li.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("bill_no"),
        F.col("l_suppkey").alias("vendor_id"), F.col("l_shipdate").alias("issue_date"),
        (F.col("l_shipdate") + days30()).alias("due_date"), F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_linestatus") == "F", "paid").otherwise("open").alias("status"))


def acc_payment(reg: TableRegistry) -> DataFrame:
    li = reg.table("lineitem").filter(F.col("l_returnflag") == "R")
    return li.select(F.col("l_suppkey").alias("vendor_id"), F.col("l_shipdate").alias("payment_date"),
                     F.col("l_extendedprice").alias("amount"), F.col("l_linestatus").alias("method"))


def acc_journal(reg: TableRegistry) -> DataFrame:
    li = reg.table("lineitem")
    return li.select(F.col("l_linestatus").alias("account_type"), F.col("l_extendedprice").alias("debit"),
                     (F.col("l_extendedprice") * F.col("l_discount")).alias("credit"))


def acc_customer(reg: TableRegistry) -> DataFrame:
    c, n, r = reg.table("customer"), reg.table("nation"), reg.table("region")
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
            .select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
                    F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")))


def acc_vendor(reg: TableRegistry) -> DataFrame:
    s, n = reg.table("supplier"), reg.table("nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"), F.col("n_name").alias("category"))


ACC_CTES = """
acc_invoice AS (SELECT o_orderkey AS invoice_no, o_custkey AS customer_id, o_orderdate AS issue_date,
  o_orderdate + INTERVAL 30 DAY AS due_date, o_totalprice AS amount,
  CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'partial' END AS status
  FROM orders),
acc_receipt AS (SELECT o_orderkey AS receipt_no, o_custkey AS customer_id, o_orderdate AS receipt_date,
  o_totalprice AS amount, o_orderpriority AS method FROM orders WHERE o_orderstatus = 'F'),
acc_bill AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS bill_no,
  l_suppkey AS vendor_id, l_shipdate AS issue_date, l_shipdate + INTERVAL 30 DAY AS due_date,
  l_extendedprice AS amount, CASE WHEN l_linestatus = 'F' THEN 'paid' ELSE 'open' END AS status FROM lineitem),
acc_payment AS (SELECT l_suppkey AS vendor_id, l_shipdate AS payment_date, l_extendedprice AS amount,
  l_linestatus AS method FROM lineitem WHERE l_returnflag = 'R'),
acc_journal AS (SELECT l_linestatus AS account_type, l_extendedprice AS debit, l_extendedprice * l_discount AS credit
  FROM lineitem),
acc_customer AS (SELECT c_custkey AS customer_id, c_name AS customer_name, r_name AS region,
  c_mktsegment AS segment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey),
acc_vendor AS (SELECT s_suppkey AS vendor_id, s_name AS vendor_name, n_name AS category
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


# ------------------------------------------------------------------ state tables (catalogue, config, runs, counts)
def table_catalogue(reg: TableRegistry) -> DataFrame:
    """One catalogue row per part: a table name, module, kind, flags (part as catalogue)."""
    p = reg.table("part")
    return p.select(
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")).alias("table_name"),
        F.col("p_partkey").alias("pos"),
        F.when(F.col("p_type") == "PROMO", F.lit(None)).otherwise(F.col("p_type")).alias("module"),
        F.col("p_brand").alias("owner"),
        F.when(F.col("p_size") <= 25, "A").otherwise("B").alias("model_type"),
        (F.col("p_retailprice") >= 950).alias("active"),
        F.when(F.col("p_size") > 40, F.lit(None)).otherwise(F.concat(F.lit("id_"), F.col("p_type"))).alias("pk"),
        F.when(F.col("p_type") == "SMALL", F.lit(None)).otherwise(F.lit("updated_at")).alias("marker"),
        (F.col("p_size") <= 10).alias("is_sequence"),
        F.when(F.col("p_size") > 45, 0).otherwise(F.col("p_size") * 1000).alias("interval_sec"),
        (F.col("p_retailprice") < 990).alias("enabled"),
        F.when((F.col("p_type") == "MEDIUM") & (F.col("p_size") > 25), ntz_null()).otherwise(
            F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.col("p_size"))
        ).alias("last_run_at"),
        F.when(F.col("p_brand") < "Brand#2", F.lit(None)).otherwise(F.lit(124100)).alias("cutoff"),
        F.col("p_size").alias("rows_hint"),
    )


CATALOGUE_CTE = """
catalogue AS (SELECT replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS table_name,
  p_partkey AS pos, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS module,
  p_brand AS owner, CASE WHEN p_size <= 25 THEN 'A' ELSE 'B' END AS model_type, p_retailprice >= 950 AS active,
  CASE WHEN p_size > 40 THEN NULL ELSE 'id_' || p_type END AS pk,
  CASE WHEN p_type = 'SMALL' THEN NULL ELSE 'updated_at' END AS marker, p_size <= 10 AS is_sequence,
  CASE WHEN p_size > 45 THEN 0 ELSE p_size * 1000 END AS interval_sec, p_retailprice < 990 AS enabled,
  CASE WHEN p_type = 'MEDIUM' AND p_size > 25 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' - to_hours(p_size) END
    AS last_run_at,
  CASE WHEN p_brand < 'Brand#2' THEN NULL ELSE 124100 END AS cutoff, p_size AS rows_hint FROM part)"""


def job_catalogue(reg: TableRegistry) -> DataFrame:
    """One replicated table per events user: its job, key/marker config, cadence and last run."""
    e = reg.table("events")
    n = lambda t: F.count_if(F.col("event_type") == t)
    g = e.groupBy(F.col("user_id").alias("job_id")).agg(
        n("purchase").alias("_p"), n("view").alias("_v"), n("signup").alias("_s"), n("click").alias("_c"),
        n("error").alias("_e"), F.avg("value").alias("_a"), F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_run_at"))
    return g.select(
        F.concat(F.lit("job_"), F.col("job_id").cast("string")).alias("table_name"), "job_id",
        (F.col("_p") >= F.col("_v")).alias("enabled"),
        F.when(F.col("_s") > F.col("_c"), F.lit(None)).otherwise(F.lit("event_id")).alias("pk"),
        F.when(F.col("_e") > F.col("_p"), F.lit(None)).otherwise(F.lit("ts")).alias("marker"),
        (F.col("_a") > 50).alias("is_sequence"), (F.col("_n") * 10).alias("interval_sec"), "last_run_at")


JOBS_CTE = """
job_catalogue AS (SELECT 'job_' || CAST(user_id AS VARCHAR) AS table_name, user_id AS job_id,
  COUNT(*) FILTER (WHERE event_type = 'purchase') >= COUNT(*) FILTER (WHERE event_type = 'view') AS enabled,
  CASE WHEN COUNT(*) FILTER (WHERE event_type = 'signup') > COUNT(*) FILTER (WHERE event_type = 'click') THEN NULL
       ELSE 'event_id' END AS pk,
  CASE WHEN COUNT(*) FILTER (WHERE event_type = 'error') > COUNT(*) FILTER (WHERE event_type = 'purchase') THEN NULL
       ELSE 'ts' END AS marker,
  AVG(value) > 50 AS is_sequence, COUNT(*) * 10 AS interval_sec,
  MAX(ts) FILTER (WHERE event_type <> 'error') AS last_run_at FROM events GROUP BY user_id)"""


def job_runs(reg: TableRegistry) -> DataFrame:
    """events as run history: job = user, failed when the event is an error, watermark = event id."""
    e = reg.table("events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("run_id"),
                    F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
                    F.col("ts").alias("created_at"), F.col("event_id").alias("to_watermark"),
                    F.col("value").alias("duration_sec"))


RUNS_CTE = """
job_runs AS (SELECT user_id AS job_id, event_id AS run_id,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts AS created_at,
  event_id AS to_watermark, value AS duration_sec FROM events)"""


def source_counts(reg: TableRegistry) -> DataFrame:
    """Per job (user): a source count, a target count, count mode and replication flag, from events."""
    e = reg.table("events")
    return e.groupBy(F.col("user_id").alias("job_id")).agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(F.col("event_type") != "error").alias("target_count"),
        F.when(F.count_if(F.col("event_type") == "signup") > 15, "estimate").otherwise("exact").alias("count_mode"),
        (F.count_if(F.col("event_type") == "purchase") > 12).alias("replicating"),
    )


COUNTS_CTE = """
source_counts AS (SELECT user_id AS job_id, COUNT(*) AS source_count,
  COUNT(*) FILTER (WHERE event_type <> 'error') AS target_count,
  CASE WHEN COUNT(*) FILTER (WHERE event_type = 'signup') > 15 THEN 'estimate' ELSE 'exact' END AS count_mode,
  COUNT(*) FILTER (WHERE event_type = 'purchase') > 12 AS replicating FROM events GROUP BY user_id)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"
