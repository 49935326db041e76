"""Curated report queries: procurement summary, accounting panels, dashboards, KPIs."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.catalog import standins as S
from kestrel.catalog.base import query
from kestrel.catalog.joins import STATUS_GRID_ORACLE, status_grid
from kestrel.functions.scalars import money_avg
from kestrel.operators import aggregates as A
from kestrel.operators import filters as FL
from kestrel.operators import reports as R
from kestrel.sources.tables import DRIVER_TABLES


def money_sql(x: str) -> str:
    return f"CAST(ROUND(SUM(CAST({x} AS DECIMAL(38,10))), 2) AS DOUBLE)"


def exact_sql(x: str) -> str:
    return f"CAST(SUM(CAST(COALESCE({x}, 0) AS DECIMAL(38,10))) AS DOUBLE)"


# One long list of what belongs to an order (a row per line and invoice: its kind, number, two amounts, whether it is open,
# when it was touched), summed once per order and kind.
FACTS_SQL = f"""facts AS (
  SELECT 'line' AS kind, po_no, po_line_id AS number, quantity_ordered AS whole, quantity_received AS part, line_status = 'open' AS is_open, updated_at AS touched FROM po_line
  UNION ALL SELECT 'invoice', po_no, invoice_no, gross_amount, open_amount, NULL, updated_at FROM po_invoice),
sums AS (SELECT kind, po_no, COUNT(DISTINCT number) AS numbers, {exact_sql('whole')} AS whole, {exact_sql('part')} AS part,
  COUNT(*) FILTER (is_open) AS open_rows, MAX(touched) AS touched FROM facts GROUP BY kind, po_no)"""
PO_SUMMARY_SQL = S.with_ctes(S.PO_CTES, FACTS_SQL) + """,
touched AS (SELECT po_no, MAX(touched) AS updated_at FROM (
  SELECT po_no, touched FROM sums UNION ALL SELECT po_no, updated_at FROM po_header
  UNION ALL SELECT po_no, s.updated_at FROM po_header JOIN po_supplier s USING (supplier_code)) GROUP BY po_no),
by_kind AS (SELECT po_no, MAP_FROM_ENTRIES(LIST((kind, {'numbers': numbers, 'whole': whole, 'part': part, 'open_rows': open_rows}))) AS of FROM sums WHERE po_no IS NOT NULL GROUP BY po_no),
summary AS (SELECT h.po_no, h.supplier_code, s.supplier_name, h.buyer_code, h.buyer_name, h.company_code, h.branch_plant, h.currency, h.order_date,
  h.po_status, h.total_amount, coalesce(of['line'].numbers, 0) AS line_count, coalesce(of['line'].whole, 0) AS total_ordered_quantity,
  coalesce(of['line'].part, 0) AS total_received_quantity, coalesce(of['line'].open_rows, 0) AS open_line_count,
  coalesce(of['invoice'].numbers, 0) AS invoice_count, coalesce(of['invoice'].whole, 0) AS total_invoice_amount,
  coalesce(of['invoice'].part, 0) AS total_open_invoice_amount,
  coalesce(['unknown', 'paid', 'open'][sign(of['invoice'].part)::INT + 2], 'no_invoice') AS payment_status_summary, t.updated_at
  FROM po_header h LEFT JOIN po_supplier s ON s.supplier_code = h.supplier_code LEFT JOIN by_kind USING (po_no) LEFT JOIN touched t USING (po_no))
"""


def summary(reg) -> DataFrame:
    return R.po_summary(S.po_header(reg), S.po_supplier(reg), S.po_line(reg), S.po_invoice(reg))


@query("agg_line_summary", oracle=S.with_ctes(S.PO_CTES, FACTS_SQL) + """
SELECT po_no, numbers AS line_count, whole AS total_ordered_quantity, part AS total_received_quantity, open_rows AS open_line_count,
  touched AS lines_updated_at FROM sums WHERE kind = 'line'""")
def agg_line_summary(reg):
    """Per order: distinct lines, ordered / received quantity, open lines, last update."""
    return R.line_summary(S.po_line(reg))


@query("agg_invoice_summary", oracle=S.with_ctes(S.PO_CTES, FACTS_SQL) + """
SELECT po_no, numbers AS invoice_count, whole AS total_invoice_amount, part AS total_open_invoice_amount, touched AS invoices_updated_at
FROM sums WHERE kind = 'invoice' AND po_no IS NOT NULL""")
def agg_invoice_summary(reg):
    """Per order with a non-null order number: invoices, gross, open, last update."""
    return R.invoice_summary(S.po_invoice(reg))


@query("po_summary", oracle=PO_SUMMARY_SQL + "SELECT * FROM summary")
def po_summary(reg):
    """header ⟕ supplier ⟕ line summary ⟕ invoice summary, one row per header."""
    return summary(reg)


@query("payment_status_case", oracle=PO_SUMMARY_SQL + """
SELECT payment_status_summary, COUNT(*) AS orders FROM summary GROUP BY payment_status_summary""")
def payment_status_case(reg):
    """no_invoice / paid / open / unknown over the summary, counted per status."""
    return summary(reg).groupBy("payment_status_summary").agg(F.count(F.lit(1)).alias("orders"))


# ------------------------------------------------------------------ state-grid KPIs
@query("replication_kpis", oracle="""
SELECT COUNT(*) AS tables_total, COUNT(*) FILTER (WHERE enabled) AS replicating,
  COUNT(*) FILTER (WHERE verdict = 'MATCH') AS matched,
  COUNT(*) FILTER (WHERE verdict = 'MISMATCH' OR last_status = 'failed' OR (verdict <> 'MATCH' AND source_count > target_count)) AS needs_attention,
  COUNT(*) FILTER (WHERE verdict = 'PENDING') AS awaiting_verify FROM (""" + STATUS_GRID_ORACLE + ") grid")
def replication_kpis(reg):
    """Totals over the status grid: tables, replicating (enabled), MATCH, needing attention (a mismatch, a failed run,
    or rows missed under another verdict than MATCH), awaiting verify."""
    grid = status_grid(reg)
    missed = (F.col("verdict") != "MATCH") & (F.col("source_count") > F.col("target_count"))
    return grid.agg(F.count(F.lit(1)).alias("tables_total"), F.count_if("enabled").alias("replicating"),
                    F.count_if(F.col("verdict") == "MATCH").alias("matched"),
                    F.count_if((F.col("verdict") == "MISMATCH") | (F.col("last_status") == "failed") | missed).alias("needs_attention"),
                    F.count_if(F.col("verdict") == "PENDING").alias("awaiting_verify"))


@query("tables_by_module", oracle=S.with_ctes(S.CATALOGUE_CTE) + """
SELECT COALESCE(module, 'Other') AS module, table_name, pos, MIN(pos) OVER (PARTITION BY COALESCE(module, 'Other')) AS first_pos
FROM catalogue ORDER BY first_pos, pos""")
def tables_by_module(reg):
    """Every table with its module (NULL module = Other), modules in the order first seen, tables in theirs."""
    cat = S.table_catalogue(reg).withColumn("module", F.coalesce("module", F.lit("Other")))
    first = cat.groupBy("module").agg(F.min("pos").alias("first_pos"))
    return cat.join(first, "module").select("module", "table_name", "pos", "first_pos").orderBy("first_pos", "pos")


@query("model_kpis", oracle=S.with_ctes(S.CATALOGUE_CTE) + """
SELECT COUNT(*) AS models, COUNT(*) FILTER (WHERE model_type = 'A') AS type_a,
  COUNT(*) FILTER (WHERE model_type = 'B') AS type_b, COUNT(*) FILTER (WHERE active) AS active,
  COUNT(*) FILTER (WHERE NOT active) AS inactive FROM catalogue""")
def model_kpis(reg):
    cat = S.table_catalogue(reg)
    return cat.agg(F.count(F.lit(1)).alias("models"), F.count_if(F.col("model_type") == "A").alias("type_a"),
                   F.count_if(F.col("model_type") == "B").alias("type_b"), F.count_if("active").alias("active"),
                   F.count_if(~F.col("active")).alias("inactive"))


# ------------------------------------------------------------------ accounting dashboard
ACC = S.with_ctes(S.ACC_CTES)


@query("acc_kpi", oracle=ACC + """, t AS (SELECT (SELECT SUM(CAST(amount AS DECIMAL(38,10))) FROM acc_invoice) AS rev,
  (SELECT SUM(CAST(amount AS DECIMAL(38,10))) FROM acc_bill) AS cost)
SELECT CAST(ROUND(rev, 2) AS DOUBLE) AS revenue, CAST(ROUND(cost, 2) AS DOUBLE) AS cost,
  CAST(ROUND(rev - cost, 2) AS DOUBLE) AS gross_profit, ROUND(CAST(rev - cost AS DOUBLE) / CAST(rev AS DOUBLE), 4) AS margin FROM t""")
def acc_kpi(reg):
    """Revenue, cost, gross profit and margin (a ratio) from two separately summed facts."""
    return R.kpi(S.acc_invoice(reg), S.acc_bill(reg))


@query("acc_rev_cost_month", oracle=ACC + f""",
a AS (SELECT CAST(date_trunc('month', issue_date) AS DATE) AS month, {money_sql('amount')} AS revenue
      FROM acc_invoice GROUP BY 1),
b AS (SELECT CAST(date_trunc('month', issue_date) AS DATE) AS month, {money_sql('amount')} AS cost
      FROM acc_bill GROUP BY 1)
SELECT COALESCE(a.month, b.month) AS month, revenue, cost,
  CAST(ROUND(CAST(revenue AS DECIMAL(38,2)) - CAST(cost AS DECIMAL(38,2)), 2) AS DOUBLE) AS profit
FROM a FULL OUTER JOIN b ON a.month = b.month""")
def acc_rev_cost_month(reg):
    a = R.monthly(S.acc_invoice(reg), "issue_date", "amount", "revenue")
    b = R.monthly(S.acc_bill(reg), "issue_date", "amount", "cost")
    return R.series_diff(a, b, "revenue", "cost", "profit")


@query("acc_rev_by_region", oracle=ACC + f"""
SELECT c.region, {money_sql('i.amount')} AS revenue FROM acc_invoice i LEFT JOIN acc_customer c
ON i.customer_id = c.customer_id GROUP BY c.region""")
def acc_rev_by_region(reg):
    return R.sum_by_dim(S.acc_invoice(reg), "customer_id", S.acc_customer(reg), ["region"], "amount", "revenue")


@query("acc_cost_by_category", oracle=ACC + f"""
SELECT v.category, {money_sql('b.amount')} AS cost FROM acc_bill b LEFT JOIN acc_vendor v
ON b.vendor_id = v.vendor_id GROUP BY v.category""")
def acc_cost_by_category(reg):
    return R.sum_by_dim(S.acc_bill(reg), "vendor_id", S.acc_vendor(reg), ["category"], "amount", "cost")


@query("acc_invoice_status", oracle=ACC + "SELECT status, COUNT(*) AS invoices FROM acc_invoice GROUP BY status")
def acc_invoice_status(reg):
    return S.acc_invoice(reg).groupBy("status").agg(F.count(F.lit(1)).alias("invoices"))


@query("acc_top_customers", oracle=ACC + f"""
SELECT i.customer_id, c.customer_name, {money_sql('i.amount')} AS revenue, COUNT(i.invoice_no) AS invoices
FROM acc_invoice i LEFT JOIN acc_customer c ON i.customer_id = c.customer_id
GROUP BY i.customer_id, c.customer_name ORDER BY revenue DESC NULLS LAST, customer_id, customer_name LIMIT 10""")
def acc_top_customers(reg):
    return R.top_parties(S.acc_invoice(reg), "customer_id", S.acc_customer(reg), "customer_name", "amount", "invoice_no",
                         "revenue", "invoices")


@query("acc_top_vendors", oracle=ACC + f"""
SELECT b.vendor_id, v.vendor_name, {money_sql('b.amount')} AS cost, COUNT(b.bill_no) AS bills
FROM acc_bill b LEFT JOIN acc_vendor v ON b.vendor_id = v.vendor_id
GROUP BY b.vendor_id, v.vendor_name ORDER BY cost DESC NULLS LAST, vendor_id, vendor_name LIMIT 10""")
def acc_top_vendors(reg):
    return R.top_parties(S.acc_bill(reg), "vendor_id", S.acc_vendor(reg), "vendor_name", "amount", "bill_no", "cost",
                         "bills")


@query("acc_cash_flow", oracle=ACC + f""",
a AS (SELECT CAST(date_trunc('month', receipt_date) AS DATE) AS month, {money_sql('amount')} AS cash_in
      FROM acc_receipt GROUP BY 1),
b AS (SELECT CAST(date_trunc('month', payment_date) AS DATE) AS month, {money_sql('amount')} AS cash_out
      FROM acc_payment GROUP BY 1)
SELECT COALESCE(a.month, b.month) AS month, cash_in, cash_out,
  CAST(ROUND(CAST(cash_in AS DECIMAL(38,2)) - CAST(cash_out AS DECIMAL(38,2)), 2) AS DOUBLE) AS net
FROM a FULL OUTER JOIN b ON a.month = b.month""")
def acc_cash_flow(reg):
    a = R.monthly(S.acc_receipt(reg), "receipt_date", "amount", "cash_in")
    b = R.monthly(S.acc_payment(reg), "payment_date", "amount", "cash_out")
    return R.series_diff(a, b, "cash_in", "cash_out", "net")


@query("acc_method_mix", oracle=ACC + f"SELECT method, {money_sql('amount')} AS amount FROM acc_receipt GROUP BY method")
def acc_method_mix(reg):
    return R.sum_by(S.acc_receipt(reg), ["method"], "amount", "amount")


def aging_sql(table: str, as_of: str) -> str:
    age = f"datediff('day', CAST(due_date AS DATE), DATE '{as_of}')"
    return ACC + f"""
SELECT bucket, amount FROM (
  SELECT CASE WHEN {age} <= 30 THEN '0-30' WHEN {age} <= 60 THEN '31-60' WHEN {age} <= 90 THEN '61-90'
         ELSE '90+' END AS bucket, {money_sql('amount')} AS amount, MIN({age}) AS m
  FROM {table} WHERE status <> 'paid' AND DATE '{as_of}' >= CAST(due_date AS DATE) GROUP BY 1) ORDER BY m"""


@query("acc_ar_aging", oracle=aging_sql("acc_invoice", "1999-06-30"))
def acc_ar_aging(reg):
    """Unpaid past-due receivables by bucket; the last label is '90+' on the dashboard."""
    return R.unpaid_aging(S.acc_invoice(reg), "due_date", "amount", "status", "1999-06-30")


@query("acc_ap_aging", oracle=aging_sql("acc_bill", "1999-06-30"))
def acc_ap_aging(reg):
    return R.unpaid_aging(S.acc_bill(reg), "due_date", "amount", "status", "1999-06-30")


@query("acc_trial_balance", oracle=ACC + """
SELECT account_type, CAST(ROUND(SUM(CAST(debit AS DECIMAL(38,10))) - SUM(CAST(credit AS DECIMAL(38,10))), 2) AS DOUBLE) AS balance FROM acc_journal GROUP BY account_type""")
def acc_trial_balance(reg):
    return R.trial_balance(S.acc_journal(reg))


# ------------------------------------------------------------------ operational dashboards
@query("site_stats", oracle="""
SELECT event_type AS site, COUNT(*) AS events, CAST(ROUND(AVG(CAST(value AS DECIMAL(38,10))), 2) AS DOUBLE) AS avg_value
FROM events GROUP BY event_type""")
def site_stats(reg):
    """Events and average value per site (event type as site)."""
    return reg.table("events").groupBy(F.col("event_type").alias("site")).agg(
        F.count(F.lit(1)).alias("events"), money_avg("value").alias("avg_value"))


@query("recent_events", oracle="""
WITH u AS (SELECT user_id, COUNT(*) AS user_events, MIN(ts) AS user_first_seen FROM events GROUP BY user_id)
SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, u.user_events, u.user_first_seen FROM events e
LEFT JOIN u ON e.user_id = u.user_id
WHERE e.ts >= TIMESTAMP '2024-01-10' AND e.ts <= TIMESTAMP '2024-01-25' ORDER BY e.ts DESC, e.event_id DESC LIMIT 500""")
def recent_events(reg):
    """Newest 500 events in a range, enriched with their user's totals (the user dimension)."""
    ev = reg.table("events")
    users = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_events"), F.min("ts").alias("user_first_seen"))
    e = FL.filter_time_range(ev, "ts", "2024-01-10", "2024-01-25")
    j = e.join(users, "user_id", "left").select("event_id", "ts", "user_id", "event_type", "value", "user_events",
                                                "user_first_seen")
    return FL.page(j, [F.col("ts").desc(), F.col("event_id").desc()], 500)


@query("table_sizes", oracle=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in DRIVER_TABLES))
def table_sizes(reg):
    """Row count per table, largest first."""
    return A.table_counts({t: reg.table(t) for t in DRIVER_TABLES}).orderBy(F.col("row_count").desc(), "table_name")


@query("recent_log", oracle="SELECT event_id, ts, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_log(reg):
    e = reg.table("events").select("event_id", "ts", "event_type", "user_id")
    return FL.page(e, [F.col("ts").desc(), F.col("event_id").desc()], 50)
