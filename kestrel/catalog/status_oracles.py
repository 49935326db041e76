"""Oracles of queries whose rows are statuses, issues or counts: the expected rows, with every count taken from the tables."""

from __future__ import annotations

from kestrel.catalog import loads, reconcile
from kestrel.catalog.base import CATALOG
from kestrel.sources.tables import DRIVER_TABLES

FIRST = "FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'"
LAST = f"(SELECT strftime(MAX(o_orderdate), '%Y-%m-%d %H:%M:%S') {FIRST})"
ORDERS = "(SELECT COUNT(*) FROM orders)"


def rows(columns: str, *values: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({v})' for v in values)}) t({columns})"


ORACLES = {
    "row_count_estimate": " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_estimate FROM {t}" for t in DRIVER_TABLES),
    "cursor_advance": rows("step, cursor, status, target_max", f"'success', {LAST}, 'success', {LAST}", f"'failure', {LAST}, 'failed', {LAST}"),
    "cursor_reset": rows("step, cursor, reset, target_rows", f"'before', {LAST}, false, (SELECT COUNT(*) {FIRST})",
                         f"'after_change', CAST(NULL AS VARCHAR), true, (SELECT COUNT(*) {FIRST})"),
    "backfill_guard": rows("attempt, status", "'first', 'applied'", "'second', 'skipped'"),
    "backfill_reverse": rows("step, status, rows_differing", "'reverse_full_apply', 'reversed', CAST(0 AS BIGINT)", "'reverse_cutoff_apply', 'refused', NULL"),
    "nonempty_guard": rows("attempt, status, live_rows", f"'empty_copy', 'refused', {ORDERS}", f"'full_copy', 'published', {ORDERS}"),
    "matview_refresh": rows("model, status, rows, message", f"'ar_360', 'success', {ORDERS}, NULL", f"'ar_360', 'success', {ORDERS}, NULL",
                            "'bad_pk', 'failed', NULL, 'primary key o_custkey of bad_pk is not unique; build refused'"),
    "matview_rebuild_on_change": rows("step, status, snapshot_exists", "'same_spec', 'unchanged', false", "'changed_spec', 'success', false", "'disabled', 'dropped', false"),
    "join_type_check": rows("level, code, message", "'error', 'join_type_mismatch', 'orders.o_custkey (integer) vs customer.c_name (text)'"),
    "join_conflict_check": rows("spec, level, code, message", "'duplicate', 'warning', 'duplicate_join', 'duplicate join to customer ignored'",
                                "'conflict', 'error', 'join_conflict', 'conflicting second join to customer'",
                                f"'duplicate', 'info', 'model_rows', 'rows=' || {ORDERS} || ' base_rows=' || {ORDERS}"),
    "latest_recency_check": rows(
        "spec, level, code, message", *[f"'{s}', 'error', 'recency_column', '{m}'" for s, m in (
            ("missing_recency", "Recency column ''updated_at'' not found in orders"), ("missing_recency", "Recency column ''updated_at'' not found in customer"),
            ("text_recency", "Recency column ''o_orderstatus'' in orders is not sortable (text)"),
            ("text_recency", "Recency column ''c_name'' in customer is not sortable (text)"))],
        "'valid', 'ok', 'recency_column', 'all deduplicated tables have a sortable recency column'",
        "'valid', 'ok', 'one_row_per_key', 'rows=' || (SELECT COUNT(DISTINCT o_custkey) FROM orders)"),
    "join_existence": " UNION ALL ".join(
        [f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, true AS exists, {str(t in ('orders', 'lineitem', 'customer')).lower()} AS has_model FROM {t}" for t in DRIVER_TABLES]
        + [f"SELECT '{t}', NULL, false, false" for t in ("stg_supplier_missing", "stg_invoice_missing")]),
    "model_check": """
SELECT 'warning' AS level, 'pk_nullable' AS code, 'Primary key source column is nullable. Ensure values are unique and not null.' AS message FROM range(2)
UNION ALL SELECT 'warning', 'inner_join', 'INNER join to customer: unmatched base rows vanish'
UNION ALL SELECT 'error', 'fanout', 'join key lineitem.l_orderkey is not unique; set allow_fanout to permit 1:N'
  WHERE EXISTS (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1)
UNION ALL SELECT 'warning', 'inner_join_drop', 'INNER join to customer drops ' || n || ' base rows'
  FROM (SELECT COUNT(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) WHERE n > 0""",
    "export_csv": "SELECT table_name, last_status, CAST(source_count AS VARCHAR) AS source_count, CAST(target_count AS VARCHAR) AS target_count, "
                  "CAST(missed AS VARCHAR) AS missed, verdict, CAST(duration_sec AS VARCHAR) AS duration_sec FROM ("
                  + CATALOG.entries["reconciliation_report"].oracle + ")",
    "stamp_audit": "SELECT *, true AS stamped, CAST(1 AS BIGINT) AS runs FROM orders",
    "model_schema": loads.ACCEPT_SQL,
}
assert reconcile  # registers reconciliation_report
for key, sql in ORACLES.items():
    CATALOG.entries[key].oracle = sql
