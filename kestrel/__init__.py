"""kestrel: a Spark-native engine for declarative business data models.

Layout:
  sources/    table registry, loads, snapshots, validated JSON ingest
  plans/      model specs (projection + lookup joins + newest-row dedup) and their checks
  functions/  the five aggregation primitives and shared scalar expressions
  operators/  filters, joins, windows, reports, incremental pulls, reconciliation, backfill
  streaming/  Structured Streaming variants of ingest and incremental loads
  catalog/    every registered query with its DuckDB oracle SQL
"""

from kestrel.session import build_session, work_dir  # noqa: F401
