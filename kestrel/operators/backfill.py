"""Time-shift backfill: move created/updated timestamps by a number of hours, with a guard log.

The shift is a column expression over the whole table written as a new snapshot version; the log
(table, hours, cutoff) makes a second apply a no-op and lets ``reverse`` undo exactly what was logged.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.scalars import shift_hours
from kestrel.sources.snapshots import SnapshotStore

LOG_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("hours", T.IntegerType()),
    T.StructField("cutoff", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("at", T.TimestampNTZType()),
])


def shift_frame(df: DataFrame, columns: list[str], hours: int, cutoff: str | None = None,
                cutoff_col: str | None = None) -> DataFrame:
    """Shift ``columns`` by ``hours`` for all rows, or only rows with ``cutoff_col < cutoff``."""
    cond = F.lit(True) if cutoff is None else (F.col(cutoff_col or columns[0]) < F.lit(cutoff).cast("timestamp_ntz"))
    return df.select(*[F.when(cond, shift_hours(c, hours)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def dry_run(df: DataFrame, columns: list[str], cutoff: str | None = None, cutoff_col: str | None = None) -> DataFrame:
    cond = F.lit(True) if cutoff is None else (F.col(cutoff_col or columns[0]) < F.lit(cutoff).cast("timestamp_ntz"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(cond).alias("rows_to_shift"))


def _log(store: SnapshotStore, spark, table: str, hours: int, cutoff: str | None, action: str, rows: int):
    store.append_rows("backfill__log", spark.createDataFrame(
        [(table, hours, cutoff, action, rows, _dt.datetime.now(_dt.UTC).replace(tzinfo=None))], LOG_SCHEMA))


def applied(store: SnapshotStore, table: str) -> list:
    log = store.read_log("backfill__log")
    if log is None:
        return []
    return log.filter((F.col("table_name") == table) & (F.col("action") == "apply")) \
        .orderBy(F.col("at").desc()).limit(1).collect()


def reversed_after(store: SnapshotStore, table: str) -> bool:
    log = store.read_log("backfill__log")
    if log is None:
        return False
    last = log.filter(F.col("table_name") == table).orderBy(F.col("at").desc()).limit(1).collect()
    return bool(last) and last[0]["action"] == "reverse"


def apply(store: SnapshotStore, table: str, columns: list[str], hours: int, cutoff: str | None = None,
          cutoff_col: str | None = None) -> dict:
    """Shift once. A table already shifted (and not reversed since) is skipped."""
    if applied(store, table) and not reversed_after(store, table):
        return {"table": table, "status": "skipped", "reason": "already shifted"}
    df = store.read(table)
    res = store.swap(table, shift_frame(df, columns, hours, cutoff, cutoff_col))
    _log(store, df.sparkSession, table, hours, cutoff, "apply", res["rows_after"])
    return {"table": table, "status": "applied", "rows": res["rows_after"]}


def reverse(store: SnapshotStore, table: str, columns: list[str]) -> dict:
    """Subtract the logged hours; refuse when the apply used a cutoff (the shifted rows are unknown)."""
    last = applied(store, table)
    if not last or reversed_after(store, table):
        return {"table": table, "status": "skipped", "reason": "nothing to reverse"}
    if last[0]["cutoff"] is not None:
        return {"table": table, "status": "refused", "reason": "apply used a cutoff"}
    df = store.read(table)
    res = store.swap(table, shift_frame(df, columns, -int(last[0]["hours"])))
    _log(store, df.sparkSession, table, -int(last[0]["hours"]), None, "reverse", res["rows_after"])
    return {"table": table, "status": "reversed", "rows": res["rows_after"]}
