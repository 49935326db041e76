"""Time-shift backfill queries."""

from __future__ import annotations


from kestrel.catalog.base import query
from kestrel.catalog.incremental import sandbox
from kestrel.operators import backfill as B

COLS = ["event_id", "ts", "user_id", "event_type"]


@query("backfill_shift", oracle="""
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN ts + INTERVAL 7 HOUR ELSE ts END AS ts, user_id, event_type
FROM events""")
def backfill_shift(reg):
    """Shift created timestamps by +7 h for rows older than the cutoff; written as a new version."""
    store = sandbox(reg, "backfill-shift")
    store.swap("events", reg.table("events").select(*COLS))
    res = B.apply(store, "events", ["ts"], 7, cutoff="2024-01-15 00:00:00")
    if res["status"] != "applied":
        raise AssertionError(res)
    return store.read("events")


@query("backfill_dry_run", oracle="""
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS rows_to_shift FROM events""")
def backfill_dry_run(reg):
    """Dry run: how many rows a shift with this cutoff would touch."""
    return B.dry_run(reg.table("events"), ["ts"], cutoff="2024-01-15 00:00:00")


@query("backfill_guard", kind="S")
def backfill_guard(reg):
    """A second apply on an already shifted table is skipped (the log guards it)."""
    store = sandbox(reg, "backfill-guard")
    store.swap("events", reg.table("events").select(*COLS))
    first = B.apply(store, "events", ["ts"], 7)
    second = B.apply(store, "events", ["ts"], 7)
    rows = [("first", first["status"]), ("second", second["status"])]
    return reg.spark.createDataFrame(rows, "attempt string, status string")


@query("backfill_reverse", kind="S")
def backfill_reverse(reg):
    """Reverse subtracts the logged hours (restoring every row); a cutoff apply cannot be reversed."""
    spark = reg.spark
    orig = reg.table("events").select(*COLS)
    store = sandbox(reg, "backfill-reverse")
    store.swap("events", orig)
    B.apply(store, "events", ["ts"], 7)
    rev = B.reverse(store, "events", ["ts"])
    diff = store.read("events").join(orig, COLS, "left_anti").count()
    cut = sandbox(reg, "backfill-reverse-cutoff")
    cut.swap("events", orig)
    B.apply(cut, "events", ["ts"], 7, cutoff="2024-01-15 00:00:00")
    refused = B.reverse(cut, "events", ["ts"])
    rows = [("reverse_full_apply", rev["status"], diff), ("reverse_cutoff_apply", refused["status"], None)]
    return spark.createDataFrame(rows, "step string, status string, rows_differing long")
