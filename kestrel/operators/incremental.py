"""Incremental pulls: cursor predicates, key and mode rules, the pull -> insert -> advance cycle.

Every "stream" of the original is a poll: build a predicate from the stored cursor, pull the rows
(the predicate reaches the parquet scan), insert rows whose key is absent, then advance the cursor
to the *target's* max marker. The cursor is written after the data commit, so a crash between the
two only re-pulls rows that insert-if-absent then ignores.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kestrel.functions.scalars import julian_cutoff
from kestrel.session import staged

# Cadence floors and defaults, in seconds.
MIN_INTERVAL = 2
INCREMENTAL_DEFAULT_INTERVAL = 60
FULL_RELOAD_MIN_INTERVAL = 43200
FULL_RELOAD_DEFAULT_INTERVAL = 86400


# ------------------------------------------------------------------ predicates
def pull_sequence(marker: str, cursor: int | None) -> Column:
    """Assign-once ids: strictly greater than the cursor, no lookback; no cursor = 0."""
    return F.col(marker) > F.lit(cursor or 0)


def day_cutoff_integer(cursor: int | None, lookback_days: int) -> int:
    """The original rule: plain integer subtraction on the day number; NULL cursor = 0, no lookback."""
    if cursor is None:
        return 0
    return int(cursor) - max(0, int(lookback_days or 0))


def pull_day_lookback(marker: str, cursor: int | None, lookback_days: int = 1, calendar: bool = True) -> Column:
    """``marker >= cursor - lookback``. ``calendar=True`` does the subtraction on CYYDDD dates so it
    crosses year ends (124001 - 1 day = 123365); ``False`` keeps plain integer arithmetic."""
    if cursor is None:
        return F.col(marker) >= F.lit(0)
    if calendar:
        return F.col(marker) >= julian_cutoff(F.lit(int(cursor)), max(0, int(lookback_days or 0)))
    return F.col(marker) >= F.lit(day_cutoff_integer(cursor, lookback_days))


def pull_date_lookback(marker: str, cursor: str | None, lookback_days: int = 1) -> Column:
    """Day lookback on a real date/timestamp marker: ``marker >= date(cursor) - lookback``."""
    if cursor is None:
        return F.lit(True)
    cut = F.date_sub(F.lit(cursor).cast("date"), max(0, int(lookback_days or 0)))
    return F.col(marker) >= cut.cast("timestamp_ntz")


def pull_day_time(day_col: str, time_col: str | None, cursor_day: int | None, cursor_time: int | None,
                  lookback_days: int = 1) -> Column:
    """``(day > d) OR (day = d AND time >= t)`` when a time column is set, else day mode."""
    if not time_col:
        return pull_day_lookback(day_col, cursor_day, lookback_days, calendar=False)
    d, t = int(cursor_day or 0), int(cursor_time or 0)
    return (F.col(day_col) > d) | ((F.col(day_col) == d) & (F.col(time_col) >= t))


def pull_overlap(marker: str, cursor: str | None, strategy: str, overlap: int = 0, unit: str = "days") -> Column:
    """``greater_than_last_watermark`` or ``greater_equal_last_watermark_with_overlap``."""
    if cursor is None:
        return F.lit(True)
    c = F.lit(cursor).cast("timestamp_ntz")
    if strategy == "greater_than_last_watermark":
        return F.col(marker) > c
    if strategy == "greater_equal_last_watermark_with_overlap":
        iv = F.make_dt_interval(F.lit(overlap)) if unit == "days" else F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(overlap))
        return F.col(marker) >= c - iv
    raise ValueError(f"unknown strategy {strategy}")


# ------------------------------------------------------------------ config rules (column expressions)
def upsert_key_rule(pk: Column, marker: Column, is_sequence: Column) -> Column:
    """Effective key: the PK if any; else the marker when it is a sequence; else NULL (full reload)."""
    has_pk = pk.isNotNull() & (F.length(pk) > 0)
    return (F.when(has_pk, pk).when(marker.isNotNull() & is_sequence, marker).otherwise(F.lit(None)))


def upsert_key_kind(pk: Column, marker: Column, is_sequence: Column) -> Column:
    has_pk = pk.isNotNull() & (F.length(pk) > 0)
    return F.when(has_pk, "primary_key").when(marker.isNotNull() & is_sequence, "marker")


def sync_mode(marker: Column, key: Column) -> Column:
    return F.when(marker.isNotNull() & key.isNotNull(), "incremental").otherwise("full")


def sync_interval(mode: Column, interval: Column) -> Column:
    """incremental: max(2, interval or 60); full reload: max(43200, interval or 86400)."""
    iv = F.when(interval == 0, None).otherwise(interval)
    return (F.when(mode == "full", F.greatest(F.lit(FULL_RELOAD_MIN_INTERVAL),
                                              F.coalesce(iv, F.lit(FULL_RELOAD_DEFAULT_INTERVAL))))
            .otherwise(F.greatest(F.lit(MIN_INTERVAL), F.coalesce(iv, F.lit(INCREMENTAL_DEFAULT_INTERVAL)))))


def sync_due(enabled: Column, last_run: Column, interval_sec: Column, now: Column) -> Column:
    """Enabled and (never run, or now - last_run >= interval)."""
    elapsed = F.timestamp_diff("SECOND", last_run, now)
    return enabled & (last_run.isNull() | (elapsed >= interval_sec))


def job_watermark(runs: DataFrame, job_col: str, status_col: str, at_col: str, wm_col: str) -> DataFrame:
    """Per job: ``to_watermark`` of the last successful run; last run time over all runs."""
    ok = F.col(status_col) == "success"
    return runs.groupBy(job_col).agg(
        F.max_by(F.when(ok, F.col(wm_col)), F.when(ok & F.col(wm_col).isNotNull(), F.col(at_col))).alias(
            "last_successful_watermark"),
        F.max(F.when(ok, F.col(at_col))).alias("last_successful_run_at"),
        F.max(at_col).alias("last_run_at"),
    )


def future_marker_audit(df: DataFrame, marker: str, as_of: Column) -> DataFrame:
    """Rows whose marker is later than ``as_of`` (they would move the cursor past unread rows)."""
    return df.filter(F.col(marker) > as_of)


def cursor_from_target(target: DataFrame, marker: str) -> Column:
    """Cursor = target's max marker, 0 when the target is empty (scalar subquery)."""
    return F.coalesce(target.select(F.max(marker)).scalar(), F.lit(0))


# ------------------------------------------------------------------ the cycle (driver-side control, Spark data path)
# Cursor values by type: how they are written to the state file and read back.
CURSOR_TYPES: dict[str, tuple[type, Callable[[str], Any]]] = {
    "long": (int, int),
    "decimal": (decimal.Decimal, decimal.Decimal),
    "double": (float, float),
    "timestamp": (dt.datetime, dt.datetime.fromisoformat),
    "date": (dt.date, dt.date.fromisoformat),
    "text": (str, str),
}


def packed_cursor(value):
    """A cursor as JSON that keeps its type; a (day, time) pair as a list of two."""
    if value is None:
        return None
    if isinstance(value, (tuple, list)):
        return [packed_cursor(v) for v in value]
    kind = next(k for k, (t, _) in CURSOR_TYPES.items() if isinstance(value, t))
    return {"type": kind, "value": str(value)}


def unpacked_cursor(stored):
    if stored is None:
        return None
    if isinstance(stored, list):
        return tuple(unpacked_cursor(v) for v in stored)
    return CURSOR_TYPES[stored["type"]][1](stored["value"])


class CursorState:
    """Per-table cursor + the config it was computed under, stored next to the table's snapshots.

    Written with an atomic rename *after* the data is committed, so a crash in between only
    means the next cycle re-pulls rows that insert-if-absent ignores.
    """

    def __init__(self, store):
        self.store = store

    def _path(self, table: str) -> str:
        return f"{self.store.root}/{table}/_cursor.json"

    def get(self, table: str) -> dict | None:
        text = self.store.fs.read_text(self._path(table))
        if text is None:
            return None
        state = json.loads(text)
        return {**state, "cursor": unpacked_cursor(state.get("cursor"))}

    def put(self, table: str, state: dict) -> None:
        self.store.fs.mkdirs(f"{self.store.root}/{table}")
        self.store.fs.write_text_atomic(self._path(table), json.dumps({**state, "cursor": packed_cursor(state.get("cursor"))}))

    def reset_if_changed(self, table: str, marker: str, kind: str) -> bool:
        """Marker column or kind changed -> clear the cursor (the next cycle starts from the target)."""
        cur = self.get(table)
        if cur is not None and (cur.get("marker") != marker or cur.get("kind") != kind):
            self.put(table, {**cur, "cursor": None, "marker": marker, "kind": kind, "status": "reset"})
            return True
        return False


@dataclass(frozen=True)
class Pull:
    """How a cycle finds new rows. ``kind``:

    - ``sequence``: assign-once numbers, strictly above the cursor;
    - ``date``: a date or timestamp, from the cursor's day less ``lookback_days``;
    - ``day_number``: CYYDDD numbers, likewise, across year ends;
    - ``day_time``: a day number and, in ``time_col``, a time: pairs from the cursor's on;
    - ``after`` and ``overlap``: a timestamp above the cursor, or from ``overlap`` ``unit`` before it.
    """

    kind: str
    marker: str
    time_col: str | None = None
    lookback_days: int = 1
    overlap: int = 0
    unit: str = "days"

    def predicate(self, cursor) -> Column:
        if cursor is None:  # nothing loaded yet: the first cycle is the initial full load
            return F.lit(True)
        if self.kind == "sequence":
            return pull_sequence(self.marker, cursor)
        if self.kind == "date":
            return pull_date_lookback(self.marker, str(cursor), self.lookback_days)
        if self.kind == "day_number":
            return pull_day_lookback(self.marker, int(cursor), self.lookback_days)
        if self.kind == "day_time":
            return pull_day_time(self.marker, self.time_col, *cursor)
        strategy = {"after": "greater_than_last_watermark", "overlap": "greater_equal_last_watermark_with_overlap"}[self.kind]
        return pull_overlap(self.marker, str(cursor), strategy, self.overlap, self.unit)

    def latest(self, cap_at=None) -> Column:
        """Maximum marker (or pair) of an aggregate, of markers up to ``cap_at``."""
        at = F.col(self.marker)
        value = F.struct(at.alias("day"), F.col(self.time_col).alias("time")) if self.kind == "day_time" else at
        return F.max(F.when(at.isNotNull() if cap_at is None else at <= F.lit(cap_at), value))

    def name(self) -> str:
        return f"{self.marker},{self.time_col}" if self.time_col else self.marker


def _plain(value):
    return tuple(value) if isinstance(value, Row) else value


def run_cycle(store, table: str, source: DataFrame, marker: str, key: list[str], kind: str = "sequence", lookback_days: int = 1,
              mode: str = "insert_only", cap_at=None, time_col: str | None = None, overlap: int = 0, unit: str = "days",
              slices: int = 8, stamp: bool = False) -> dict:
    """cursor -> predicate -> pull -> insert-if-absent (or upsert) -> commit -> advance the cursor.

    What is pulled is written down first, and everything else is made of that copy, the new cursor included: rows that
    arrive meanwhile are above it and come with the next cycle. The table is cut into ``slices`` hash slices of its key. A
    cycle writes only the new rows; ``mode="update"`` replaces stored rows whose key comes again and writes the slices that
    hold them anew. A changed marker or kind resets the cursor to the target's own maximum. ``cap_at`` bounds the new
    cursor (e.g. the run's clock), so a future-dated marker cannot move it past rows that have not arrived yet. ``stamp``
    adds the audit columns to what the cycle writes. Rows without a key are logged, not loaded. Any failure leaves the
    cursor as it was and records the whole message.
    """
    from kestrel.sources.loads import insert_new, stamp_audit, upsert_slices
    from kestrel.sources.snapshots import Slices

    pull = Pull(kind, marker, time_col, lookback_days, overlap, unit)
    state = CursorState(store)
    state.reset_if_changed(table, pull.name(), kind)
    st = state.get(table) or {}
    cursor = st.get("cursor")
    try:
        if cursor is None and store.exists(table):  # start from the loaded target
            cursor = _plain(store.read(table).agg(pull.latest(cap_at)).first()[0])
        delta = source.filter(pull.predicate(cursor))
        run_id = None
        if stamp:
            delta, run_id = stamp_audit(delta)
        delta = staged(delta, "delta")
        seen = _plain(delta.agg(pull.latest(cap_at)).first()[0])
        if mode == "update" and store.exists(table):
            res = upsert_slices(store, table, delta, key, marker, written=True)
        else:
            res = insert_new(store, table, delta, key, [marker], Slices("hash", tuple(key), slices), written=True)
        cursor = max((c for c in (cursor, seen) if c is not None), default=None)
    except Exception as exc:  # recorded; the cursor does not move
        state.put(table, {**st, "marker": pull.name(), "kind": kind, "status": "failed", "error": str(exc)})
        raise
    state.put(table, {"cursor": cursor, "marker": pull.name(), "kind": kind, "status": "success"})
    return {**res, "cursor": cursor, "run_id": run_id}
