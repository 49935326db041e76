"""Newest row per key over a growing table, kept up to date arrival by arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kestrel.operators.windows import latest_per_key
from kestrel.sources.loads import staged
from kestrel.sources.snapshots import NO_SLICE, Slices


def fold_newest(store, table: str, delta: DataFrame, key: list[str], recency: str, tiebreak: str | None = None, buckets: int = 64) -> dict:
    """Fold an arrival into the stored newest rows, one per key: the newest of (stored row, newest of the arrival).

    The newest of several is the same in whatever groups they are taken, so after any number of arrivals, in any order
    and with repeats, the table equals :func:`latest_per_key` over all rows that came. Ties beyond ``tiebreak`` keep
    either row. An arrival is reduced to a row per key and written down first; only the hash slices (``buckets``, a few
    gigabytes each) that hold its keys are read and written anew, so old arrivals are never read again. An empty
    arrival changes nothing. Null keys are one key, as there.
    """
    newest = staged(latest_per_key(delta, key, recency, tiebreak), "arrival")
    slices = Slices("hash", tuple(key), buckets)
    if not store.exists(table):
        return store.swap(table, newest, sort_within=key, slices=slices)
    if store.slices(table) != slices:
        raise ValueError(f"{table} is not cut into {buckets} hash slices of {', '.join(key)}")
    touched = [r[0] or NO_SLICE for r in newest.select(slices.value()).distinct().collect()]  # at most the buckets
    if not touched:
        rows = store.rows(table)
        return {"table": table, "rows_before": rows, "rows_after": rows, "rows_added": 0, "status": "success", "touched": []}
    stored = store.read(table, touched)
    return store.replace_slices(table, touched, latest_per_key(stored.unionByName(newest), key, recency, tiebreak), key)
