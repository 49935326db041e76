"""Loads: full text snapshot, sampled and windowed loads, CSV export, audit stamps, key-based merges.

Without a table format there is no MERGE. Insert-style merges (insert-if-absent, key repair) compute
only the new rows with an anti-join, and ``SnapshotStore.append`` adds them to the table; upserts and
range repairs write only the slices of the table that they touch, to a new place. Merges into stored tables write
their delta down first, so that a source that grows meanwhile is read once.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.scalars import plain_number, wide
from kestrel.session import staged


def load_full_text(src: DataFrame) -> DataFrame:
    """Every column becomes text, numbers without an exponent; an empty string becomes NULL."""
    def text(name: str, kind: str) -> Column:
        plain = F.col(name).cast("string")
        if kind in ("double", "float"):
            digits = plain_number(wide(name))
            digits = F.when(F.contains(digits, F.lit(".")), digits).otherwise(F.concat(digits, F.lit(".0")))
            plain = F.when(F.contains(plain, F.lit("E")), F.coalesce(digits, plain)).otherwise(plain)
        return F.nullif(plain, F.lit("")).alias(name)
    return src.select(*[text(name, kind) for name, kind in src.dtypes])


def load_sample_rows(src: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """Row-limited trial load in the order of a unique key, so it is deterministic."""
    return src.orderBy(*[F.col(c).asc_nulls_last() for c in order_by]).limit(int(n))


def load_time_window(src: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """``start <= column <= end`` as typed literals of the column's type (pushed to the scan)."""
    dt = dict(src.dtypes)[column]
    cast = {"timestamp_ntz": "timestamp_ntz", "timestamp": "timestamp", "date": "date"}.get(dt, dt)
    return src.filter(F.col(column).between(F.lit(start).cast(cast), F.lit(end).cast(cast)))


def export_csv(report: DataFrame, path: str) -> None:
    """A report as one CSV file with a header. Its rows are made by as many tasks as they would be without the file; the
    one task that writes it streams finished rows and holds none (``coalesce(1)`` would make that task do all the work of
    the stage before)."""
    report.repartition(1).write.option("header", True).csv(path)


# The audit columns.
AUDIT_COLUMNS = ("_migrated_at", "_migrate_run_id")


def stamp_audit(df: DataFrame, run_id: str | None = None) -> tuple[DataFrame, str]:
    """Add ``_migrated_at`` (query clock) and ``_migrate_run_id`` (one uuid per run)."""
    rid = run_id or str(uuid.uuid4())
    out = df.withColumn("_migrated_at", F.current_timestamp()).withColumn("_migrate_run_id", F.lit(rid))
    return out, rid


def with_key(delta: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key has no NULL. The others can't be matched with a stored row: see :func:`without_key`."""
    return delta.filter(reduce(and_, [F.col(k).isNotNull() for k in key]))


def without_key(delta: DataFrame, key: list[str]) -> DataFrame:
    return delta.filter(reduce(or_, [F.col(k).isNull() for k in key]))


def one_per_key(delta: DataFrame, key: list[str], order_by: list[str] | None = None, newest: bool = False) -> DataFrame:
    """One row per key: the earliest by ``order_by``, or the ``newest``. Ties are decided by the other columns in
    order, so the winner does not depend on the order of arrival. Spark keeps at most one row per key and task before
    the shuffle (a window group limit)."""
    first = [c for c in order_by or [] if c not in key]
    ranked = [*first, *[c for c in delta.columns if c not in key and c not in first]]
    if not ranked:
        return delta.select(*key).distinct()
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() if newest else F.col(c).asc_nulls_last() for c in ranked])
    return delta.withColumn("_kestrel_rn", F.row_number().over(w)).filter("_kestrel_rn = 1").drop("_kestrel_rn")


def distinct_keys(keys: DataFrame) -> DataFrame:
    """The key set of a table for an anti-join, de-duplicated by a map-side-combined aggregate so a
    key repeated in a third of the rows reaches the join once per map task, not once per row."""
    return keys.distinct()


def insert_if_absent(target: DataFrame, delta: DataFrame, key: list[str], order_by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """ON CONFLICT DO NOTHING: (next table, inserted rows). Existing rows are left unchanged; rows whose key holds a
    NULL are not inserted. Only the target's key columns are read for the anti-join."""
    d = one_per_key(with_key(delta, key), key, order_by)
    new = d.join(distinct_keys(target.select(*key)), on=key, how="left_anti")
    return target.unionByName(new, allowMissingColumns=True), new


def _require_columns(store, table: str, delta: DataFrame) -> None:
    """New columns are welcome, but a delta that lacks one of the table's is refused (audit stamps aside)."""
    lost = [c for c in store.read(table).columns if c not in delta.columns and c not in AUDIT_COLUMNS] if store.exists(table) else []
    if lost:
        raise ValueError(f"the delta for {table} lacks {', '.join(lost)}")


def _hash_slices(store, table: str, delta: DataFrame, key: list[str]) -> list[str] | None:
    """The hash slices that hold the delta's keys, at most as many as the table has; None if it isn't cut by the key."""
    slices = store.slices(table)
    if slices is None or slices.kind != "hash" or list(slices.columns) != list(key):
        return None
    return [r[0] for r in with_key(delta, key).select(slices.value()).distinct().collect()]


def logged_rejects(store, table: str, delta: DataFrame, key: list[str]) -> int:
    """Append the rows without a key to the table's reject log, and count them."""
    rejected = without_key(delta, key)
    n = rejected.count()
    if n:
        store.append_rows(f"{table}__rejects", rejected)
    return n


def insert_new(store, table: str, delta: DataFrame, key: list[str], order_by: list[str] | None = None, slices=None, meta: dict | None = None,
               written: bool = False) -> dict:
    """:func:`insert_if_absent` on a stored table: only the new rows are written, and keys are looked up only in the
    slices that can hold them and, for a single key, in its range (parquet statistics skip the rest). The delta is written
    to a work folder first (unless ``written`` says that it lies in files already), so rejects, slices, key range and rows
    come from one read of the source. Rows without a key go to the table's reject log; ``rows_rejected`` counts them."""
    _require_columns(store, table, delta)
    delta = delta if written else staged(delta, "delta")
    n = logged_rejects(store, table, delta, key)
    target = store.read(table, _hash_slices(store, table, delta, key)) if store.exists(table) else delta.limit(0)
    if len(key) == 1:
        lo, hi = delta.agg(F.min(key[0]), F.max(key[0])).first()
        if lo is not None:
            target = target.filter(F.col(key[0]).between(F.lit(lo), F.lit(hi)))
    _, new = insert_if_absent(target, delta, key, order_by)
    return {**store.append(table, new, sort_within=key, slices=slices, meta=meta), "rows_rejected": n}


def upsert_update(target: DataFrame, delta: DataFrame, key: list[str], marker: str | None = None,
                  now: Column | None = None) -> DataFrame:
    """ON CONFLICT (key) DO UPDATE: of several delta rows with a key the newest by ``marker`` replaces the target's;
    rows whose key holds a NULL are left out. ``now`` overwrites the marker of what was written."""
    d = one_per_key(with_key(delta, key), key, [marker] if marker else None, newest=True)
    if marker and now is not None:
        d = d.withColumn(marker, now)
    kept = target.join(d.select(*key), on=key, how="left_anti")
    return kept.unionByName(d, allowMissingColumns=True)


def upsert_slices(store, table: str, delta: DataFrame, key: list[str], marker: str | None = None, written: bool = False) -> dict:
    """:func:`upsert_update` on a stored table, writing only the hash slices that hold the delta's keys anew; a table not
    cut by this key is written anew as a whole. The delta is written down first, as in :func:`insert_new`."""
    _require_columns(store, table, delta)
    delta = delta if written else staged(delta, "delta")
    n = logged_rejects(store, table, delta, key)
    touched = _hash_slices(store, table, delta, key)
    if touched == []:
        rows = store.rows(table)
        return {"table": table, "rows_before": rows, "rows_after": rows, "rows_added": 0, "status": "success", "metrics": {}, "rows_rejected": n}
    merged = upsert_update(store.read(table, touched), delta, key, marker)
    lost = [c for c in merged.columns if c not in store.read(table).columns]
    if touched is None or lost:  # not cut by the key, or more columns than the catalog knows
        return {**store.swap(table, upsert_update(store.read(table), delta, key, marker), sort_within=key), "rows_rejected": n}
    return {**store.replace_slices(table, touched, merged, key), "rows_rejected": n}


def replace_range(target: DataFrame, source: DataFrame, marker: str, cutoff: Column) -> DataFrame:
    """Watermark repair: drop target rows with marker >= cutoff, append source rows with marker >= cutoff."""
    keep = target.filter((F.col(marker) < cutoff) | F.col(marker).isNull())
    return keep.unionByName(source.select(*target.columns).filter(F.col(marker) >= cutoff))


def replace_range_slices(store, table: str, source: DataFrame, marker: str, cutoff) -> dict:
    """:func:`replace_range` on a stored table: ``cutoff`` is a value of the marker's type or its text. If the table is
    cut by the marker, only slices that reach the cutoff are read and written anew; else all of it is. The source's rows are written down first."""
    slices = store.slices(table)
    cut = F.lit(cutoff).cast(dict(store.read(table).dtypes)[marker])
    source = staged(source.filter(F.col(marker) >= cut), "delta")
    if slices is None or slices.kind == "hash" or slices.columns != (marker,):
        return store.swap(table, replace_range(store.read(table), source, marker, cut))
    fresh = [r[0] for r in source.select(slices.value()).distinct().collect()]  # at most the table's slices
    touched = sorted({n for n in store.slice_names(table) if n != "__HIVE_DEFAULT_PARTITION__" and slices.reaches(n, cutoff)} | set(fresh))
    return store.replace_slices(table, touched, replace_range(store.read(table, touched), source, marker, cut))


def repair_missing(source: DataFrame, target: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Key repair: re-read the source, insert only rows the target lacks. (next table, inserted). Rows without a whole
    key can't be told apart from stored ones and are left out."""
    new = with_key(source.select(*target.columns), key).join(distinct_keys(target.select(*key)), on=key, how="left_anti")
    return target.unionByName(new), new


def repair_mode(pk: Column, marker: Column, cutoff: Column) -> Column:
    """pk when a key is known; watermark when a marker and a cutoff exist; else full."""
    has_pk = pk.isNotNull() & (F.length(pk) > 0)
    return F.when(has_pk, "pk").when(marker.isNotNull() & cutoff.isNotNull(), "watermark").otherwise("full")
