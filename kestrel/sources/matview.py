"""Materialised models: snapshot of a model's DataFrame, refreshed without blocking readers.

Build = model DataFrame -> PK uniqueness check -> sorted write of a new version -> pointer move.
Readers use ``read_or_live``: the snapshot when enabled and built, the live join otherwise, with the
same columns. The spec fingerprint is stored with the snapshot, so a definition change is detected.
"""

from __future__ import annotations

import datetime as _dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators.aggregates import has_duplicates
from kestrel.plans.model import ModelSpec, build_model
from kestrel.sources.clustering import clustered
from kestrel.sources.loads import staged
from kestrel.sources.snapshots import SnapshotStore
from kestrel.sources.tables import TableRegistry

METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("at", T.TimestampNTZType()),
])


class MatviewError(RuntimeError):
    pass


def _sort_columns(spec: ModelSpec, df: DataFrame) -> list[str]:
    """Recency, date and FK columns (at most three) so parquet min/max stats prune reads on them."""
    out = []
    if spec.latest is not None and spec.latest.recency in df.columns:
        out.append(spec.latest.recency)
    types = dict(df.dtypes)
    dates = [a.name for a in spec.attributes if types.get(a.name, "").startswith("timestamp") or
             types.get(a.name) == "date"]
    fks = [a.name for a in spec.attributes for j in spec.joins
           if a.source_table == j.left_table and a.source_column == j.left_column and not a.is_pk]
    for c in [*dates, *fks]:
        if c not in out:
            out.append(c)
    return out[:3]


def build(store: SnapshotStore, reg: TableRegistry, spec: ModelSpec, cluster: bool = False) -> dict:
    """Write the model once as an unpublished version, check the key on the written files (a scan of
    the key column only), then publish; a non-unique key discards the version and refuses the build.
    The join is computed once, not once for the check and again for the write. With ``cluster`` the rows lie along a
    curve over all sort columns, so that filters on any of them skip files, not only on the first."""
    if spec.pk is None:
        raise MatviewError(f"model {spec.name} needs a primary key to be materialised")
    df = build_model(reg, spec)
    t0 = time.time()
    before = store.rows(spec.name)
    order = _sort_columns(spec, df)
    if cluster:
        version, rows, _ = store.write_version(spec.name, clustered(staged(df, "cluster"), order))
    else:
        version, rows, _ = store.write_version(spec.name, df, sort_within=order)
    if has_duplicates(store.read_version(spec.name, version).select(spec.pk.name), [spec.pk.name]):
        store.discard(spec.name, version)
        raise MatviewError(f"primary key {spec.pk.name} of {spec.name} is not unique; build refused")
    store.publish(spec.name, version, {"rows": rows, "fingerprint": spec.fingerprint()})
    return {"table": spec.name, "version": version, "rows_before": before, "rows_after": rows,
            "rows_added": rows - before, "seconds": round(time.time() - t0, 3), "status": "success"}


def _metric(spark: SparkSession, spec: ModelSpec, status: str, rows: int | None, seconds: float, msg: str | None):
    now = _dt.datetime.now(_dt.UTC).replace(tzinfo=None)
    return spark.createDataFrame([(spec.name, status, rows, float(seconds), spec.fingerprint(), msg, now)],
                                 METRICS_SCHEMA)


def refresh(store: SnapshotStore, reg: TableRegistry, spec: ModelSpec) -> dict:
    """Recompute and replace; build if absent. A metrics row is appended whatever the outcome, and a
    failure leaves the previous snapshot in place."""
    t0 = time.time()
    try:
        res = build(store, reg, spec)
        store.append_rows(f"{spec.name}__metrics", _metric(reg.spark, spec, "success", res["rows_after"],
                                                          time.time() - t0, None))
        return res
    except Exception as exc:  # noqa: BLE001 - recorded, never loses the model
        store.append_rows(f"{spec.name}__metrics", _metric(reg.spark, spec, "failed", None, time.time() - t0,
                                                          str(exc)))
        return {"status": "failed", "message": str(exc)}


def read_or_live(store: SnapshotStore | None, reg: TableRegistry, spec: ModelSpec, enabled: bool = True,
                 needed: list[str] | None = None) -> DataFrame:
    """The snapshot when enabled, built and of the same definition; otherwise the live join."""
    snap = store.read(spec.name) if (enabled and store is not None) else None
    if snap is not None and (store.pointer(spec.name) or {}).get("fingerprint") == spec.fingerprint():
        cols = [a.name for a in spec.attributes if needed is None or a.name in needed]
        return snap.select(*cols)
    return build_model(reg, spec, needed=needed)


def rebuild_on_change(store: SnapshotStore, reg: TableRegistry, spec: ModelSpec, enabled: bool = True,
                      old_name: str | None = None) -> dict:
    """Definition change -> rebuild; disable or rename -> drop the old snapshot."""
    if old_name and old_name != spec.name:
        store.drop(old_name)
    if not enabled:
        store.drop(spec.name)
        return {"status": "dropped"}
    cur = store.pointer(spec.name)
    if cur is not None and cur.get("fingerprint") == spec.fingerprint():
        return {"status": "unchanged"}
    return refresh(store, reg, spec)


def refresh_due(state: DataFrame, now: str) -> DataFrame:
    """Models whose interval > 0 and that were never refreshed or whose interval has elapsed."""
    n = F.lit(now).cast("timestamp_ntz")
    elapsed = F.timestamp_diff("SECOND", F.col("last_refreshed_at"), n)
    return state.filter((F.col("refresh_interval_sec") > 0)
                        & (F.col("last_refreshed_at").isNull() | (elapsed >= F.col("refresh_interval_sec"))))
