"""Incremental-pull and streaming queries.

Sandboxed keys write under the session's shared checkpoint folder and return the table read back.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.catalog import standins as S
from kestrel.catalog.base import query
from kestrel.functions.scalars import date_to_julian
from kestrel.operators import incremental as N
from kestrel.session import work_dir
from kestrel.sources import pull as P
from kestrel.sources.fs import HadoopFS
from kestrel.sources.loads import load_time_window
from kestrel.sources.snapshots import SnapshotStore
from kestrel.streaming import jobs as ST
from kestrel.streaming.dedup import dedup_quiet_stream


def sandbox(reg, purpose: str) -> SnapshotStore:
    return SnapshotStore(reg.spark, work_dir(reg.spark, purpose))


def julian_orders(reg) -> DataFrame:
    o = reg.table("orders")
    return o.select("o_orderkey", date_to_julian(F.col("o_orderdate").cast("date")).alias("day"))


JULIAN_SQL = "(year(o_orderdate) - 1900) * 1000 + dayofyear(o_orderdate)"


@query("pull_sequence", oracle="SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 12000")
def pull_sequence(reg):
    """Assign-once ids: marker > cursor, strict, no lookback."""
    o = reg.table("orders").select("o_orderkey", "o_orderdate")
    return o.filter(N.pull_sequence("o_orderkey", 12000))


@query("pull_day_lookback", oracle=f"""
SELECT o_orderkey, {JULIAN_SQL} AS day FROM orders WHERE {JULIAN_SQL} >= 100366""")
def pull_day_lookback(reg):
    """Day cursor 101001 (2001-01-01) with a 1-day lookback, calendar-correct: re-reads 2000-12-31 (100366)."""
    return julian_orders(reg).filter(N.pull_day_lookback("day", 101001, 1, calendar=True))


@query("pull_day_lookback_parity", oracle=f"""
SELECT o_orderkey, {JULIAN_SQL} AS day FROM orders WHERE {JULIAN_SQL} >= 101000""")
def pull_day_lookback_parity(reg):
    """The original integer subtraction: 101001 - 1 = 101000 > 100366, so 2000-12-31 is not re-read."""
    return julian_orders(reg).filter(N.pull_day_lookback("day", 101001, 1, calendar=False))


EV_DAYTIME_SQL = """(year(ts) - 1900) * 1000 + dayofyear(ts) AS day,
  hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS tm"""


def events_daytime(reg) -> DataFrame:
    e = reg.table("events")
    return e.select("event_id", ((F.year("ts") - 1900) * 1000 + F.dayofyear("ts")).cast("long").alias("day"),
                    (F.hour("ts") * 10000 + F.minute("ts") * 100 + F.second("ts")).cast("long").alias("tm"))


@query("pull_day_time", oracle=f"""
SELECT event_id, day, tm FROM (SELECT event_id, {EV_DAYTIME_SQL} FROM events)
WHERE day > 124015 OR (day = 124015 AND tm >= 120000)""")
def pull_day_time(reg):
    """Exact resume at a (day, time) cursor: (day > d) OR (day = d AND time >= t)."""
    return events_daytime(reg).filter(N.pull_day_time("day", "tm", 124015, 120000))


@query("pull_overlap", oracle="""
SELECT 'greater_than_last_watermark' AS strategy, event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'
UNION ALL SELECT 'greater_equal_last_watermark_with_overlap', event_id, ts FROM events
WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 90 MINUTE""")
def pull_overlap(reg):
    """Both job strategies on a timestamp cursor; the overlap is 90 minutes."""
    e = reg.table("events").select("event_id", "ts")
    parts = [e.filter(N.pull_overlap("ts", "2024-01-20 00:00:00", s, ov, "minutes"))
             .select(F.lit(s).alias("strategy"), "event_id", "ts")
             for s, ov in (("greater_than_last_watermark", 0), ("greater_equal_last_watermark_with_overlap", 90))]
    return reduce(DataFrame.unionByName, parts)


WINDOW = ("1998-01-01", "2000-06-30")


@query("pull_live", oracle=f"""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
WHERE o_orderkey > 12000 AND o_orderdate BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}'""")
def pull_live(reg):
    """A cursor and a time window over a source that isn't parquet: both reach its segments."""
    path = work_dir(reg.spark, "pull-live")
    P.land(reg.table("orders").repartitionByRange(4, "o_orderkey"), path)
    o = P.pull(reg.spark, path)
    return load_time_window(o.filter(N.pull_sequence("o_orderkey", 12000)), "o_orderdate", *WINDOW).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


def forget_last_commit(spark, checkpoint: str) -> None:
    """As if the driver had been lost between a batch's output and its commit: the next run replays that batch."""
    fs = HadoopFS(spark)
    last = max((n for n in fs.list_names(f"{checkpoint}/commits") if n.isdigit()), key=int)
    fs.delete(f"{checkpoint}/commits/{last}")
    fs.delete(f"{checkpoint}/commits/.{last}.crc")


@query("cursor_stream", kind="S", oracle="SELECT event_id, ts, user_id, event_type, value FROM events")
def cursor_stream(reg):
    """Events that land in three arrivals, taken by a stream whose offset is the cursor; its last batch is replayed."""
    spark, root = reg.spark, work_dir(reg.spark, "cursor-stream")
    e = reg.table("events").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.dayofmonth("ts")
    by_time = e.repartitionByRange(4, "ts").sortWithinPartitions("ts")
    for a, b in ((1, 11), (11, 21), (21, 32)):
        P.land(by_time.filter((day >= a) & (day < b)), f"{root}/landed")
        ST.pull_stream_to(spark, f"{root}/landed", "ts", f"{root}/out", f"{root}/checkpoint", e.schema)
    forget_last_commit(spark, f"{root}/checkpoint")
    ST.pull_stream_to(spark, f"{root}/landed", "ts", f"{root}/out", f"{root}/checkpoint", e.schema)
    return spark.read.schema(e.schema).parquet(f"{root}/out")


@query("cursor_init", oracle="""
SELECT 'loaded' AS target, COALESCE(MAX(o_orderkey), 0) AS cursor FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
UNION ALL SELECT 'empty', COALESCE(MAX(o_orderkey), 0) FROM orders WHERE o_orderdate < TIMESTAMP '1900-01-01'""")
def cursor_init(reg):
    """Start from the loaded target's max marker, or 0 when the target is empty."""
    o = reg.table("orders")
    ts = lambda d: F.lit(d).cast("timestamp_ntz")
    loaded = o.filter(F.col("o_orderdate") < ts("1999-01-01"))
    empty = o.filter(F.col("o_orderdate") < ts("1900-01-01"))
    one = reg.spark.range(1)
    return one.select(F.lit("loaded").alias("target"), N.cursor_from_target(loaded, "o_orderkey").alias("cursor")) \
        .unionByName(one.select(F.lit("empty").alias("target"), N.cursor_from_target(empty, "o_orderkey").alias("cursor")))


CAT = S.with_ctes(S.CATALOGUE_CTE)
KEY_SQL = """CASE WHEN pk IS NOT NULL AND length(pk) > 0 THEN pk WHEN marker IS NOT NULL AND is_sequence THEN marker END"""
MODE_SQL = f"CASE WHEN marker IS NOT NULL AND ({KEY_SQL}) IS NOT NULL THEN 'incremental' ELSE 'full' END"
INTERVAL_SQL = f"""CASE WHEN {MODE_SQL} = 'full'
  THEN GREATEST(43200, COALESCE(NULLIF(interval_sec, 0), 86400)) ELSE GREATEST(2, COALESCE(NULLIF(interval_sec, 0), 60)) END"""


def config(reg) -> DataFrame:
    cat = S.table_catalogue(reg)
    key = N.upsert_key_rule(F.col("pk"), F.col("marker"), F.col("is_sequence"))
    mode = N.sync_mode(F.col("marker"), key)
    return cat.select("*", key.alias("upsert_key"), N.upsert_key_kind(F.col("pk"), F.col("marker"), F.col("is_sequence"))
                      .alias("key_kind"), mode.alias("mode"))


@query("upsert_key_rule", oracle=CAT + f"""
SELECT table_name, {KEY_SQL} AS upsert_key,
  CASE WHEN pk IS NOT NULL AND length(pk) > 0 THEN 'primary_key' WHEN marker IS NOT NULL AND is_sequence THEN 'marker'
  END AS key_kind FROM catalogue""")
def upsert_key_rule(reg):
    """Key = PK if any; else the marker when it is a sequence; else none."""
    return config(reg).select("table_name", "upsert_key", "key_kind")


@query("sync_mode", oracle=CAT + f"SELECT table_name, {MODE_SQL} AS mode FROM catalogue")
def sync_mode(reg):
    """incremental when a marker and a key exist, otherwise full reload."""
    return config(reg).select("table_name", "mode")


@query("sync_interval", oracle=CAT + f"SELECT table_name, {INTERVAL_SQL} AS interval_sec FROM catalogue")
def sync_interval(reg):
    """incremental: max(2 s, interval or 60); full reload: max(12 h, interval or 24 h)."""
    c = config(reg)
    return c.select("table_name", N.sync_interval(F.col("mode"), F.col("interval_sec")).alias("interval_sec"))


@query("sync_due", oracle=CAT + f""", d AS (SELECT table_name, enabled, last_run_at, {INTERVAL_SQL} AS iv FROM catalogue)
SELECT table_name, iv AS interval_sec,
  enabled AND (last_run_at IS NULL OR epoch(TIMESTAMP '2024-01-31 06:00:00') - epoch(last_run_at) >= iv) AS due,
  (SELECT MIN(iv) FROM d WHERE enabled) AS next_sleep FROM d""")
def sync_due(reg):
    """Due = enabled and (never run or interval elapsed); next sleep = smallest enabled interval."""
    c = config(reg).withColumn("iv", N.sync_interval(F.col("mode"), F.col("interval_sec")))
    now = F.lit("2024-01-31 06:00:00").cast("timestamp_ntz")
    nxt = c.filter("enabled").select(F.min("iv")).scalar()
    return c.select("table_name", F.col("iv").alias("interval_sec"),
                    N.sync_due(F.col("enabled"), F.col("last_run_at"), F.col("iv"), now).alias("due"),
                    nxt.alias("next_sleep"))


@query("job_watermark", oracle=S.with_ctes(S.RUNS_CTE) + """
SELECT job_id, arg_max(to_watermark, created_at) FILTER (WHERE status = 'success' AND to_watermark IS NOT NULL)
    AS last_successful_watermark,
  MAX(created_at) FILTER (WHERE status = 'success') AS last_successful_run_at, MAX(created_at) AS last_run_at
FROM job_runs GROUP BY job_id""")
def job_watermark(reg):
    """Last successful run's to_watermark per job; failed runs move only last_run_at."""
    return N.job_watermark(S.job_runs(reg), "job_id", "status", "created_at", "to_watermark")


@query("future_marker_audit", oracle="""
SELECT 'orders' AS table_name, COUNT(*) AS future_rows FROM orders WHERE o_orderdate > TIMESTAMP '2001-06-01'
UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-06-01'
UNION ALL SELECT 'events', COUNT(*) FROM events WHERE ts > TIMESTAMP '2024-01-25'""")
def future_marker_audit(reg):
    """Rows whose marker is later than now (they would push the cursor past unread rows)."""
    checks = [("orders", "o_orderdate", "2001-06-01"), ("lineitem", "l_shipdate", "2001-06-01"),
              ("events", "ts", "2024-01-25")]
    parts = [N.future_marker_audit(reg.table(t), m, F.lit(a).cast("timestamp_ntz"))
             .agg(F.count(F.lit(1)).alias("future_rows")).select(F.lit(t).alias("table_name"), "future_rows")
             for t, m, a in checks]
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ sandboxed cycles
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
ARRIVALS = ("1997-01-01", "1999-01-01", None)


def order_arrivals(reg):
    """The source as it grows over time: orders dated before 1997, before 1999, then all of them."""
    o = reg.table("orders").select(*ORDER_COLS)
    return [o if d is None else o.filter(F.col("o_orderdate") < F.lit(d).cast("timestamp_ntz")) for d in ARRIVALS]


def cycle(store, src):
    """Date marker with a one-day lookback; the order key is the insert-if-absent key."""
    return N.run_cycle(store, "orders", src, "o_orderdate", ["o_orderkey"], kind="date", lookback_days=1)


@query("incremental_cycle", kind="S", oracle=f"SELECT {', '.join(ORDER_COLS)} FROM orders")
def incremental_cycle(reg):
    """Three cycles over a growing source plus a re-run that must add 0 rows; returns the final table."""
    store = sandbox(reg, "incremental-cycle")
    results = [cycle(store, src) for src in order_arrivals(reg)]
    rerun = cycle(store, order_arrivals(reg)[-1])
    if rerun["rows_added"] != 0 or sum(r["rows_added"] for r in results) <= 0:
        raise AssertionError(f"re-run added {rerun['rows_added']} rows")
    return store.read("orders")


@query("cursor_advance", kind="S")
def cursor_advance(reg):
    """Cursor = the target's max after success; a failed cycle leaves it unchanged."""
    store = sandbox(reg, "cursor-advance")
    first, full = order_arrivals(reg)[0], order_arrivals(reg)[-1]
    cycle(store, first)
    after_ok = N.CursorState(store).get("orders")
    try:  # a source missing a column fails the cycle before anything is published
        cycle(store, full.drop("o_totalprice"))
    except Exception:  # noqa: BLE001
        pass
    after_fail = N.CursorState(store).get("orders")
    rows = [("success", str(after_ok["cursor"]), after_ok["status"]),
            ("failure", str(after_fail["cursor"]), after_fail["status"])]
    state = reg.spark.createDataFrame(rows, "step string, cursor string, status string")
    return state.withColumn("target_max", store.read("orders").select(F.max("o_orderdate")).scalar().cast("string"))


@query("cursor_reset", kind="S")
def cursor_reset(reg):
    """Changing the marker column (or its kind) clears the cursor."""
    store = sandbox(reg, "cursor-reset")
    cycle(store, order_arrivals(reg)[0])
    cs = N.CursorState(store)
    before = cs.get("orders")["cursor"]
    changed = cs.reset_if_changed("orders", "o_orderkey", "sequence")
    after = cs.get("orders")["cursor"]
    rows = [("before", None if before is None else str(before), False), ("after_change", after, changed)]
    return reg.spark.createDataFrame(rows, "step string, cursor string, reset boolean").withColumn(
        "target_rows", store.read("orders").select(F.count(F.lit(1))).scalar())


@query("stream_dedup", kind="S", oracle="SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_dedup(reg):
    """Events replayed in overlapping files: duplicates within and across micro-batches are absorbed."""
    spark = reg.spark
    root = work_dir(spark, "stream-dedup")
    e = reg.table("events").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.dayofmonth("ts")
    # three landed folders by event time, each overlapping the previous one by two days, and each repeating
    # its error events once: duplicates inside a batch and across batches
    for i, (a, b) in enumerate(((1, 11), (9, 21), (19, 32))):
        part = e.filter((day >= a) & (day < b))
        part.unionByName(part.filter(F.col("event_type") == "error")).write.parquet(f"{root}/landing/f{i}")
    store = SnapshotStore(spark, f"{root}/store")
    ST.dedup_stream(spark, f"{root}/landing/*", e.schema, store, "events", ["event_id"], f"{root}/ckpt", bytes_per_batch=1 << 16)
    return store.read("events")


@query("stream_dedup_quiet", kind="S", oracle="""
SELECT user_id, event_type, ts FROM (
  SELECT user_id, event_type, ts, LAG(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events)
WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR""")
def stream_dedup_quiet(reg):
    """Events of a user and type within six hours of the one before are dropped; the state holds no older key."""
    spark, root = reg.spark, work_dir(reg.spark, "stream-dedup-quiet")
    e = reg.table("events").select("event_id", "ts", "user_id", "event_type")
    day = F.dayofmonth("ts")
    for i, (a, b) in enumerate(((1, 11), (11, 21), (21, 32))):
        e.filter((day >= a) & (day < b)).write.parquet(f"{root}/landing/f{i}")
        dedup_quiet_stream(spark, f"{root}/landing/*", e.schema, f"{root}/out", ["user_id", "event_type"], "ts", dt.timedelta(hours=6), "1 day", f"{root}/checkpoint")
    return spark.read.schema(e.schema).parquet(f"{root}/out").select("user_id", "event_type", "ts")
