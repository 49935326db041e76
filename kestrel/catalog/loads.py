"""Source, load, snapshot and sink queries.

Queries that write do so under the session's shared checkpoint folder and return what they wrote,
read back from disk, so the check covers the sink as well as the transformation.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.catalog import standins as S
from kestrel.catalog.base import query
from kestrel.catalog.incremental import sandbox
from kestrel.catalog.models import AR_MODEL
from kestrel.catalog.reconcile import reconciliation_report
from kestrel.catalog.reports import PO_SUMMARY_SQL
from kestrel.operators import filters as FL
from kestrel.plans.model import ModelSpec, attr
from kestrel.session import work_dir
from kestrel.sources import ingest as I
from kestrel.sources import loads as L
from kestrel.sources import matview as MV
from kestrel.sources.snapshots import GuardError, Slices
from kestrel.sources.tables import DRIVER_TABLES
from kestrel.streaming import jobs as ST


def ts(d: str):
    return F.lit(d).cast("timestamp_ntz")


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
OCOLS = ", ".join(ORDER_COLS)
BY_ORDER = Slices("hash", ("o_orderkey",), 8)


@query("load_full_text", oracle="""
SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, NULLIF(s_name, '') AS s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey,
  CAST(s_acctbal AS VARCHAR) AS s_acctbal FROM supplier""")
def load_full_text(reg):
    """Full snapshot load: every column as text, '' as NULL; written as a version and read back."""
    store = sandbox(reg, "load-full-text")
    store.swap("supplier", L.load_full_text(reg.table("supplier")))
    return store.read("supplier")


@query("load_sample_rows", oracle="""
SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000""")
def load_sample_rows(reg):
    """Row-limited trial load (the limit is the feature), deterministic by the table's key."""
    return L.load_sample_rows(reg.table("orders"), 1000, ["o_orderkey"])


@query("load_time_window", oracle="""
SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-06-30 23:59:59'""")
def load_time_window(reg):
    """Only rows inside [start, end] of the time-window column (pushed into the scan)."""
    return L.load_time_window(reg.table("orders"), "o_orderdate", "1998-01-01", "1998-06-30 23:59:59")


@query("stamp_audit")
def stamp_audit(reg):
    """Loaded rows with _migrated_at (query clock) and _migrate_run_id (one uuid per run): whether the clock is set and
    how many runs the ids tell apart stand for the two, as a clock never repeats."""
    out, run_id = L.stamp_audit(reg.table("orders"))
    runs = out.select(F.count_distinct("_migrate_run_id")).scalar()
    stamped = F.col("_migrated_at").isNotNull() & (F.col("_migrate_run_id") == run_id)
    return out.withColumn("stamped", stamped).withColumn("runs", runs).drop("_migrated_at", "_migrate_run_id")


# ------------------------------------------------------------------ validated ingest
INBOUND_FIELDS = [I.Field("event_id", "integer", True), I.Field("user_id", "integer", True),
                  I.Field("event_type", "text", True), I.Field("value", "float"), I.Field("ts", "datetime"),
                  I.Field("props", "json")]


def inbound_records(reg) -> DataFrame:
    """events as inbound JSON records. Errors get the value as a string, signups lack user_id, views of
    the first ten users carry a non-ISO timestamp; every record has an unknown field kept only raw."""
    e = reg.table("events")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    value = F.when(F.col("event_type") == "error", q(F.col("value").cast("string"))).otherwise(
        F.col("value").cast("string"))
    tsv = F.when((F.col("event_type") == "view") & (F.col("user_id") < 10), F.date_format("ts", "yyyy-M-d HH:mm:ss")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    pieces = [F.concat(F.lit('"event_id":'), F.col("event_id").cast("string")),
              F.when(F.col("event_type") != "signup", F.concat(F.lit('"user_id":'), F.col("user_id").cast("string"))),
              F.concat(F.lit('"event_type":'), q(F.col("event_type"))), F.concat(F.lit('"value":'), value),
              F.concat(F.lit('"ts":'), q(tsv)), F.concat(F.lit('"props":'), F.col("props")),
              F.lit('"remark":"raw only"')]
    payload = F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))
    return e.select(F.col("event_id").cast("string").alias("record_id"), payload.alias("payload"))


ACCEPT_SQL = """SELECT event_id, user_id, event_type, value, ts, json(props)::VARCHAR AS props FROM events
WHERE event_type NOT IN ('error', 'signup') AND NOT (event_type = 'view' AND user_id < 10)"""


def typed_view(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in INBOUND_FIELDS])


@query("inbound_accept", oracle=ACCEPT_SQL)
def inbound_accept(reg):
    """Valid records as typed columns (plus id, raw_payload, clocks, not compared); unknown fields stay raw."""
    v = I.validate(inbound_records(reg), INBOUND_FIELDS)
    return typed_view(I.accepted(v, INBOUND_FIELDS))


@query("inbound_reject", oracle="""
SELECT CAST(event_id AS VARCHAR) AS record_id, 'value' AS field, 'must be a number' AS message FROM events
WHERE event_type = 'error'
UNION ALL SELECT CAST(event_id AS VARCHAR), 'user_id', 'is required' FROM events WHERE event_type = 'signup'
UNION ALL SELECT CAST(event_id AS VARCHAR), 'ts', 'must be a valid ISO datetime string' FROM events
WHERE event_type = 'view' AND user_id < 10""")
def inbound_reject(reg):
    """One row per (record, field, message); any error rejects the whole record."""
    return I.rejected(I.validate(inbound_records(reg), INBOUND_FIELDS), "record_id")


@query("inbound_stream", kind="S", oracle=ACCEPT_SQL)
def inbound_stream(reg):
    """The same validation as a stream: landed JSON files -> accepted table + dead-letter table."""
    spark = reg.spark
    root = work_dir(spark, "inbound-stream")
    recs = inbound_records(reg)
    part = F.crc32("payload") % 2
    for i in range(2):  # landed in two folders, the whole input between them
        recs.filter(part == i).write.json(f"{root}/landing/f{i}")
    ST.inbound_stream(spark, f"{root}/landing/*", INBOUND_FIELDS, f"{root}/out", f"{root}/ckpt", bytes_per_batch=1 << 20)
    acc = spark.read.parquet(f"{root}/out/accepted")
    rej = spark.read.parquet(f"{root}/out/rejected")
    n_rej = rej.select("record_id").distinct().count()
    if acc.count() + n_rej != recs.count():
        raise AssertionError("every record must land in exactly one of accepted / rejected")
    return typed_view(acc)


@query("model_schema")
def model_schema(reg):
    """Create-if-absent: system columns then attributes; a second create keeps the rows already there."""
    store = sandbox(reg, "model-schema")
    schema = I.model_schema(INBOUND_FIELDS)

    def ensure():
        if not store.exists("events_in"):
            store.swap("events_in", reg.spark.createDataFrame([], schema), guard_nonempty=False)

    ensure()
    acc = I.accepted(I.validate(inbound_records(reg), INBOUND_FIELDS), INBOUND_FIELDS)
    acc = acc.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    store.append("events_in", acc)
    ensure()
    made = store.read("events_in")
    if made.columns != [f.name for f in schema.fields]:
        raise AssertionError(f"columns out of order: {made.columns}")
    return typed_view(made)


@query("evolve_add_columns", oracle="""
SELECT c_custkey, c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_phone FROM customer
UNION ALL SELECT c_custkey + 100000, c_name, c_nationkey, c_acctbal, CAST(NULL AS VARCHAR) FROM customer
WHERE c_mktsegment = 'BUILDING'""")
def evolve_add_columns(reg):
    """Old files lack c_acctbal; newer files have it; the declared c_phone exists in neither: additive only."""
    store = sandbox(reg, "evolve")
    c = reg.table("customer")
    store.swap("customer", c.select("c_custkey", "c_name", "c_nationkey"))
    store.append("customer", c.filter(F.col("c_mktsegment") == "BUILDING").select(
        (F.col("c_custkey") + 100000).alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal"))
    merged = store.read("customer")
    fields = [I.Field("c_custkey", "integer", True), I.Field("c_name", "text"), I.Field("c_nationkey", "integer"),
              I.Field("c_acctbal", "float"), I.Field("c_phone", "text")]
    return I.evolve_add_columns(merged, fields).select(*[f.name for f in fields])


# ------------------------------------------------------------------ key-based merges (new versions)
def orders_split(reg):
    o = reg.table("orders").select(*ORDER_COLS)
    old = o.filter(F.col("o_orderdate") < ts("1999-01-01"))
    delta = o.filter(F.col("o_orderdate") >= ts("1998-01-01")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return o, old, delta


@query("insert_if_absent", oracle=f"""
SELECT {OCOLS} FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1999-01-01'""")
def insert_if_absent(reg):
    """ON CONFLICT DO NOTHING: overlapping delta rows (1998) leave the existing rows unchanged."""
    store = sandbox(reg, "insert-if-absent")
    _, old, delta = orders_split(reg)
    store.swap("orders", old, slices=BY_ORDER)
    L.insert_new(store, "orders", delta, ["o_orderkey"], ["o_orderdate"])  # only the inserted rows are written
    return store.read("orders")


@query("upsert_update", oracle=f"""
SELECT {OCOLS} FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def upsert_update(reg):
    """ON CONFLICT (key) DO UPDATE: delta rows replace the stored rows with the same key."""
    store = sandbox(reg, "upsert")
    _, old, delta = orders_split(reg)
    store.swap("orders", old, slices=BY_ORDER)
    L.upsert_slices(store, "orders", delta, ["o_orderkey"], "o_orderdate")  # writes only slices with delta keys anew
    return store.read("orders")


@query("replace_range", oracle=f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate FROM orders
WHERE o_orderdate < TIMESTAMP '1999-01-01'
UNION ALL SELECT {OCOLS} FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'""")
def replace_range(reg):
    """Watermark repair from 1999-01-01: stale target rows from the cutoff on are replaced by source rows. The
    table is cut by month of the marker; only months from the cutoff on are read and rewritten."""
    store = sandbox(reg, "replace-range")
    o = reg.table("orders").select(*ORDER_COLS)
    stale = o.filter(F.col("o_orderdate") < ts("2000-01-01")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    store.swap("orders", stale, slices=Slices("month", ("o_orderdate",)))
    res = L.replace_range_slices(store, "orders", o, "o_orderdate", "1999-01-01")
    if min(res["touched"]) != "m1999-01":
        raise AssertionError(f"expected only months from the cutoff on to be rewritten: {res}")
    return store.read("orders")


@query("repair_missing", oracle="""
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem s
WHERE NOT EXISTS (SELECT 1 FROM lineitem t WHERE t.l_returnflag <> 'R' AND t.l_orderkey = s.l_orderkey
                  AND t.l_linenumber = s.l_linenumber)""")
def repair_missing(reg):
    """Key repair: re-read the whole source and insert only rows whose key the target lacks."""
    store = sandbox(reg, "repair-missing")
    li = reg.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    store.swap("lineitem", li.filter(F.col("l_returnflag") != "R"))
    _, new = L.repair_missing(li, store.read("lineitem"), ["l_orderkey", "l_linenumber"])
    store.append("lineitem", new)
    return store.read("lineitem")


@query("repair_mode", oracle=S.with_ctes(S.CATALOGUE_CTE) + """
SELECT table_name, CASE WHEN pk IS NOT NULL AND length(pk) > 0 THEN 'pk'
  WHEN marker IS NOT NULL AND cutoff IS NOT NULL THEN 'watermark' ELSE 'full' END AS repair_mode FROM catalogue""")
def repair_mode(reg):
    """pk if a key is known, else watermark with a marker and cutoff, else full."""
    c = S.table_catalogue(reg)
    return c.select("table_name", L.repair_mode(F.col("pk"), F.col("marker"), F.col("cutoff")).alias("repair_mode"))


@query("full_reload_swap", kind="S", oracle=f"SELECT {OCOLS} FROM orders")
def full_reload_swap(reg):
    """Load a fresh copy beside the live one and move the pointer; a reader holding the old version
    keeps reading it until it re-resolves."""
    store = sandbox(reg, "full-reload")
    o = reg.table("orders").select(*ORDER_COLS)
    store.swap("orders", o.filter(F.col("o_orderdate") < ts("1999-01-01")))
    before = store.read("orders")
    res = store.swap("orders", o)
    if before.count() != res["rows_before"] or res["rows_after"] != store.read("orders").count():
        raise AssertionError("swap row counts disagree")
    return store.read("orders")


@query("nonempty_guard", kind="S")
def nonempty_guard(reg):
    """An empty new copy never replaces a non-empty live table."""
    store = sandbox(reg, "guard")
    o = reg.table("orders").select(*ORDER_COLS)
    store.swap("orders", o)
    rows = []
    for label, df in (("empty_copy", o.filter(F.lit(False))), ("full_copy", o)):
        try:
            store.swap("orders", df)
            status = "published"
        except GuardError:
            status = "refused"
        rows.append((label, status, store.read("orders").count()))
    return reg.spark.createDataFrame(rows, "attempt string, status string, live_rows long")


@query("rows_added", oracle="""
SELECT (SELECT COUNT(*) FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01') AS rows_before,
  (SELECT COUNT(*) FROM orders) AS rows_after,
  (SELECT COUNT(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS rows_added""")
def rows_added(reg):
    """Rows before, after and added by an insert-if-absent load (counted during the write)."""
    store = sandbox(reg, "rows-added")
    _, old, delta = orders_split(reg)
    store.swap("orders", old)
    r = L.insert_new(store, "orders", delta, ["o_orderkey"], ["o_orderdate"])
    return reg.spark.createDataFrame([(r["rows_before"], r["rows_after"], r["rows_added"])],
                                     "rows_before long, rows_after long, rows_added long")


# ------------------------------------------------------------------ materialised models
AR_SQL = """SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
  c.c_name, c.c_mktsegment, c.c_acctbal, n.n_name, r.r_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""


@query("matview_build", oracle=AR_SQL)
def matview_build(reg):
    """Materialise the AR model: written once, key uniqueness checked on the written files before
    publishing, then read back."""
    store = sandbox(reg, "matview")
    MV.build(store, reg, AR_MODEL)
    return store.read(AR_MODEL.name)


@query("matview_refresh", kind="S")
def matview_refresh(reg):
    """Refresh = rebuild beside the live snapshot; one metrics row per refresh; failures are recorded."""
    store = sandbox(reg, "matview-refresh")
    MV.refresh(store, reg, AR_MODEL)
    MV.refresh(store, reg, AR_MODEL)
    bad = ModelSpec("bad_pk", (attr("o_custkey", "orders", is_pk=True), attr("o_totalprice", "orders")))
    MV.refresh(store, reg, bad)  # o_custkey is not unique: build refused, recorded as failed
    logs = [store.read_log(f"{m}__metrics") for m in (AR_MODEL.name, "bad_pk")]
    return logs[0].unionByName(logs[1]).select("model", "status", "rows", "message")


@query("matview_or_live", oracle=f"SELECT 'snapshot' AS path, * FROM ({AR_SQL}) UNION ALL "
                                 f"SELECT 'live' AS path, * FROM ({AR_SQL})")
def matview_or_live(reg):
    """Same shape from the snapshot (enabled and built) and from the live join (disabled)."""
    store = sandbox(reg, "matview-or-live")
    MV.build(store, reg, AR_MODEL)
    snap = MV.read_or_live(store, reg, AR_MODEL, enabled=True)
    live = MV.read_or_live(store, reg, AR_MODEL, enabled=False)
    return snap.select(F.lit("snapshot").alias("path"), "*").unionByName(live.select(F.lit("live").alias("path"), "*"))


@query("matview_rebuild_on_change", kind="S")
def matview_rebuild_on_change(reg):
    """Unchanged spec -> nothing; changed definition -> rebuild; disabled -> snapshot dropped."""
    store = sandbox(reg, "matview-change")
    rows = []
    MV.build(store, reg, AR_MODEL)
    rows.append(("same_spec", MV.rebuild_on_change(store, reg, AR_MODEL)["status"]))
    changed = ModelSpec(AR_MODEL.name, AR_MODEL.attributes[:-1], AR_MODEL.joins)
    rows.append(("changed_spec", MV.rebuild_on_change(store, reg, changed)["status"]))
    rows.append(("disabled", MV.rebuild_on_change(store, reg, changed, enabled=False)["status"]))
    out = reg.spark.createDataFrame(rows, "step string, status string")
    return out.withColumn("snapshot_exists", F.lit(store.exists(AR_MODEL.name)))


@query("refresh_due", oracle=S.with_ctes(S.CATALOGUE_CTE) + """
SELECT table_name, interval_sec, last_run_at FROM catalogue WHERE interval_sec > 0 AND
  (last_run_at IS NULL OR epoch(TIMESTAMP '2024-01-31 06:00:00') - epoch(last_run_at) >= interval_sec)""")
def refresh_due(reg):
    """Models due for refresh: interval > 0 and never refreshed or interval elapsed."""
    c = S.table_catalogue(reg).select("table_name", "interval_sec", "last_run_at")
    state = c.withColumnRenamed("interval_sec", "refresh_interval_sec").withColumnRenamed("last_run_at",
                                                                                          "last_refreshed_at")
    due = MV.refresh_due(state, "2024-01-31 06:00:00")
    return due.select("table_name", F.col("refresh_interval_sec").alias("interval_sec"),
                      F.col("last_refreshed_at").alias("last_run_at"))


@query("export_csv", kind="S")
def export_csv(reg):
    """Reconciliation report written as one CSV with a header (a row per table), read back."""
    path = work_dir(reg.spark, "export-csv") + "/csv"
    L.export_csv(reconciliation_report(reg), path)
    return reg.spark.read.option("header", True).csv(path)


PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, * FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE non_null)" for t in DRIVER_TABLES)


@query("table_schema", oracle=f"""
WITH profile AS ({PROFILE_SQL})
SELECT table_name, column_name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS data_type,
  is_nullable = 'YES' AS is_nullable, ordinal_position, non_null
FROM information_schema.columns JOIN profile USING (table_name, column_name)""")
def table_schema(reg):
    """Columns of every table: type, declared nullability, ordinal, and the observed non-NULL count."""
    from kestrel.operators.aggregates import column_profile

    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, i + 1)
            for t in reg.names() for i, f in enumerate(reg.table(t).schema.fields)]
    schema = reg.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, "
                                             "is_nullable boolean, ordinal_position int")
    return schema.join(column_profile({t: reg.table(t) for t in reg.names()}), ["table_name", "column_name"], "left")


@query("table_list", oracle=PO_SUMMARY_SQL + " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, 'BASE TABLE' AS table_type, COUNT(*) AS row_count FROM {t}" for t in DRIVER_TABLES]
    + [f"SELECT '{t}', 'VIEW', COUNT(*) FROM {'summary' if t == 'po_summary' else t}" for t in ("po_header", "po_supplier", "po_line", "po_invoice", "po_summary")]))
def table_list(reg):
    """Tables with their kind (parquet tables are BASE TABLE, registered derived frames VIEW) and rows."""
    from kestrel.catalog.projections import register_procurement

    register_procurement(reg)
    from kestrel.operators.aggregates import table_counts

    base = set(t for t in reg.names() if t in DRIVER_TABLES)
    rows = [(t, "BASE TABLE" if t in base else "VIEW") for t in reg.names()]
    kinds = reg.spark.createDataFrame(rows, "table_name string, table_type string")
    return kinds.join(table_counts({t: reg.table(t) for t in reg.names()}), "table_name", "left")


@query("table_preview", oracle="""
SELECT *, (SELECT COUNT(*) FROM (SELECT 1 FROM supplier ORDER BY s_suppkey LIMIT 21)) > 20 AS has_more,
  (SELECT COUNT(*) FROM supplier) AS row_estimate FROM supplier ORDER BY s_suppkey LIMIT 20""")
def table_preview(reg):
    """Page of 20 raw rows, read as 21 to set has_more, with a row-count estimate."""
    return FL.table_preview(reg.table("supplier"), "s_suppkey", 20)
