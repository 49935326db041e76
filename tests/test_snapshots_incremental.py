"""Versioned snapshots, matviews, incremental cycles, streams and backfill (write sandbox)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from kestrel.catalog.models import AR_MODEL
from kestrel.operators import backfill as B
from kestrel.operators import incremental as N
from kestrel.plans.model import ModelSpec, attr, build_model
from kestrel.session import work_dir
from kestrel.sources import matview as MV
from kestrel.sources import loads as L
from kestrel.sources.snapshots import GuardError, Slices, SnapshotStore
from kestrel.streaming import jobs as ST


def test_swap_guard_and_old_reader(spark, store):
    df = spark.range(10).withColumnRenamed("id", "k")
    r1 = store.swap("t", df)
    assert r1["rows_after"] == 10 and r1["rows_before"] == 0
    old_reader = store.read("t")
    r2 = store.swap("t", df.filter("k < 5"))
    assert r2["rows_added"] == -5
    assert old_reader.count() == 10  # the previous version is kept for readers that resolved it
    with pytest.raises(GuardError):
        store.swap("t", df.filter("k < 0"))
    assert store.read("t").count() == 5


def test_matview_live_equals_snapshot(spark, reg, store):
    MV.build(store, reg, AR_MODEL)
    snap = MV.read_or_live(store, reg, AR_MODEL, enabled=True)
    live = build_model(reg, AR_MODEL)
    assert snap.exceptAll(live).count() == 0 and live.exceptAll(snap).count() == 0
    bad = ModelSpec("bad", (attr("o_custkey", "orders", is_pk=True), attr("o_totalprice", "orders")))
    with pytest.raises(MV.MatviewError):
        MV.build(store, reg, bad)
    changed = ModelSpec(AR_MODEL.name, AR_MODEL.attributes[:3], AR_MODEL.joins)
    assert MV.rebuild_on_change(store, reg, AR_MODEL)["status"] == "unchanged"
    assert MV.rebuild_on_change(store, reg, changed)["status"] == "success"
    assert store.read(AR_MODEL.name).columns == [a.name for a in changed.attributes]
    assert MV.rebuild_on_change(store, reg, changed, enabled=False)["status"] == "dropped"
    assert not store.exists(AR_MODEL.name)


def test_cycle_twice_equals_once(spark, reg, store):
    o = reg.table("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    half = o.filter(F.col("o_orderkey") < 700)
    N.run_cycle(store, "orders", half, "o_orderkey", ["o_orderkey"])
    r2 = N.run_cycle(store, "orders", o, "o_orderkey", ["o_orderkey"])
    r3 = N.run_cycle(store, "orders", o, "o_orderkey", ["o_orderkey"])
    assert r3["rows_added"] == 0 and r2["rows_after"] == o.count()
    assert N.CursorState(store).get("orders")["cursor"] == o.agg(F.max("o_orderkey")).first()[0]
    with pytest.raises(Exception):
        N.run_cycle(store, "orders", o.drop("o_totalprice"), "o_orderkey", ["o_orderkey"])
    st = N.CursorState(store).get("orders")
    assert st["status"] == "failed" and st["cursor"] == r3["cursor"]
    assert N.CursorState(store).reset_if_changed("orders", "o_orderdate", "date")
    assert N.CursorState(store).get("orders")["cursor"] is None


def test_dedup_stream(spark, reg):
    root = work_dir(spark, "test-stream")
    e = reg.table("events").select("event_id", "ts", "value", "event_type")
    e.coalesce(1).write.parquet(os.path.join(root, "landing", "a"))
    e.filter(F.col("event_type") == "click").coalesce(1).write.parquet(os.path.join(root, "landing", "b"))  # replays
    store = SnapshotStore(spark, os.path.join(root, "store"))
    ST.dedup_stream(spark, os.path.join(root, "landing", "*"), e.schema, store, "events", ["event_id"],
                    os.path.join(root, "ckpt"))
    assert store.read("events").count() == e.count()


def test_backfill_guard_and_reverse(spark, reg, store):
    e = reg.table("events").select("event_id", "ts")
    store.swap("events", e)
    assert B.apply(store, "events", ["ts"], 7)["status"] == "applied"
    assert B.apply(store, "events", ["ts"], 7)["status"] == "skipped"
    shifted = store.read("events").join(e.withColumnRenamed("ts", "t0"), "event_id")
    assert shifted.filter(F.col("ts") != F.col("t0") + F.expr("INTERVAL 7 HOURS")).count() == 0
    assert B.reverse(store, "events", ["ts"])["status"] == "reversed"
    assert store.read("events").exceptAll(e).count() == 0


def test_dedup_within_watermark(spark, reg):
    root = work_dir(spark, "test-wm")
    e = reg.table("events").select("event_id", "ts")
    e.coalesce(1).write.parquet(os.path.join(root, "landing", "a"))
    e.filter(F.col("ts") < F.lit(dt.datetime(2024, 1, 10))).coalesce(1).write.parquet(os.path.join(root, "landing", "b"))
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "landing", "*"))
    q = (ST.dedup_within_watermark(src, ["event_id"], "ts", "3650 days").writeStream.format("memory")
         .queryName("wm_dedup").option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True)
         .start())
    q.awaitTermination(300)
    assert spark.table("wm_dedup").count() == e.count()


def test_insert_if_absent_delta_winner_is_deterministic(spark):
    from kestrel.sources.loads import insert_if_absent

    target = spark.createDataFrame([(0, "x", 0)], "k int, v string, m int")
    delta = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 4)], "k int, v string, m int")
    nxt, _ = insert_if_absent(target, delta, ["k"], ["m"])
    assert sorted(tuple(r) for r in nxt.collect()) == [(0, "x", 0), (1, "c", 4)]
    nxt, _ = insert_if_absent(target, delta.filter("m = 5"), ["k"], ["m"])
    assert sorted(tuple(r) for r in nxt.collect()) == [(0, "x", 0), (1, "a", 5)]


def test_cycle_update_mode_and_cursor_cap(spark, store):
    src = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (2, "b", dt.datetime(2024, 1, 2)),
                                 (3, "c", dt.datetime(2030, 1, 1))], "k long, v string, m timestamp_ntz")
    N.run_cycle(store, "t", src, "m", ["k"], kind="date", cap_at=dt.datetime(2024, 1, 31))
    assert str(N.CursorState(store).get("t")["cursor"]).startswith("2024-01-02")  # not 2030
    changed = src.withColumn("v", F.upper("v"))
    cap = dt.datetime(2024, 1, 31)
    N.run_cycle(store, "t", changed, "m", ["k"], kind="date", cap_at=cap)  # insert_only: stored rows kept
    assert sorted(r.v for r in store.read("t").collect()) == ["a", "b", "c"]
    N.run_cycle(store, "t", changed.filter("k = 2"), "m", ["k"], kind="date", mode="update", cap_at=cap)
    assert sorted(r.v for r in store.read("t").collect()) == ["B", "a", "c"]


def _drop_last_commit(ckpt):
    """Simulate a driver lost after a batch's sink write but before Spark committed the batch."""
    commits = sorted((int(n) for n in os.listdir(os.path.join(ckpt, "commits")) if n.isdigit()))
    os.remove(os.path.join(ckpt, "commits", str(commits[-1])))
    crc = os.path.join(ckpt, "commits", f".{commits[-1]}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    return commits[-1]


def test_ingest_stream_replay_is_exactly_once(spark, reg):
    from kestrel.catalog.loads import INBOUND_FIELDS, inbound_records

    root = work_dir(spark, "test-replay")
    recs = inbound_records(reg)
    recs.filter(F.col("record_id").cast("long") < 500).coalesce(1).write.json(os.path.join(root, "landing", "a"))
    recs.filter(F.col("record_id").cast("long") >= 500).coalesce(1).write.json(os.path.join(root, "landing", "b"))
    land, out, ckpt = os.path.join(root, "landing", "*"), os.path.join(root, "out"), os.path.join(root, "ckpt")
    ST.inbound_stream(spark, land, INBOUND_FIELDS, out, ckpt, bytes_per_batch=1 << 10)
    replayed = _drop_last_commit(ckpt)
    ST.inbound_stream(spark, land, INBOUND_FIELDS, out, ckpt, bytes_per_batch=1 << 10)  # restart: the uncommitted batch runs again
    acc = spark.read.parquet(os.path.join(out, "accepted"))
    rej = spark.read.parquet(os.path.join(out, "rejected"))
    assert replayed >= 1 and os.path.exists(os.path.join(ckpt, "commits", str(replayed)))  # it ran again
    assert acc.count() == acc.select("record_id").distinct().count()  # no duplicates after the replay
    assert acc.count() + rej.select("record_id").distinct().count() == recs.count()


def test_incremental_stream_replay_adds_nothing(spark, reg):
    root = work_dir(spark, "test-replay-inc")
    e = reg.table("events").select("event_id", "ts", "value")
    e.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).coalesce(1).write.parquet(
        os.path.join(root, "landing", "a"))
    e.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).coalesce(1).write.parquet(
        os.path.join(root, "landing", "b"))
    store = SnapshotStore(spark, os.path.join(root, "store"))
    land, ckpt = os.path.join(root, "landing", "*"), os.path.join(root, "ckpt")
    ST.incremental_stream(spark, land, e.schema, store, "events", ["event_id"], None, ckpt, bytes_per_batch=1 << 10)
    replayed = _drop_last_commit(ckpt)
    ST.incremental_stream(spark, land, e.schema, store, "events", ["event_id"], None, ckpt, bytes_per_batch=1 << 10)
    assert os.path.exists(os.path.join(ckpt, "commits", str(replayed)))  # the batch ran again
    assert store.read("events").count() == e.count()


def test_failed_write_never_published_and_previous_kept(spark, store):
    df = spark.range(5).withColumnRenamed("id", "k")
    store.swap("t", df)
    v1 = store.pointer("t")["version"]
    bad = df.withColumn("x", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception):
        store.swap("t", bad)  # the write fails part-way: nothing is published
    assert store.pointer("t")["version"] == v1 and store.read("t").count() == 5
    store.swap("t", df.filter("k < 3"))
    meta = store.pointer("t")
    assert meta["previous"] == v1 and set(store.versions("t")) == {v1, meta["version"]}  # orphan removed


def files(store, table):
    root = os.path.dirname(store.live(table)).removeprefix("file:")
    return {os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


@pytest.mark.parametrize("slices", [Slices("hash", ("k",), 4), None])
def test_append_adds_files_and_columns(spark, store, slices):
    base = spark.range(100).withColumnRenamed("id", "k")
    store.swap("t", base, slices=slices)
    before = files(store, "t")
    for i in range(3):
        res = store.append("t", spark.range(100 + 10 * i, 110 + 10 * i).withColumnRenamed("id", "k").withColumn("extra", F.lit(i)))
        assert res["rows_added"] == 10
    assert before <= files(store, "t") and store.read("t").columns == ["k", "extra"]
    assert store.read("t").filter("extra IS NOT NULL").count() == 30 and store.rows("t") == 130
    store.append("t", spark.range(5).withColumnRenamed("id", "k"))  # lacks a column
    assert store.rows("t") == 135 and store.read("t").filter("extra IS NULL").count() == 105


@pytest.mark.parametrize("kind,size", [("month", 0), ("range", 100)])
def test_range_repair_touches_only_slices_from_the_cutoff(spark, store, kind, size):
    marker = "timestamp_seconds(k * 86400)::timestamp_ntz" if kind == "month" else "k::decimal(10,2)"
    df = spark.range(400).withColumnRenamed("id", "k").withColumn("m", F.expr(marker)).withColumn("v", F.lit("old"))
    df = df.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(None).cast(dict(df.dtypes)["m"]).alias("m"), F.lit("null").alias("v")))
    store.swap("t", df, slices=Slices(kind, ("m",), size))
    kept = {f for f in files(store, "t") if "1970-01" in f or "=r0" in f}
    cutoff = "1970-06-15T00:00:00" if kind == "month" else 250
    source = df.withColumn("v", F.lit("new")).filter("k >= 0 AND k < 350")  # the last slices lose all their rows
    L.replace_range_slices(store, "t", source, "m", cutoff)
    at = 165 if kind == "month" else 250
    got = sorted(map(tuple, store.read("t").select("k", "v").collect()))
    assert got == sorted([(-1, "null")] + [(k, "old" if k < at else "new") for k in range(350)])
    assert kept and kept <= files(store, "t") and store.rows("t") == 351


def test_upsert_on_a_decimal_key_rewrites_its_slices_and_keeps_the_newest(spark, store):
    df = spark.range(300).select(F.col("id").cast("decimal(12,2)").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("m"))
    store.swap("t", df, slices=Slices("hash", ("k",), 16))
    before = files(store, "t")
    delta = spark.createDataFrame([("150", "older", 2), ("150", "newest", 3), ("150", "newer", 2), ("999", "added", 1), (None, "no key", 1)], "k string, v string, m int")
    delta = delta.withColumn("k", F.col("k").cast("decimal(12,2)"))
    for d in (delta, delta.orderBy(F.desc("v"))):
        res = L.upsert_slices(store, "t", d, ["k"], "m")
        assert res["rows_rejected"] == 1
        got = {float(r.k): r.v for r in store.read("t").collect()}
        assert got[150.0] == "newest" and got[999.0] == "added" and len(got) == 301 and store.read("t").count() == 301
    changed = {f.split("/")[-2] for f in before ^ files(store, "t")}
    assert 1 <= len(changed) <= 2  # of 16 slices, those of 150 and 999


def test_rows_without_a_key_are_logged_and_never_loaded(spark, store):
    delta = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k long, v int")
    assert N.run_cycle(store, "t", delta, "v", ["k"])["rows_rejected"] == 2
    assert N.run_cycle(store, "t", delta, "v", ["k"])["rows_added"] == 0
    assert store.read("t").count() == 1 and store.read_log("t__rejects").count() == 2


MARKERS = {
    "sequence": ("sequence", "decimal(20,4)", ["1.5", "2.25", "3.75", "4.0625"], {}),
    "date": ("date", "date", ["2023-12-30", "2023-12-31", "2024-01-01", "2024-01-02"], {}),
    "timestamp": ("date", "timestamp_ntz", ["2023-12-30 10:00:00", "2023-12-31 11:00:00", "2024-01-01 12:00:00", "2024-01-02 13:00:00"], {}),
    "day_number": ("day_number", "int", ["123364", "123365", "124001", "124002"], {}),
    "overlap": ("overlap", "timestamp_ntz", ["2023-12-30 10:00:00", "2023-12-31 11:00:00", "2024-01-01 12:00:00", "2024-01-02 13:00:00"], {"overlap": 90, "unit": "minutes"}),
    "after": ("after", "timestamp_ntz", ["2023-12-30 10:00:00", "2023-12-31 11:00:00", "2024-01-01 12:00:00", "2024-01-02 13:00:00"], {}),
}


@pytest.mark.parametrize("name", MARKERS)
def test_three_cycles_and_a_rerun_for_every_marker(spark, store, name):
    kind, sql_type, values, how = MARKERS[name]
    rows = spark.createDataFrame([(10 * i + j, v) for i, v in enumerate(values) for j in range(3)], "k long, m string").withColumn("m", F.col("m").cast(sql_type))
    for n in (2, 3, 4, 4):
        source = rows.filter(F.col("k") < 10 * n)
        before = store.rows("t")
        res = N.run_cycle(store, "t", source, "m", ["k"], kind=kind, **how)
        assert res["rows_after"] == 3 * n and res["rows_added"] == 3 * n - before
    assert N.CursorState(store).get("t")["cursor"] == rows.agg(F.max("m")).first()[0]


def test_day_and_time_pairs(spark, store):
    rows = spark.createDataFrame([(1, 123365, 235900), (2, 124001, 100), (3, 124001, 200), (4, 124002, 50)], "k long, d long, t long")
    for n, added in ((2, 2), (3, 1), (4, 1), (4, 0)):
        res = N.run_cycle(store, "t", rows.filter(F.col("k") <= n), "d", ["k"], kind="day_time", time_col="t")
        assert res["rows_added"] == added
    assert N.CursorState(store).get("t")["cursor"] == (124002, 50)


def test_a_changed_marker_resets_the_cursor_by_itself(spark, store):
    rows = spark.createDataFrame([(1, 900, dt.datetime(2024, 1, 1)), (2, 901, dt.datetime(2024, 1, 2)), (3, 5, dt.datetime(2024, 1, 3))], "k long, seq long, at timestamp_ntz")
    N.run_cycle(store, "t", rows.filter("k < 3"), "seq", ["k"])
    assert N.run_cycle(store, "t", rows, "seq", ["k"])["rows_added"] == 0  # below the sequence cursor
    assert N.run_cycle(store, "t", rows, "at", ["k"], kind="date")["rows_added"] == 1


def test_audit_stamps_on_what_a_cycle_writes(spark, store):
    rows = spark.range(10).withColumnRenamed("id", "k")
    one = N.run_cycle(store, "t", rows.filter("k < 6"), "k", ["k"], stamp=True)
    two = N.run_cycle(store, "t", rows, "k", ["k"], stamp=True)
    counts = {r[0]: r[1] for r in store.read("t").groupBy("_migrate_run_id").count().collect()}
    assert counts == {one["run_id"]: 6, two["run_id"]: 4} and store.read("t").filter("_migrated_at IS NULL").count() == 0


class Growing:
    """A source that gets a further row at every read: ``frame`` reads files that grow between the jobs."""

    def __init__(self, spark, root):
        self.spark, self.path, self.n = spark, f"{root}/growing", 0
        self.more(5)

    def more(self, k=1):
        rows = [(self.n + i, self.n + i, "v") for i in range(k)]
        self.spark.createDataFrame(rows, "k long, m long, v string").coalesce(1).write.mode("append").parquet(self.path)
        self.n += k

    def frame(self):
        grow = self.more

        class Frame:
            def __init__(self, df):
                self.df = df

            def filter(self, cond):
                grow()  # a row arrives between the pull and whatever else reads the source
                return self.df.filter(cond)
        return Frame(self.spark.read.schema("k long, m long, v string").parquet(self.path))


@pytest.mark.parametrize("mode", ["insert_only", "update"])
def test_a_source_that_grows_between_reads_loses_and_repeats_nothing(spark, store, monkeypatch, mode):
    source = Growing(spark, work_dir(spark, "growing"))
    for name in ("insert_new", "upsert_slices"):  # more rows arrive while the merge runs
        was = getattr(L, name)
        monkeypatch.setattr(L, name, lambda *a, was=was, **b: (source.more(), was(*a, **b), source.more())[1])
    for _ in range(4):
        N.run_cycle(store, "t", source.frame(), "m", ["k"], mode=mode)
    stored = [r.k for r in store.read("t").collect()]
    assert len(stored) == len(set(stored))
    N.run_cycle(store, "t", spark.read.parquet(source.path), "m", ["k"], mode=mode)
    assert sorted(r.k for r in store.read("t").collect()) == list(range(store.rows("t"))) and store.rows("t") >= source.n - 2


def test_an_old_reader_finishes_after_slices_were_replaced(spark, store):
    df = spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    store.swap("t", df, slices=Slices("hash", ("k",), 4))
    reader, before = store.read("t"), files(store, "t")
    L.upsert_slices(store, "t", df.filter("k < 50").withColumn("v", F.lit("new")), ["k"])
    assert reader.count() == 100 and before <= files(store, "t")  # nothing was rewritten in place: a job that runs has its files
    assert store.read("t").groupBy("v").count().orderBy("v").collect() == [("new", 50), ("old", 50)]
    L.upsert_slices(store, "t", df.filter("k < 50").withColumn("v", F.lit("newer")), ["k"])
    assert not before <= files(store, "t") and store.read("t").filter("v = 'newer'").count() == 50
    more = df.filter("k < 10").withColumn("extra", F.lit(1))  # a new column
    L.upsert_slices(store, "t", more, ["k"])
    assert store.read("t").columns == ["k", "v", "extra"] and store.read("t").filter("extra = 1").count() == 10 and store.rows("t") == 100


def test_a_stream_can_run_on(spark, reg):
    root = work_dir(spark, "test-on")
    e = reg.table("events").select("event_id", "ts", "value").limit(50)
    e.write.parquet(f"{root}/landing/a")
    store = SnapshotStore(spark, f"{root}/store")
    query = ST.incremental_stream(spark, f"{root}/landing/*", e.schema, store, "events", ["event_id"], None, f"{root}/ckpt", available_now=False)
    try:
        query.processAllAvailable()
        assert query.isActive and store.read("events").count() == 50
    finally:
        query.stop()
