"""Golden fixtures (FIXTURES.md §1-§4) as local DataFrames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kestrel.operators import incremental as N
from kestrel.operators import reconcile as RC
from kestrel.operators.reports import po_summary
from kestrel.operators.windows import latest_per_key
from kestrel.plans.check import model_check
from kestrel.plans.model import JoinSpec, LatestConfig, ModelError, ModelSpec, attr, build_model
from kestrel.sources.loads import insert_if_absent
from kestrel.sources.tables import TableRegistry

T0 = dt.datetime(2026, 1, 1)


def procurement(spark):
    sup = spark.createDataFrame([
        ("SUP-1001", "ABC Industrial Supplies"), ("SUP-1002", "Vietnam Mechanical Parts Co."),
        ("SUP-1003", "Global Electrical Equipment Ltd."), ("SUP-1004", "Mekong Packaging Materials"),
        ("SUP-1005", "Saigon Automation Services")], "supplier_code string, supplier_name string") \
        .withColumn("updated_at", F.lit(T0).cast("timestamp_ntz"))
    hdr = spark.createDataFrame([
        ("PO-2026-0001", "SUP-1001"), ("PO-2026-0002", "SUP-1003"), ("PO-2026-0003", "SUP-1004"),
        ("PO-2026-0004", "SUP-1002"), ("PO-2026-0005", "SUP-1005")], "po_no string, supplier_code string") \
        .select("po_no", "supplier_code", F.lit(None).cast("date").alias("order_date"),
                F.lit("open").alias("po_status"), F.lit(0.0).alias("total_amount"),
                F.lit(T0).cast("timestamp_ntz").alias("updated_at"))
    lines = spark.createDataFrame([
        ("PO-2026-0001-001", "PO-2026-0001", 10.0, 0.0, "open"), ("PO-2026-0001-002", "PO-2026-0001", 20.0, 0.0, "open"),
        ("PO-2026-0002-001", "PO-2026-0002", 15.0, 15.0, "received"),
        ("PO-2026-0003-001", "PO-2026-0003", 100.0, 0.0, "open"),
        ("PO-2026-0004-001", "PO-2026-0004", 30.0, 30.0, "closed")],
        "po_line_id string, po_no string, quantity_ordered double, quantity_received double, line_status string") \
        .withColumn("updated_at", F.lit(T0).cast("timestamp_ntz"))
    inv = spark.createDataFrame([
        ("INV-2026-0001", "PO-2026-0001", 15000000.0, 15000000.0), ("INV-2026-0002", "PO-2026-0002", 12000.0, 0.0),
        ("INV-2026-0003", "PO-2026-0003", 8500000.0, 8500000.0), ("INV-2026-0004", "PO-2026-0004", 23000000.0, 0.0),
        ("INV-2026-0005", None, 5000000.0, 5000000.0)],
        "invoice_no string, po_no string, gross_amount double, open_amount double") \
        .withColumn("updated_at", F.lit(T0).cast("timestamp_ntz"))
    return hdr, sup, lines, inv


def test_po_summary_golden(spark):
    rows = {r.po_no: r for r in po_summary(*procurement(spark)).collect()}
    assert len(rows) == 5
    expect = {  # po: name, lines, ordered, received, open lines, invoices, invoiced, open amount, status
        "PO-2026-0001": ("ABC Industrial Supplies", 2, 30, 0, 2, 1, 15000000, 15000000, "open"),
        "PO-2026-0002": ("Global Electrical Equipment Ltd.", 1, 15, 15, 0, 1, 12000, 0, "paid"),
        "PO-2026-0003": ("Mekong Packaging Materials", 1, 100, 0, 1, 1, 8500000, 8500000, "open"),
        "PO-2026-0004": ("Vietnam Mechanical Parts Co.", 1, 30, 30, 0, 1, 23000000, 0, "paid"),
        "PO-2026-0005": ("Saigon Automation Services", 0, 0, 0, 0, 0, 0, 0, "no_invoice"),
    }
    for po, e in expect.items():
        r = rows[po]
        got = (r.supplier_name, r.line_count, r.total_ordered_quantity, r.total_received_quantity, r.open_line_count,
               r.invoice_count, r.total_invoice_amount, r.total_open_invoice_amount, r.payment_status_summary)
        assert got == e, po
    # the invoice without an order number attaches to nothing
    assert sum(r.invoice_count for r in rows.values()) == 4


def sample_tables(spark):
    def t(suffix, rows):
        return spark.createDataFrame(rows, f"id int, id_prod string, name_{suffix} string, updated_at timestamp_ntz")

    a = t("a", [(1, "P-100", "A-old", dt.datetime(2026, 1, 1)), (2, "P-100", "A-new", dt.datetime(2026, 2, 1)),
                (3, "P-200", "A2-old", dt.datetime(2026, 1, 1)), (4, "P-200", "A2-new", dt.datetime(2026, 3, 1))])
    b = t("b", [(1, "P-100", "b-old", dt.datetime(2026, 1, 1)), (2, "P-100", "b-new", dt.datetime(2026, 2, 1)),
                (3, "P-200", "b2-old", dt.datetime(2026, 1, 1)), (4, "P-200", "b2-new", dt.datetime(2026, 3, 1))])
    c = t("c", [(1, "P-100", "c-old", dt.datetime(2026, 1, 1)), (2, "P-100", "c-new", dt.datetime(2026, 2, 1)),
                (3, "P-200", "c2-old", dt.datetime(2026, 1, 1)), (4, "P-200", "c2-new", dt.datetime(2026, 3, 1))])
    return TableRegistry(spark, "/nonexistent", {"dm_sample_a": a, "dm_sample_b": b, "dm_sample_c": c})


def latest_spec(latest=True, recency="updated_at"):
    return ModelSpec("latest", (attr("id_prod", "dm_sample_a", is_pk=True), attr("name_a", "dm_sample_a"),
                                attr("name_b", "dm_sample_b"), attr("name_c", "dm_sample_c")),
                     (JoinSpec("dm_sample_a", "id_prod", "dm_sample_b", "id_prod"),
                      JoinSpec("dm_sample_a", "id_prod", "dm_sample_c", "id_prod")),
                     LatestConfig(recency=recency) if latest else None)


def test_latest_join_golden(spark):
    reg = sample_tables(spark)
    rows = sorted(tuple(r) for r in build_model(reg, latest_spec()).collect())
    assert rows == [("P-100", "A-new", "b-new", "c-new"), ("P-200", "A2-new", "b2-new", "c2-new")]


def test_latest_checks(spark):
    reg = sample_tables(spark)
    issues = model_check(spark, reg, latest_spec(recency="missing_col")).collect()
    assert any(i.code == "recency_column" and "not found" in i.message for i in issues)
    issues = model_check(spark, reg, latest_spec(recency="name_a")).collect()
    assert any(i.code == "recency_column" for i in issues)  # text recency is not sortable
    issues = model_check(spark, reg, latest_spec(latest=False)).collect()
    assert any(i.code == "pk_not_unique" for i in issues)


def test_latest_null_recency_null_key_and_ties(spark):
    df = spark.createDataFrame([
        ("k1", None, 1), ("k1", 5, 2),          # NULL recency sorts last
        ("k2", 7, 1), ("k2", 7, 3),             # tie broken by id desc
        ("k3", 1, None), ("k3", 1, 9),          # NULL id first in DESC (PostgreSQL order)
        (None, 1, 1), (None, 2, 2),             # NULL keys collapse to one row
    ], "k string, rec int, id int")
    got = {r.k: (r.rec, r.id) for r in latest_per_key(df, "k", "rec", "id").collect()}
    assert got == {"k1": (5, 2), "k2": (7, 3), "k3": (1, None), None: (2, 2)}


def guard_tables(spark):
    head = spark.createDataFrame([("h1", "L1", "t1"), ("h2", "L2", "t2")], "head_id string, lookup_code string, title string")
    lookup = spark.createDataFrame([("L1", "one", 1), ("L2", "two", 2)], "lookup_code string, lookup_name string, ref_num int")
    lines = spark.createDataFrame([("h1", 1, 5), ("h1", 2, 6), ("h2", 1, 7)], "head_id string, line_no int, qty int")
    return TableRegistry(spark, "/nonexistent", {"dm_t_head": head, "dm_t_lookup": lookup, "dm_t_lines": lines})


def test_join_guards(spark):
    reg = guard_tables(spark)
    base = (attr("head_id", "dm_t_head", is_pk=True), attr("title", "dm_t_head"))
    ok = ModelSpec("ok", base + (attr("lookup_name", "dm_t_lookup"),),
                   (JoinSpec("dm_t_head", "lookup_code", "dm_t_lookup", "lookup_code"),))
    assert [i for i in model_check(spark, reg, ok).collect() if i.level == "error"] == []
    fan = ModelSpec("fan", base + (attr("qty", "dm_t_lines"),), (JoinSpec("dm_t_head", "head_id", "dm_t_lines", "head_id"),))
    assert any(i.code == "fanout" for i in model_check(spark, reg, fan).collect())
    allowed = ModelSpec("fan", fan.attributes, (JoinSpec("dm_t_head", "head_id", "dm_t_lines", "head_id", allow_fanout=True),))
    assert build_model(reg, allowed).count() == 3
    bad = ModelSpec("types", base, (JoinSpec("dm_t_head", "title", "dm_t_lookup", "ref_num"),))
    assert any(i.code == "join_type_mismatch" for i in model_check(spark, reg, bad).collect())
    with pytest.raises(ModelError):
        build_model(reg, ModelSpec("unreach", base + (attr("qty", "dm_t_lines"),),
                                   (JoinSpec("dm_t_lookup", "lookup_code", "dm_t_lines", "head_id"),)))


def test_insert_if_absent_keeps_existing(spark):
    target = spark.createDataFrame([(1, "a", "orig")], "doc int, dct string, descr string")
    delta = spark.createDataFrame([(1, "a", "dup"), (2, "b", "new")], "doc int, dct string, descr string")
    nxt, new = insert_if_absent(target, delta, ["doc", "dct"])
    assert sorted(tuple(r) for r in nxt.collect()) == [(1, "a", "orig"), (2, "b", "new")]
    assert new.count() == 1


def test_reconcile_and_tolerance(spark):
    counts = spark.createDataFrame([("t1", 3, 3), ("t2", 5, 3), ("t3", None, 2)],
                                   "table_name string, source_count long, target_count long")
    got = {r.table_name: (r.validation_status, r.missed) for r in RC.reconcile(counts).collect()}
    assert got == {"t1": ("MATCH", 0), "t2": ("MISMATCH", 2), "t3": ("PENDING", None)}
    tol = spark.createDataFrame([(1000, False), (1000, True), (1000000, True)], "s long, rep boolean") \
        .select(RC.tolerance(F.col("s"), F.col("rep")).alias("t"))
    assert [r.t for r in tol.collect()] == [0, 50, 100]
    v = spark.createDataFrame([(100, 97, 0), (100, 95, 5), (100, 50, 5), (100, 97, 5)], "s long, t long, tol long") \
        .select(RC.source_verdict(F.col("s"), F.lit("exact"), F.lit(False), F.col("t"), F.col("tol")).alias("v"))
    assert [r.v for r in v.collect()] == ["MISMATCH", "MATCH", "MISMATCH", "MATCH"]
    est = spark.range(1).select(RC.source_verdict(F.lit(100), F.lit("estimate"), F.lit(True), F.lit(1), F.lit(0)))
    assert est.first()[0] == "ESTIMATE"


def test_predicates(spark):
    df = spark.createDataFrame([(124098,), (124099,), (124100,), (123365,), (124000,)], "d long")
    ge = lambda c: sorted(r.d for r in df.filter(c).collect())
    assert ge(N.pull_day_lookback("d", 124100, 1, calendar=False)) == [124099, 124100]
    assert ge(N.pull_day_lookback("d", None, 1)) == sorted(r.d for r in df.collect())
    # year boundary: calendar cutoff for 124001 - 1 day is 123365; the integer rule gives 124000
    assert N.day_cutoff_integer(124001, 1) == 124000
    from kestrel.functions.scalars import julian_cutoff
    assert spark.range(1).select(julian_cutoff(F.lit(124001), 1)).first()[0] == 123365
    t = spark.createDataFrame([(124100, 2999), (124100, 3000), (124101, 0), (124099, 9999)], "d long, t long")
    got = sorted(tuple(r) for r in t.filter(N.pull_day_time("d", "t", 124100, 3000)).collect())
    assert got == [(124100, 3000), (124101, 0)]


def test_key_rules(spark):
    cfg = spark.createDataFrame([("id", "m", False), (None, "m", True), (None, "m", False), (None, None, False)],
                                "pk string, marker string, seq boolean")
    out = cfg.select(N.upsert_key_rule(F.col("pk"), F.col("marker"), F.col("seq")).alias("k"))
    out = out.withColumn("mode", N.sync_mode(F.lit("m"), F.col("k")))
    assert [tuple(r) for r in out.collect()] == [("id", "incremental"), ("m", "incremental"), (None, "full"),
                                                (None, "full")]


def test_job_watermark(spark):
    runs = spark.createDataFrame([
        ("j", "success", dt.datetime(2026, 5, 31), "2026-05-31"),
        ("j", "failed", dt.datetime(2026, 6, 30), "2026-06-30")], "job string, status string, at timestamp_ntz, wm string")
    r = N.job_watermark(runs, "job", "status", "at", "wm").first()
    assert r.last_successful_watermark == "2026-05-31"
    assert r.last_run_at == dt.datetime(2026, 6, 30)


def test_model_check_inner_drop_and_nullable_pk(spark, reg):
    spec = ModelSpec("building_orders", (attr("o_orderkey", "orders", is_pk=True), attr("c_name", "customer_b")),
                     (JoinSpec("orders", "o_custkey", "customer_b", "c_custkey", how="inner"),))
    r = TableRegistry(spark, reg.root, reg._frames)
    r.register("customer_b", reg.table("customer").filter(F.col("c_mktsegment") == "BUILDING"))
    issues = {i.code: i for i in model_check(spark, r, spec).collect()}
    expected_drop = reg.table("orders").join(r.table("customer_b"), F.col("o_custkey") == F.col("c_custkey"),
                                             "left_anti").count()
    assert issues["inner_join_drop"].message == f"INNER join to customer_b drops {expected_drop} base rows"
    assert "pk_nullable" in issues and "inner_join" in issues
