"""Read-path filters, paging and join operators."""

import pytest
from pyspark.sql import functions as F

from kestrel.functions.primitives import FunctionError
from kestrel.operators import filters as FL
from kestrel.operators import joins as J


def test_filter_equals_coercion_and_errors(reg):
    o = reg.table("orders")
    assert FL.filter_equals(o, {"o_orderkey": "42"}).count() == 1
    with pytest.raises(FunctionError):
        FL.filter_equals(o, {"nope": "1"})
    with pytest.raises(FunctionError):
        FL.filter_equals(o, {"o_orderkey": "4x"})  # not an integer
    with pytest.raises(FunctionError):
        FL.filter_equals(o, {"o_orderdate": "1997-13-01"})  # not a date


def test_json_equality_is_structural(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": [1, 2]}'), (2, '{"b":[1,2],"a":1}'), (3, '{"a": 2}')],
                               "id int, j string")
    got = FL.filter_equals(df, {"j": '{"b": [1, 2], "a": 1}'}, {"id": "integer", "j": "json"})
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_lookup_type_b_rejects_duplicates(reg):
    li = reg.table("lineitem")
    k = li.groupBy("l_orderkey").count().filter("count > 1").first().l_orderkey
    rows = FL.lookup_by_key(li, "l_orderkey", str(k), "B").collect()
    assert len(rows) == 2
    with pytest.raises(FL.LookupError_):
        FL.require_single(rows)
    assert len(FL.lookup_by_key(li, "l_orderkey", str(k), "A").collect()) == 1


def test_paging_honours_the_limit_and_goes_on_by_key(reg):
    o = reg.table("orders")
    every = [r.o_orderkey for r in FL.page_by_key(o, "o_orderkey").collect()]
    assert len(every) == o.count() and every == sorted(every)
    assert [r.o_orderkey for r in FL.page_by_key(o, "o_orderkey", 900).collect()] == every[:900]
    second = FL.page_by_key(o, "o_orderkey", 100, after=FL.after_key("o_orderkey", every[99])).collect()
    assert [r.o_orderkey for r in second] == every[100:200]
    newest = FL.page_by_created(o, "o_orderdate", "o_orderkey", 50).collect()
    behind = FL.page_by_created(o, "o_orderdate", "o_orderkey", 50, after=FL.after_created("o_orderdate", "o_orderkey", newest[19].o_orderdate, newest[19].o_orderkey)).collect()
    assert behind[:30] == newest[20:]
    assert FL.preview_page(o, "o_orderkey", 700).count() == 700
    with pytest.raises(FunctionError):
        FL.page(o, [F.col("o_orderkey")], 0)
    prev = FL.table_preview(o, "o_orderkey", 5).collect()
    assert len(prev) == 5 and prev[0].has_more and prev[0].row_estimate == o.count()
    with pytest.raises(FunctionError):
        FL.page(o, [F.col("o_orderkey")], 10, -1)


def test_search_and_window(reg, spark):
    p = reg.table("part")
    hits = FL.filter_search(p, ["p_name", "p_type"], "RING").collect()
    assert hits and all("ring" in (r.p_name + " " + r.p_type).lower() for r in hits)
    import datetime as dt

    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2023, 9, 1))], "id int, ts timestamp_ntz")
    assert [r.id for r in FL.filter_last_window(e, "ts", "2024-01-02 00:00:00", 120).collect()] == [1]


def test_anti_semijoins_and_union(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(2,)], "k int")
    assert sorted(r.k for r in J.missing_rows(a, b, ["k"]).collect()) == [1, 3]
    dim = spark.createDataFrame([(1,), (2,)], "d int")
    fact = spark.createDataFrame([(1,), (5,), (None,)], "fk int")
    assert [r.fk for r in J.orphan_fk(fact, "fk", dim, "d").collect()] == [5]
    prim = spark.createDataFrame([("Alpha", "p")], "name string, src string")
    extra = spark.createDataFrame([("ALPHA", "x"), ("beta", "x")], "name string, src string")
    assert sorted(r.name for r in J.union_first_wins(prim, extra, "name").collect()) == ["Alpha", "beta"]
    assert not J.is_fanout(dim, "d") and J.is_fanout(spark.createDataFrame([(1,), (1,)], "d int"), "d")


def test_model_name_rule(spark):
    from kestrel.catalog.projections import snake_case

    df = spark.createDataFrame([("OrderID",), ("__weird Name!x",), ("updated_at",), ("customerName2Code",)], "c string")
    got = [r[0] for r in df.select(snake_case("c")).collect()]
    assert got == ["order_id", "weird_name_x", "source_updated_at", "customer_name2_code"]


def test_skew_split_join_matches_plain_join(spark):
    import datetime as dt  # noqa: F401

    left = spark.createDataFrame([(k, f"o{k}") for k in range(50)] + [(None, "nokey")], "lk long, lv string")
    rows = [(1, i) for i in range(3000)] + [(k, k) for k in range(2, 40)] + [(None, 7)]
    right = spark.createDataFrame(rows, "rk long, rv long")
    for how in ("left", "inner"):
        plain = left.join(right, left.lk == right.rk, how)
        split = J.skew_split_join(left, right, "lk", "rk", how, fraction=0.1, min_rows=100, buckets=8)
        assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert [r[0] for r in J.hot_keys(right, "rk", 0.1, 100).collect()] == [1]


def test_serialize_rows(spark):
    import datetime as dt
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal("1.50"), dt.date(2024, 1, 5), dt.datetime(2024, 1, 5, 10, 0), '{"b": 1, "a": [2]}')],
                               "amt decimal(18,2), d date, ts timestamp_ntz, j string")
    r = FL.serialize_rows(df, json_columns=("j",)).first()
    assert (r.amt, r.d, r.ts, r.j) == (1.5, "2024-01-05", "2024-01-05T10:00:00", '{"a":[2],"b":1}')


def test_a_hot_key_is_split_though_only_the_key_is_left(spark):
    left = spark.createDataFrame([(1,), (2,)], "lk long")
    right = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("rk"))
    split = J.skew_split_join(left, right, "lk", "rk", "left", fraction=0.1, min_rows=100, buckets=8)
    assert split.filter("rk = 1").count() == 4000 and split.count() == 4001
    salts = right.filter("rk = 1").withColumn("s", F.pmod(F.monotonically_increasing_id(), F.lit(8))).groupBy("s").count().collect()
    assert len(salts) == 8 and max(r[1] for r in salts) <= 2 * min(r[1] for r in salts)


def test_one_scan_for_value_checks_and_totals(reg):
    from kestrel.catalog import queries
    from kestrel.catalog.scalars import scalar_value_checks  # noqa: F401

    for name in ("scalar_value_checks", "fn_breakdown", "status_counts"):
        plan = queries()[name](reg.spark, reg.root)._jdf.queryExecution().executedPlan().toString()
        reads = plan.count("FileScan parquet") - plan.count("ReusedSubquery")
        assert reads <= 2 and (name != "scalar_value_checks" or reads == 1), plan


def test_a_registry_sees_files_that_came_later(spark):
    from kestrel.session import work_dir
    from kestrel.sources.tables import registry

    root = work_dir(spark, "late-files")
    spark.range(5).write.parquet(f"{root}/events.parquet")
    assert registry(spark, root).table("events").count() == 5
    spark.range(5).write.mode("append").parquet(f"{root}/events.parquet")
    assert registry(spark, root).table("events").count() == 10
