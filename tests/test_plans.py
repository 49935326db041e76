"""Plan shape: join pruning, pushdown, column pruning, partial aggregation."""

from pyspark.sql import functions as F

from kestrel.catalog.models import AR_MODEL
from kestrel.functions import primitives as P
from kestrel.plans.model import build_model


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unused_left_join_removed(reg):
    df = build_model(reg, AR_MODEL, needed=["o_totalprice", "o_orderstatus"])
    out = P.aggregate(df, {"agg": "sum", "measure": "o_totalprice", "group_by": "o_orderstatus"})
    p = plan(out)
    assert "Join" not in p
    full = build_model(reg, AR_MODEL, needed=["o_totalprice", "o_orderstatus"], prune=False)
    assert "Join" in plan(full)
    got = {r[0]: r[1] for r in out.collect()}
    ref = {r[0]: r[1] for r in P.aggregate(full, {"agg": "sum", "measure": "o_totalprice",
                                                  "group_by": "o_orderstatus"}).collect()}
    assert got == ref


def test_filter_pushdown_and_pruning(reg):
    o = reg.table("orders")
    out = P.aggregate(o, {"agg": "count", "group_by": "o_orderstatus", "date_col": "o_orderdate",
                          "from": "1997-01-01", "to": "1997-12-31"})
    p = plan(out)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderstatus:string,o_orderdate:timestamp_ntz>" in p
    assert "partial_count" in p


def test_latest_uses_group_limit(reg):
    from kestrel.operators.windows import latest_per_key

    df = latest_per_key(reg.table("orders"), "o_custkey", "o_orderdate", "o_orderkey")
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.groupBy("o_custkey").count().filter(F.col("count") > 1).count() == 0


def test_fanout_model_salts_a_hot_key(spark):
    from kestrel.plans.model import JoinSpec, ModelSpec, attr
    from kestrel.sources.tables import TableRegistry

    heads = spark.createDataFrame([(k, f"h{k}") for k in range(20)], "hk long, title string")
    lines = spark.createDataFrame([(1, i) for i in range(2000)] + [(k, 0) for k in range(2, 20)], "hk long, qty long")
    reg = TableRegistry(spark, "/nonexistent", {"heads": heads, "lines": lines})
    spec = ModelSpec("hl", (attr("hk", "heads", is_pk=True), attr("title", "heads"), attr("qty", "lines")),
                     (JoinSpec("heads", "hk", "lines", "hk", allow_fanout=True),))
    salted = build_model(reg, spec, skew_options={"fraction": 0.1, "min_rows": 100, "buckets": 8})
    assert "Generate" in plan(salted)  # the hot key's left rows are replicated per salt
    plain = build_model(reg, spec, skew_split=False)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
    assert salted.count() == 2000 + 18 + 1  # h0 has no lines: kept once by the LEFT join
