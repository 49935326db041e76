"""The model service read path: register once, read records / functions / lookups."""

import pytest

from kestrel.catalog.models import AR_MODEL
from kestrel.functions.primitives import FunctionError
from kestrel.plans.model import JoinSpec, ModelError, ModelSpec, attr
from kestrel.plans.service import ModelService


def test_service_read_paths(spark, reg, store):
    svc = ModelService(spark, reg, store)
    svc.register(AR_MODEL)
    page = svc.records("ar_360", {"o_orderstatus": "O"}, limit=20).collect()
    assert len(page) == 20 and all(r.o_orderstatus == "O" for r in page)
    live = svc.function("ar_360", "aggregate", {"agg": "sum", "measure": "o_totalprice", "group_by": "r_name"})
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "c_mktsegment" not in plan  # only the columns the function uses are read
    svc.register(AR_MODEL, materialise=True)
    snap = svc.function("ar_360", "aggregate", {"agg": "sum", "measure": "o_totalprice", "group_by": "r_name"})
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, snap.collect()))
    assert "Join" not in snap._jdf.queryExecution().executedPlan().toString()
    assert svc.lookup("ar_360", "7").o_orderkey == 7
    with pytest.raises(FunctionError):
        svc.function("ar_360", "aggregate", {"agg": "sum", "measure": "nope", "group_by": "r_name"})


def test_service_refuses_fanout_model(spark, reg):
    svc = ModelService(spark, reg)
    bad = ModelSpec("lines", (attr("o_orderkey", "orders", is_pk=True), attr("l_quantity", "lineitem")),
                    (JoinSpec("orders", "o_orderkey", "lineitem", "l_orderkey"),))
    with pytest.raises(ModelError):
        svc.register(bad)


def test_templates_build_with_renames(spark, reg):
    from kestrel.catalog.projections import register_procurement
    from kestrel.plans.model import build_model
    from kestrel.plans.templates import TEMPLATES
    from kestrel.sources.tables import TableRegistry

    r = TableRegistry(spark, reg.root, reg._frames)
    register_procurement(r)
    cols = {k: build_model(r, spec).columns for k, spec in TEMPLATES.items()}
    assert "status" in cols["ap_invoice"] and "invoice_status" not in cols["ap_invoice"]
    assert [k for k, c in cols.items() if "source_updated_at" in c] == ["purchase_order_summary"]
    assert {k: len(c) for k, c in cols.items()} == {"supplier": 7, "purchase_order_header": 9, "purchase_order_line": 12, "ap_invoice": 10, "purchase_order_summary": 19}
    assert TEMPLATES["purchase_order_line"].pk.name == "po_line_id"
    lines = build_model(r, TEMPLATES["purchase_order_line"])
    assert lines.select("po_line_id").distinct().count() == r.table("po_line").select("po_line_id").distinct().count()
    inv = build_model(r, TEMPLATES["ap_invoice"])
    src = r.table("po_invoice")
    assert inv.count() == src.count()
    assert inv.filter("status = 'open'").count() == src.filter("invoice_status = 'open'").count()
