"""Model specs bound to the driver tables (see FIXTURES.md §6 for the role of each table).

AR   = orders ⟕ customer ⟕ nation ⟕ region          (receivables, customer = the lookup)
AP   = lineitem ⟕ supplier ⟕ nation                  (payables, supplier = the vendor)
"""

from __future__ import annotations

from kestrel.plans.model import JoinSpec, LatestConfig, ModelSpec, attr

AR_MODEL = ModelSpec(
    name="ar_360",
    attributes=(
        attr("o_orderkey", "orders", is_pk=True),
        attr("o_custkey", "orders"),
        attr("o_orderstatus", "orders"),
        attr("o_totalprice", "orders"),
        attr("o_orderdate", "orders"),
        attr("o_orderpriority", "orders"),
        attr("c_name", "customer"),
        attr("c_mktsegment", "customer"),
        attr("c_acctbal", "customer"),
        attr("n_name", "nation"),
        attr("r_name", "region"),
    ),
    joins=(
        JoinSpec("orders", "o_custkey", "customer", "c_custkey"),
        JoinSpec("customer", "c_nationkey", "nation", "n_nationkey"),
        JoinSpec("nation", "n_regionkey", "region", "r_regionkey"),
    ),
)

AP_MODEL = ModelSpec(
    name="ap_360",
    attributes=(
        attr("l_orderkey", "lineitem"),
        attr("l_linenumber", "lineitem"),
        attr("l_suppkey", "lineitem"),
        attr("l_quantity", "lineitem"),
        attr("l_extendedprice", "lineitem"),
        attr("l_discount", "lineitem"),
        attr("l_returnflag", "lineitem"),
        attr("l_linestatus", "lineitem"),
        attr("l_shipdate", "lineitem"),
        attr("s_name", "supplier"),
        attr("s_nationkey", "supplier"),
        attr("n_name", "nation"),
    ),
    joins=(
        JoinSpec("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        JoinSpec("supplier", "s_nationkey", "nation", "n_nationkey"),
    ),
)

# Newest order per customer joined to its customer row: orders keyed by o_custkey (the model PK),
# recency o_orderdate with o_orderkey as tiebreak; customer keyed by its join key.
LATEST_ORDER_MODEL = ModelSpec(
    name="latest_order_per_customer",
    attributes=(
        attr("o_custkey", "orders", is_pk=True),
        attr("o_orderkey", "orders"),
        attr("o_orderdate", "orders"),
        attr("o_totalprice", "orders"),
        attr("c_name", "customer"),
        attr("c_mktsegment", "customer"),
    ),
    joins=(JoinSpec("orders", "o_custkey", "customer", "c_custkey"),),
    latest=LatestConfig(
        recency="o_orderdate",
        recency_by_table={"customer": "c_acctbal"},
        tiebreak_by_table={"orders": "o_orderkey", "customer": "c_custkey"},
    ),
)

# A five-table chain: each left side must already be present when its join is folded in.
CHAIN_MODEL = ModelSpec(
    name="line_chain",
    attributes=(
        attr("l_orderkey", "lineitem"),
        attr("l_linenumber", "lineitem"),
        attr("l_extendedprice", "lineitem"),
        attr("o_orderdate", "orders"),
        attr("c_name", "customer"),
        attr("n_name", "nation"),
        attr("r_name", "region"),
    ),
    joins=(
        # deliberately listed out of order: the planner must order them from the base
        JoinSpec("nation", "n_regionkey", "region", "r_regionkey"),
        JoinSpec("customer", "c_nationkey", "nation", "n_nationkey"),
        JoinSpec("orders", "o_custkey", "customer", "c_custkey"),
        JoinSpec("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ),
)
