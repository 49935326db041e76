"""Projection, filter and lookup queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.catalog import standins as S
from kestrel.catalog.base import query
from kestrel.catalog.models import AR_MODEL
from kestrel.operators import filters as FL
from kestrel.catalog.reports import PO_SUMMARY_SQL
from kestrel.operators.reports import po_summary
from kestrel.plans.model import ModelSpec, attr, build_model
from kestrel.plans.templates import TEMPLATES
from kestrel.sources import ingest as I
from kestrel.sources.tables import DRIVER_TABLES, platform_type


@query("mapped_projection", oracle="""
SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, c_acctbal AS balance
FROM customer""")
def mapped_projection(reg):
    """select source AS attribute, in declared order."""
    return FL.mapped_projection(reg.table("customer"), [("customer_id", "c_custkey"), ("customer_name", "c_name"),
                                                        ("segment", "c_mktsegment"), ("balance", "c_acctbal")])


def register_procurement(reg):
    for name, make in (("po_header", S.po_header), ("po_supplier", S.po_supplier), ("po_line", S.po_line), ("po_invoice", S.po_invoice)):
        reg.register(name, make(reg))
    reg.register("po_summary", po_summary(*[reg.table(t) for t in ("po_header", "po_supplier", "po_line", "po_invoice")]))


# How the templates' attributes are compared: times, texts, and for all others the exact sum.
TEMPLATE_TIMES = "order_date promised_date invoice_date due_date source_updated_at".split()
TEMPLATE_TEXTS = ("supplier_name tax_code supplier_type country city status buyer_name company_code branch_plant currency po_status po_line_id "
                  "item_code item_description uom line_status invoice_no payment_status payment_status_summary").split()


def template_oracle() -> str:
    """Per template and attribute, over the template's own source column: filled rows, least and greatest, sum."""
    rows = []
    for name, spec in TEMPLATES.items():
        for a in spec.attributes:
            text = f"strftime({a.source_column}::TIMESTAMP, '%Y-%m-%d %H:%M:%S')" if a.name in TEMPLATE_TIMES else a.source_column
            ends = [f"{f}({text})" if a.name in TEMPLATE_TEXTS + TEMPLATE_TIMES else "CAST(NULL AS VARCHAR)" for f in ("MIN", "MAX")]
            total = "CAST(NULL AS DOUBLE)" if a.name in TEMPLATE_TEXTS + TEMPLATE_TIMES else f"CAST(SUM(CAST({a.source_column} AS DECIMAL(38,10))) AS DOUBLE)"
            table = {"po_summary": "summary"}.get(a.source_table, a.source_table)
            rows.append(f"SELECT '{name}' AS template, '{a.name}' AS attribute, COUNT({a.source_column}) AS filled, {ends[0]} AS least, {ends[1]} AS greatest, "
                        f"{total} AS total FROM {table}")
    return PO_SUMMARY_SQL + " UNION ALL ".join(rows)


@query("template_models", oracle=template_oracle())
def template_models(reg):
    """The five procurement templates built as models: per attribute its filled rows, of texts and times the least and
    greatest value, of numbers the sum. Each model is read once."""
    register_procurement(reg)
    parts = []
    for name, spec in TEMPLATES.items():
        df, seen = build_model(reg, spec), []
        for c, kind in df.dtypes:
            time, number = kind in ("date", "timestamp", "timestamp_ntz"), kind not in ("string", "date", "timestamp", "timestamp_ntz")
            text = lambda f, c=c, time=time: F.date_format(f(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss") if time else f(c)
            none = F.lit(None).cast("string")
            seen.append(F.struct(F.lit(name).alias("template"), F.lit(c).alias("attribute"), F.count(c).alias("filled"),
                                 (none if number else text(F.min)).alias("least"), (none if number else text(F.max)).alias("greatest"),
                                 (F.sum(F.col(c).cast("decimal(38,10)")).cast("double") if number else F.lit(None).cast("double")).alias("total")))
        parts.append(df.agg(F.array(*seen).alias("seen")).select(F.inline("seen")))
    return reduce(DataFrame.unionByName, parts)


# Names reserved for system columns.
SYSTEM_NAMES = ("id", "raw_payload", "created_at", "updated_at")


def snake_case(name):
    """Column-name rule as a Spark expression: split camel case, non-alphanumerics to '_', strip
    leading '_', lower case; names reserved for system columns get a ``source_`` prefix."""
    s = F.regexp_replace(F.col(name) if isinstance(name, str) else name, "([a-z0-9])([A-Z])", "$1_$2")
    s = F.lower(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9]+", "_"), "^_+", ""))
    return F.when(s.isin(*SYSTEM_NAMES), F.concat(F.lit("source_"), s)).otherwise(s)


def first_column_sql(table: str) -> str:
    """Whether a table's first column is a key: it is renamed by its place, whatever its name."""
    return f"SELECT '{table}' AS table_name, COUNT(*) = COUNT(k) AND COUNT(k) = COUNT(DISTINCT k) AS pk_unique FROM {table} AS t(k)"


@query("model_from_table", oracle=f"""
WITH keys AS ({' UNION ALL '.join(map(first_column_sql, DRIVER_TABLES))}),
named AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(column_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+', '')) AS snake
          FROM information_schema.columns)
SELECT table_name, ordinal_position AS position, column_name AS source_column,
  CASE WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'float'
       WHEN data_type = 'TIMESTAMP' THEN 'datetime' WHEN data_type = 'DATE' THEN 'date' WHEN data_type = 'BOOLEAN' THEN 'boolean' END AS data_type,
  ordinal_position = 1 AS is_pk, CASE WHEN snake IN {SYSTEM_NAMES} THEN 'source_' || snake ELSE snake END AS attribute, pk_unique
FROM named JOIN keys USING (table_name)""")
def model_from_table(reg):
    """Derive a model from each table's schema: snake_case names, system names prefixed, first column PK
    (checked against the data: usable only when unique and never NULL)."""
    from kestrel.operators.aggregates import first_column_unique

    rows = []
    for t in reg.names():
        for i, f in enumerate(reg.table(t).schema.fields):
            rows.append((t, i + 1, f.name, platform_type(f.dataType), i == 0))
    cols = reg.spark.createDataFrame(rows, "table_name string, position int, source_column string, "
                                           "data_type string, is_pk boolean")
    attrs = cols.withColumn("attribute", snake_case("source_column"))
    # the derived key is checked against the data: usable only when unique and never NULL
    return attrs.join(first_column_unique({t: reg.table(t) for t in reg.names()}), "table_name", "left")


@query("project_meta_raw", oracle="""
SELECT event_id, event_type, value, 'id,created_at,updated_at,event_id,event_type,value,raw_payload' AS columns, true AS has_id, true AS fresh, true AS never_updated,
  '{"event_id":' || event_id || ',"event_type":"' || event_type || '"' || CASE WHEN value IS NULL THEN '' ELSE ',"value":' || value END || '}' AS raw_payload
FROM events WHERE event_id IS NOT NULL AND event_type IS NOT NULL""")
def project_meta_raw(reg):
    """Ingested events (Type A) with meta columns first and raw_payload last. The id and the clocks never repeat: checks on
    their values stand in for them."""
    fields = [I.Field("event_id", "integer", True), I.Field("event_type", "text", True), I.Field("value", "float")]
    payload = reg.table("events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("payload"))
    acc = I.accepted(I.validate(payload, fields), fields)
    out = FL.project_meta_raw(acc, [f.name for f in fields], include_meta=True, include_raw=True)
    return out.select(*[f.name for f in fields], F.lit(",".join(out.columns)).alias("columns"),
                      F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("has_id"),
                      (F.abs(F.timestamp_diff("HOUR", F.col("created_at"), F.current_timestamp())) < 1).alias("fresh"),
                      (F.col("updated_at") == F.col("created_at")).alias("never_updated"), "raw_payload")


@query("serialize_rows", oracle="""
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
  strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS order_day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS order_ts
FROM orders""")
def serialize_rows(reg):
    """Decimals -> double, dates and datetimes -> ISO text."""
    o = reg.table("orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
                                   F.col("o_orderdate").cast("date").alias("order_day"),
                                   F.col("o_orderdate").alias("order_ts"))
    return FL.serialize_rows(o)


@query("filter_equals", oracle="""
SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus = 'O' AND o.o_orderpriority = '1-URGENT' AND c.c_nationkey = 7""")
def filter_equals(reg):
    """AND of column = value over the AR model, each value coerced by the column's type."""
    spec = ModelSpec(AR_MODEL.name, AR_MODEL.attributes + (attr("c_nationkey", "customer"),), AR_MODEL.joins)
    df = build_model(reg, spec, needed=["o_orderkey", "o_totalprice", "c_name", "o_orderstatus", "o_orderpriority",
                                        "c_nationkey"])
    out = FL.filter_equals(df, {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "c_nationkey": "7"})
    return out.select("o_orderkey", "o_totalprice", "c_name")


@query("filter_json_equals", oracle="""
SELECT event_id, props FROM events WHERE json(props)::VARCHAR = json('{"k":69}')::VARCHAR""")
def filter_json_equals(reg):
    """Structural JSON equality: '{ "k" : 69 }' matches '{"k": 69}'."""
    e = reg.table("events").select("event_id", "props")
    return FL.filter_equals(e, {"props": '{ "k" : 69 }'}, {"event_id": "integer", "props": "json"})


@query("filter_condition", oracle="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def filter_condition(reg):
    """where=l_quantity>=45: split at the leftmost, longest operator."""
    li = reg.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return FL.filter_condition(li, "l_quantity>=45")


@query("filter_time_range", oracle="""
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1997-06-30'""")
def filter_time_range(reg):
    """Inclusive range on a datetime; the bare-date end means midnight of that day."""
    o = reg.table("orders").select("o_orderkey", "o_orderdate")
    return FL.filter_time_range(o, "o_orderdate", "1997-03-01", "1997-06-30")


@query("filter_past_due", oracle=S.with_ctes(S.ACC_CTES) + """
SELECT invoice_no, due_date FROM acc_invoice WHERE DATE '1996-01-01' >= CAST(due_date AS DATE)""")
def filter_past_due(reg):
    """as_of >= due_date over receivables."""
    return FL.filter_past_due(S.acc_invoice(reg).select("invoice_no", "due_date"), "due_date", "1996-01-01")


@query("filter_last_window", oracle="""
SELECT event_id, ts FROM events
WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 120 DAY AND ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def filter_last_window(reg):
    """Rolling now-120d .. now with now fixed at 2024-01-20 12:00."""
    return FL.filter_last_window(reg.table("events").select("event_id", "ts"), "ts", "2024-01-20 12:00:00", 120)


@query("lookup_by_key", oracle="SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4242")
def lookup_by_key(reg):
    """One row by key; type B reads two rows so a non-unique key can be rejected."""
    o = reg.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return FL.lookup_by_key(o, "o_orderkey", "4242", "B")


@query("filter_log", oracle="""
SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'error' AND user_id = 7
ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 5""")
def filter_log(reg):
    """Log by status and model (user), newest first, limit 50 offset 5."""
    e = reg.table("events").select("event_id", "ts", "user_id", "event_type")
    return FL.filter_log(e, {"event_type": "error", "user_id": 7}, "ts", "event_id", 50, 5)


@query("filter_facets", oracle="""
SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_type = 'LARGE' AND p_size = 20""")
def filter_facets(reg):
    """Catalogue filter: only the facets that are given are applied."""
    p = reg.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return FL.filter_facets(p, {"p_type": "LARGE", "p_brand": None, "p_size": 20, "p_name": None})


@query("filter_search", oracle="""
SELECT p_partkey, p_name, p_type FROM part
WHERE contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'blue') AND p_type = 'SMALL'""")
def filter_search(reg):
    """Case-insensitive substring over name/type/brand, combined with a facet."""
    p = reg.table("part")
    out = FL.filter_search(FL.filter_facets(p, {"p_type": "SMALL"}), ["p_name", "p_type", "p_brand"], "BLUE")
    return out.select("p_partkey", "p_name", "p_type")
