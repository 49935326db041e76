"""Set-operation and scalar-function queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.catalog.base import query
from kestrel.functions import scalars as X
from kestrel.operators import joins as J

WS = r"[ \t\n\r\f]+"


@query("union_first_wins", oracle="""
WITH primary_cat AS (SELECT n_name AS name, 'builtin' AS src FROM nation),
extra AS (SELECT lower(n_name) AS name, 'extra' AS src FROM nation WHERE n_regionkey = 1
          UNION ALL SELECT r_name, 'extra' FROM region)
SELECT * FROM primary_cat UNION ALL
SELECT * FROM extra e WHERE upper(e.name) NOT IN (SELECT upper(name) FROM primary_cat)""")
def union_first_wins(reg):
    """Built-in catalogue (nations) plus an extra one; extra names already present (any case) are dropped."""
    prim = reg.table("nation").select(F.col("n_name").alias("name"), F.lit("builtin").alias("src"))
    extra = (reg.table("nation").filter(F.col("n_regionkey") == 1).select(F.lower("n_name").alias("name"),
                                                                          F.lit("extra").alias("src"))
             .unionByName(reg.table("region").select(F.col("r_name").alias("name"), F.lit("extra").alias("src"))))
    return J.union_first_wins(prim, extra, "name")


@query("distinct_keep_order", oracle="""
SELECT user_id, MIN(event_id) AS event_id FROM events GROUP BY user_id ORDER BY event_id""")
def distinct_keep_order(reg):
    """De-duplicate the user list of the event stream, keeping each user's first position."""
    return J.distinct_keep_order(reg.table("events").select("user_id", "event_id"), "user_id", "event_id")


@query("scalar_round", oracle="""
SELECT l_orderkey, l_linenumber,
  CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,6)) * CAST(l_discount AS DECIMAL(18,6)), 2) AS DOUBLE) AS discount_amt
FROM lineitem""")
def scalar_round(reg):
    """ROUND(x, 2) on exact decimals, half away from zero."""
    li = reg.table("lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.round(X.wide("l_extendedprice") * X.wide("l_discount"), 2).cast("double").alias("discount_amt"))


@query("scalar_date_trunc", oracle="""
SELECT event_id, CAST(ts AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS month,
  date_trunc('hour', ts) AS hour FROM events""")
def scalar_date_trunc(reg):
    e = reg.table("events")
    return e.select("event_id", X.day_bucket("ts").alias("day"), X.month_bucket("ts").alias("month"),
                    X.hour_bucket("ts").alias("hour"))


@query("scalar_date_diff", oracle="""
SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age_days FROM orders""")
def scalar_date_diff(reg):
    o = reg.table("orders")
    return o.select("o_orderkey", X.days_between(F.lit("2001-08-01").cast("date"), "o_orderdate").cast("long")
                    .alias("age_days"))


@query("scalar_coalesce_greatest", oracle="""
SELECT o_orderkey, COALESCE(NULLIF(o_orderpriority, '1-URGENT'), 'none') AS priority,
  GREATEST(o_totalprice, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 200000.0 END) AS floor_price FROM orders""")
def scalar_coalesce_greatest(reg):
    """COALESCE and NULL-skipping GREATEST."""
    o = reg.table("orders")
    return o.select("o_orderkey", F.coalesce(F.nullif("o_orderpriority", F.lit("1-URGENT")), F.lit("none"))
                    .alias("priority"),
                    F.greatest("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.lit(None))
                               .otherwise(F.lit(200000.0))).alias("floor_price"))


@query("scalar_case_bucket", oracle="""
SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium'
  ELSE 'large' END AS size_bucket FROM orders""")
def scalar_case_bucket(reg):
    o = reg.table("orders")
    return o.select("o_orderkey", F.when(F.col("o_totalprice") < 50000, "small")
                    .when(F.col("o_totalprice") < 200000, "medium").otherwise("large").alias("size_bucket"))


TEXT_MARKER_SQL = """CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'O'
  THEN CAST(o_orderkey AS VARCHAR) || '.0' ELSE CAST(o_orderkey AS VARCHAR) || '.75' END"""


@query("scalar_nullif", oracle=f"""
SELECT o_orderkey, NULLIF(m, '') AS marker, TRY_CAST(NULLIF(trim(m), '') AS DECIMAL(38,12)) AS marker_num
FROM (SELECT o_orderkey, {TEXT_MARKER_SQL} AS m FROM orders)""")
def scalar_nullif(reg):
    """NULLIF(text, '') and text -> numeric over a text-loaded marker."""
    o = reg.table("orders")
    m = (F.when(F.col("o_orderstatus") == "P", F.lit(""))
         .when(F.col("o_orderstatus") == "O", F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")))
         .otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".75"))))
    t = o.select("o_orderkey", m.alias("m"))
    return t.select("o_orderkey", F.nullif("m", F.lit("")).alias("marker"), X.text_number("m").alias("marker_num"))


TYPE_NAME_SQL = """CASE p_type WHEN 'SMALL' THEN 'character varying(' || CAST(p_size AS VARCHAR) || ')'
  WHEN 'ECONOMY' THEN 'NUMERIC(' || CAST(p_size AS VARCHAR) || ',2)'
  WHEN 'STANDARD' THEN 'timestamp(6) without time zone' WHEN 'MEDIUM' THEN 'bigint'
  WHEN 'LARGE' THEN 'interval' ELSE 'jsonb' END"""


@query("scalar_type_name", oracle=f"""
WITH t AS (SELECT p_partkey, {TYPE_NAME_SQL} AS type_name FROM part),
n AS (SELECT p_partkey, type_name, lower(trim(type_name)) AS l FROM t)
SELECT p_partkey, type_name, CASE
  WHEN l LIKE 'timestamp%' THEN 'datetime'
  WHEN l LIKE 'character varying%' THEN 'text'
  WHEN l LIKE 'numeric%' OR l LIKE 'decimal%' THEN 'float'
  WHEN l IN ('text', 'varchar', 'character', 'char', 'uuid') THEN 'text'
  WHEN l IN ('integer', 'bigint', 'smallint') THEN 'integer'
  WHEN l IN ('double precision', 'real') THEN 'float'
  WHEN l = 'boolean' THEN 'boolean' WHEN l = 'date' THEN 'date'
  WHEN l IN ('json', 'jsonb') THEN 'json' END AS platform_type FROM n""")
def scalar_type_name(reg):
    """Source type name -> platform type over declared column types (NULL = unsupported)."""
    p = reg.table("part")
    names = (F.when(F.col("p_type") == "SMALL", F.concat(F.lit("character varying("), F.col("p_size").cast("string"),
                                                          F.lit(")")))
             .when(F.col("p_type") == "ECONOMY", F.concat(F.lit("NUMERIC("), F.col("p_size").cast("string"),
                                                         F.lit(",2)")))
             .when(F.col("p_type") == "STANDARD", F.lit("timestamp(6) without time zone"))
             .when(F.col("p_type") == "MEDIUM", F.lit("bigint")).when(F.col("p_type") == "LARGE", F.lit("interval"))
             .otherwise(F.lit("jsonb")))
    t = p.select("p_partkey", names.alias("type_name"))
    return t.select("p_partkey", "type_name", X.platform_type_of("type_name").alias("platform_type"))


CANDIDATES_SQL = """
SELECT event_id, 'props' AS source, props AS s FROM events
UNION ALL SELECT event_id, 'value', CAST(value AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'type', event_type FROM events
UNION ALL SELECT event_id, 'ts', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events
UNION ALL SELECT event_id, 'day', strftime(ts, '%Y-%m-%d') FROM events
UNION ALL SELECT event_id, 'loose_day', strftime(ts, '%Y-%-m-%-d') FROM events"""


@query("scalar_value_checks", oracle=f"""
WITH c AS ({CANDIDATES_SQL})
SELECT event_id, source, regexp_full_match(s, '[+-]?\\d+') AS is_integer, TRY_CAST(s AS DOUBLE) IS NOT NULL AS is_float,
  lower(s) IN ('true', 'false') AS is_boolean,
  regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST(s AS DATE) IS NOT NULL AS is_date,
  regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d{{1,6}})?)?)?(Z|[+-]\\d{{2}}:?\\d{{2}})?')
    AND TRY_CAST(s AS TIMESTAMP) IS NOT NULL AS is_datetime,
  COALESCE(CASE WHEN json_valid(s) THEN json_type(s) IN ('OBJECT', 'ARRAY') ELSE false END, false) AS is_json FROM c""")
def scalar_value_checks(reg):
    """Is a text value a valid integer / float / boolean / strict ISO date / ISO datetime / JSON container?"""
    e = reg.table("events")
    parts = [("props", F.col("props")), ("value", F.col("value").cast("string")),
             ("user", F.col("user_id").cast("string")), ("type", F.col("event_type")),
             ("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), ("day", F.date_format("ts", "yyyy-MM-dd")),
             ("loose_day", F.date_format("ts", "yyyy-M-d"))]
    each = F.array(*[F.struct(F.lit(n).alias("source"), v.alias("s")) for n, v in parts])  # one scan for all seven
    c = e.select("event_id", F.inline(each))
    return c.select("event_id", "source", X.is_integer_text("s").alias("is_integer"),
                    X.is_float_text("s").alias("is_float"), X.is_boolean_text("s").alias("is_boolean"),
                    X.is_iso_date_text("s").alias("is_date"), X.is_iso_datetime_text("s").alias("is_datetime"),
                    X.is_json_container_text("s").alias("is_json"))


@query("scalar_identifier", oracle=f"""
SELECT doc_id, len(list_filter(string_split_regex(text, '{WS}'), lambda w: w <> '')) AS n_words,
  len(list_filter(string_split_regex(text, '{WS}'), lambda w: regexp_full_match(w, '[a-z][a-z0-9_]*'))) AS n_identifiers
FROM documents""")
def scalar_identifier(reg):
    """Per document (whole text): words, and words that are valid identifiers (^[a-z][a-z0-9_]*$)."""
    d = reg.table("documents")
    words = F.split(F.col("text"), WS)
    return d.select("doc_id", F.size(F.filter(words, lambda w: w != "")).cast("long").alias("n_words"),
                    F.size(F.filter(words, lambda w: X.is_identifier(w))).cast("long").alias("n_identifiers"))


@query("scalar_shift_hours", oracle="SELECT event_id, ts + INTERVAL 7 HOUR AS shifted FROM events")
def scalar_shift_hours(reg):
    return reg.table("events").select("event_id", X.shift_hours("ts", 7).alias("shifted"))


@query("scalar_local_time", oracle="""
SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Ho_Chi_Minh' AS TIMESTAMP) AS local_ts FROM events""")
def scalar_local_time(reg):
    """UTC wall clock -> local wall clock (the platform's zone)."""
    return reg.table("events").select("event_id", X.local_time("ts", X.PLATFORM_TZ).alias("local_ts"))


@query("scalar_julian_cutoff", oracle="""
SELECT o_orderkey, (year(o_orderdate) - 1900) * 1000 + dayofyear(o_orderdate) AS julian,
  (year(o_orderdate - INTERVAL 1 DAY) - 1900) * 1000 + dayofyear(o_orderdate - INTERVAL 1 DAY) AS calendar_cutoff,
  (year(o_orderdate) - 1900) * 1000 + dayofyear(o_orderdate) - 1 AS integer_cutoff FROM orders""")
def scalar_julian_cutoff(reg):
    """CYYDDD day numbers: calendar-correct cursor - 1 day, next to the plain integer subtraction."""
    o = reg.table("orders").select("o_orderkey", X.date_to_julian(F.col("o_orderdate").cast("date")).alias("julian"))
    return o.select("o_orderkey", "julian", X.julian_cutoff("julian", 1).alias("calendar_cutoff"),
                    (F.col("julian") - 1).alias("integer_cutoff"))


@query("scalar_prefix_strip", oracle="""
SELECT c_custkey, regexp_replace(c_name, '^Customer#', '') AS stripped, upper(substring(c_name, 3)) AS tail_upper,
  lower(c_name) AS lowered FROM customer""")
def scalar_prefix_strip(reg):
    c = reg.table("customer")
    return c.select("c_custkey", X.prefix_strip("c_name", "Customer#").alias("stripped"),
                    F.upper(F.substring("c_name", 3, 1 << 30)).alias("tail_upper"), F.lower("c_name").alias("lowered"))
