"""Shared column expressions: money rounding, time buckets, value checks, identifier rules.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The platform's local time zone (naive timestamps hold its wall clock).
PLATFORM_TZ = "Asia/Ho_Chi_Minh"

#: Exact part of a sum: 26 digits before the point, 12 behind it; what does not fit is carried as a double.
WIDE = "decimal(38,12)"
PLACES = 2

# Identifier rule and strict ISO shapes.
IDENTIFIER_PATTERN = r"^[a-z][a-z0-9_]*$"
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
ISO_DATETIME_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
INTEGER_PATTERN = r"^[+-]?\d+$"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wide(x: str | Column) -> Column:
    """The value as a wide decimal; null if it has more digits before the point."""
    return c(x).try_cast(WIDE)


def exact_parts(x: str | Column) -> tuple[Column, Column]:
    """(decimal sum, double sum of what the decimals leave out). Both can be summed again after a partial sum."""
    kept = F.coalesce(wide(x), F.when(c(x).isNotNull(), F.lit(0).cast(WIDE)))
    return F.try_sum(kept), F.sum(c(x).cast("double") - kept.cast("double"))


def joined_parts(exact: Column, rest: Column) -> Column:
    """Both parts as one decimal; null if that overflows."""
    return F.try_add(exact, rest.try_cast(WIDE))


def rounded(exact: Column, otherwise: Column) -> Column:
    """Rounded once, as a double; ``otherwise`` is the plain double where the exact value overflows."""
    return F.coalesce(F.round(exact, PLACES).cast("double"), F.round(otherwise, PLACES))


def money_sum(x: str | Column) -> Column:
    """Sum of any numeric column, rounded once at the end: exact in its decimal digits whatever the order of rows,
    and a plain double sum beyond 26 digits or with NaN or infinity."""
    return rounded(joined_parts(*exact_parts(x)), F.sum(c(x).cast("double")))


def total(x: str | Column) -> Column:
    """Sum of any numeric column as a double, not rounded; as exact as :func:`money_sum`."""
    return F.coalesce(joined_parts(*exact_parts(x)).cast("double"), F.sum(c(x).cast("double")))


def money_avg(x: str | Column) -> Column:
    return rounded(F.try_divide(joined_parts(*exact_parts(x)), F.count(c(x))), F.avg(c(x).cast("double")))


def money_round(x: str | Column) -> Column:
    return rounded(wide(x), c(x).cast("double"))


def agg_value(agg: str, measure: str | None) -> Column:
    """The primitives' value column: count is a bare count, sum/avg round to 2 places."""
    if agg == "count":
        return F.count(F.lit(1))
    if agg == "sum":
        return money_sum(measure)
    if agg == "avg":
        return money_avg(measure)
    raise ValueError(f"unknown agg {agg}")


def day_bucket(x: str | Column) -> Column:
    """Day of a date/timestamp(_ntz) as DATE; independent of the session time zone."""
    return c(x).cast("date")


def month_bucket(x: str | Column) -> Column:
    return F.trunc(c(x).cast("date"), "month")


def hour_bucket(x: str | Column) -> Column:
    """Hour of a TIMESTAMP_NTZ as TIMESTAMP_NTZ (``date_trunc`` would return a zoned TIMESTAMP)."""
    col = c(x)
    return F.make_timestamp_ntz(F.year(col), F.month(col), F.dayofmonth(col), F.hour(col), F.lit(0), F.lit(0))


def bucket(unit: str, x: str | Column) -> Column:
    return {"day": day_bucket, "month": month_bucket, "hour": hour_bucket}[unit](x)


def days_between(as_of: Column, x: str | Column) -> Column:
    """as_of - date in whole days (PostgreSQL ``date - date``)."""
    return F.datediff(as_of, c(x).cast("date"))


def is_identifier(x: str | Column) -> Column:
    return c(x).rlike(IDENTIFIER_PATTERN)


def shift_hours(x: str | Column, hours: int | Column) -> Column:
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return c(x) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), h, F.lit(0), F.lit(0))


def local_time(x: str | Column, tz: str) -> Column:
    """UTC wall clock -> wall clock in ``tz`` (``ts AT TIME ZONE tz`` on a naive UTC value)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), c(x))


def julian_to_date(x: str | Column) -> Column:
    """CYYDDD (century offset, 2-digit year, day of year) -> DATE."""
    v = c(x).cast("long")
    year = F.lit(1900) + (v / 1000).cast("long")
    doy = (v % 1000).cast("int")
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), doy - 1)


def date_to_julian(d: str | Column) -> Column:
    d = c(d)
    return ((F.year(d) - 1900) * 1000 + F.dayofyear(d)).cast("long")


def julian_cutoff(cursor: str | Column, lookback_days: int) -> Column:
    """Calendar-correct cursor - lookback on CYYDDD numbers (crosses year ends)."""
    return date_to_julian(F.date_sub(julian_to_date(cursor), int(lookback_days)))


def text_number(x: str | Column) -> Column:
    """Text marker -> number with its fraction: '' is NULL, unparsable -> NULL."""
    t = F.nullif(F.trim(c(x)), F.lit(""))
    return t.try_cast(WIDE)


def plain_number(x: str | Column) -> Column:
    """A decimal as text without an exponent and without zeros behind its last decimal."""
    return F.regexp_replace(F.regexp_replace(c(x).cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


# Source (PostgreSQL) type names and the platform type each maps to.
SOURCE_TYPE_MAP = {
    "text": "text", "character varying": "text", "varchar": "text", "character": "text", "char": "text",
    "integer": "integer", "bigint": "integer", "smallint": "integer",
    "numeric": "float", "double precision": "float", "real": "float", "decimal": "float",
    "boolean": "boolean", "uuid": "text", "date": "date",
    "timestamp": "datetime", "timestamp without time zone": "datetime", "timestamp with time zone": "datetime",
    "json": "json", "jsonb": "json",
}


# The part of a type name that the map knows. What follows ``timestamp`` or ``character varying``, and the
# precision of a number, is left out; of any other name the whole counts.
KNOWN_PART = r"^(?:timestamp|character varying|(?:numeric|decimal)(?=\s*\()|.*$)"


def platform_type_of(type_name: str | Column) -> Column:
    """Source type name -> platform type (NULL = unsupported)."""
    known = F.create_map(*[F.lit(x) for pair in SOURCE_TYPE_MAP.items() for x in pair])
    return F.element_at(known, F.regexp_extract(F.lower(F.trim(c(type_name))), KNOWN_PART, 0))


def is_integer_text(x: str | Column) -> Column:
    return c(x).rlike(INTEGER_PATTERN)


def is_float_text(x: str | Column) -> Column:
    return c(x).try_cast("double").isNotNull()


def is_boolean_text(x: str | Column) -> Column:
    return F.lower(c(x)).isin("true", "false")


def is_iso_date_text(x: str | Column) -> Column:
    return c(x).rlike(ISO_DATE_PATTERN) & c(x).try_cast("date").isNotNull()


def is_iso_datetime_text(x: str | Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(c(x), "Z$", ""), r"[+-]\d{2}:?\d{2}$", "")
    return c(x).rlike(ISO_DATETIME_PATTERN) & v.try_cast("timestamp_ntz").isNotNull()


def is_json_container_text(x: str | Column) -> Column:
    k = F.schema_of_variant(F.try_parse_json(c(x)))
    return F.coalesce(k.startswith("OBJECT") | k.startswith("ARRAY"), F.lit(False))


def prefix_strip(x: str | Column, prefix: str) -> Column:
    """Remove a fixed leading prefix (regex-escaped) if present."""
    import re

    return F.regexp_replace(c(x), "^" + re.escape(prefix), "")
