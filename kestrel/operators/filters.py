"""Filters, lookups, paging and projection helpers over model DataFrames.

Filter values are coerced in the driver against the column's platform type and enter the plan as
typed literals, so Catalyst pushes them into the parquet scan (``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.primitives import (FunctionError, coerce_value, condition, exposed_types, time_filter,
                                          typed_literal)

class LookupError_(ValueError):
    pass


def json_equal(colm: Column, value_json: str) -> Column:
    """Structural JSON equality: both sides parsed to VARIANT (keys sorted) and rendered back."""
    return F.to_json(F.try_parse_json(colm)) == F.to_json(F.parse_json(F.lit(value_json)))


def filter_equals(df: DataFrame, filters: dict[str, str], types: dict | None = None) -> DataFrame:
    """AND of ``column = value``; values coerced by declared type; unknown columns are an error."""
    types = types or exposed_types(df)
    unknown = sorted(set(filters) - set(types))
    if unknown:
        raise FunctionError(f"filter is not defined on this data model: {', '.join(unknown)}", 422)
    for name, raw in filters.items():
        v = coerce_value(raw, types[name], name)
        if types[name] == "json":
            df = df.filter(json_equal(F.col(name), _dumps(v)))
        else:
            df = df.filter(F.col(name) == typed_literal(v, types[name]))
    return df


def _dumps(v) -> str:
    import json

    return json.dumps(v)


def filter_condition(df: DataFrame, where: str, types: dict | None = None) -> DataFrame:
    return df.filter(condition(where, types or exposed_types(df)))


def filter_time_range(df: DataFrame, date_col: str, start: str | None, end: str | None,
                      types: dict | None = None) -> DataFrame:
    """Inclusive ``start <= date_col <= end``; a bare-date end on a datetime means that midnight."""
    types = types or exposed_types(df)
    cond = time_filter({"from": start, "to": end}, date_col, types)
    return df if cond is None else df.filter(cond)


def filter_past_due(df: DataFrame, due_col: str, as_of: str | None = None) -> DataFrame:
    ref = F.lit(as_of).cast("date") if as_of else F.current_date()
    return df.filter(ref >= F.col(due_col).cast("date"))


def filter_last_window(df: DataFrame, ts_col: str, as_of: str, days: int = 120) -> DataFrame:
    """Rolling range ``as_of - days .. as_of`` on a timestamp (both ends inclusive)."""
    end = F.lit(as_of).cast("timestamp_ntz")
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return df.filter((F.col(ts_col) >= start) & (F.col(ts_col) <= end))


def lookup_by_key(df: DataFrame, pk: str, value: str, model_type: str = "B",
                  types: dict | None = None) -> DataFrame:
    """One row by key. Type A takes the first match; type B reads two and the caller must reject 2."""
    types = types or exposed_types(df)
    v = typed_literal(coerce_value(value, types[pk], pk), types[pk])
    return df.filter(F.col(pk) == v).limit(1 if model_type == "A" else 2)


def require_single(rows: list) -> object:
    if len(rows) > 1:
        raise LookupError_("more than one row for this key: the model key is not unique")
    if not rows:
        raise LookupError_("not found")
    return rows[0]


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, after: Column | None = None) -> DataFrame:
    """Rows in a total order: all of them, or the ``limit`` first ones after ``offset``.

    Deep pages go on from a row: ``after`` is a condition that holds for the rows behind the last one seen (see
    :func:`after_key`), so a page costs its own rows, and not all before it as an offset does.
    """
    if offset < 0 or limit is not None and limit < 1:
        raise FunctionError("offset must be >= 0 and limit >= 1")
    rows = (df if after is None else df.filter(after)).orderBy(*order)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def after_key(key: str, value) -> Column:
    """Rows behind ``value`` in ascending order of a key, null last."""
    return F.col(key).isNull() | (F.col(key) > F.lit(value))


def after_created(created_col: str, key: str, created, value) -> Column:
    """Rows behind (created, value) in the order newest first, then by key."""
    at = F.lit(created).cast("timestamp_ntz") if isinstance(created, str) else F.lit(created)
    return F.col(created_col).isNull() | (F.col(created_col) < at) | (F.col(created_col) == at) & (F.col(key) > F.lit(value))


def page_by_created(df: DataFrame, created_col: str, key: str, limit: int | None = None, offset: int = 0, after: Column | None = None) -> DataFrame:
    return page(df, [F.col(created_col).desc_nulls_last(), F.col(key).asc()], limit, offset, after)


def page_by_key(df: DataFrame, key: str, limit: int | None = None, offset: int = 0, after: Column | None = None) -> DataFrame:
    return page(df, [F.col(key).asc_nulls_last()], limit, offset, after)


def preview_page(df: DataFrame, key: str, limit: int = 20) -> DataFrame:
    return page(df, [F.col(key).asc_nulls_last()], limit)


def table_preview(df: DataFrame, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of raw rows in key order with ``has_more`` and a row-count estimate.

    ``limit + 1`` rows are read; the extra row only sets ``has_more``, and numbering them takes one task as many
    rows as the caller asks for. The estimate is a count with no columns, which parquet answers from file footers.
    """
    rows = page(df, [F.col(key).asc_nulls_last()], limit + 1, offset)
    w = Window.orderBy(F.col(key).asc_nulls_last())
    numbered = rows.withColumn("_kestrel_rn", F.row_number().over(w))
    has_more = numbered.select(F.max("_kestrel_rn") > limit).scalar()
    estimate = df.select(F.count(F.lit(1))).scalar()
    return (numbered.filter(F.col("_kestrel_rn") <= limit).drop("_kestrel_rn")
            .withColumn("has_more", has_more).withColumn("row_estimate", estimate))


def filter_facets(df: DataFrame, facets: dict[str, object]) -> DataFrame:
    """Chained equality filters for the facets that are given (None = not filtered)."""
    for name, value in facets.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def filter_search(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Case-insensitive substring over the space-joined columns (NULLs skipped by concat_ws)."""
    hay = F.lower(F.concat_ws(" ", *[F.col(x).cast("string") for x in columns]))
    return df.filter(hay.contains(needle.lower()))


def filter_log(df: DataFrame, filters: dict[str, object], ts_col: str, key: str, limit: int = 50,
               offset: int = 0) -> DataFrame:
    return page(filter_facets(df, filters), [F.col(ts_col).desc_nulls_last(), F.col(key).desc()], limit, offset)


def mapped_projection(df: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """``select source AS attribute`` in declared order."""
    return df.select(*[F.col(src).alias(name) for name, src in mapping])


def project_meta_raw(df: DataFrame, attributes: list[str], include_meta: bool, include_raw: bool,
                     model_type: str = "A") -> DataFrame:
    cols = list(attributes)
    if include_meta:
        cols = ["id", "created_at", "updated_at", *cols]
    if include_raw and model_type == "A":
        cols = [*cols, "raw_payload"]
    return df.select(*cols)


def serialize_rows(df: DataFrame, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """Output form: decimals -> double, dates -> ISO text, datetimes -> ISO text, and the given JSON
    text columns re-rendered canonically (parsed, keys sorted, no whitespace; invalid JSON -> NULL)."""
    from pyspark.sql import types as T

    out = []
    for f in df.schema.fields:
        colm = F.col(f.name)
        if f.name in json_columns:
            colm = F.to_json(F.try_parse_json(colm))
        elif isinstance(f.dataType, T.DecimalType):
            colm = colm.cast("double")
        elif isinstance(f.dataType, T.DateType):
            colm = F.date_format(colm, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            colm = F.date_format(colm, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(F.col(f.name), ".SSSSSS")
            colm = F.concat(colm, F.when(micros == ".000000", "").otherwise(micros))
        out.append(colm.alias(f.name))
    return df.select(*out)
