"""Validated JSON ingest for declared ("Type A") models: accepted rows and rejected (record, field, message).

Validation is pure Spark SQL over VARIANT: ``try_parse_json`` once per record, then per attribute
``schema_of_variant(try_variant_get(v, '$.name', 'variant'))`` gives the JSON kind, so
``"5"`` is not an integer, ``true`` is not a number and ``5.0`` is not an integer, as the rules
require. No Python UDF; every record is checked in the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.scalars import ISO_DATE_PATTERN, ISO_DATETIME_PATTERN
from kestrel.sources.tables import spark_type

# The system columns of a declared model's table, in order.
SYSTEM_COLUMNS = ("id", "raw_payload", "created_at", "updated_at")

# Validation messages.
MESSAGES = {
    "required": "is required",
    "text": "must be a string",
    "integer": "must be an integer",
    "float": "must be a number",
    "boolean": "must be a boolean",
    "date": "must be a valid ISO date YYYY-MM-DD",
    "datetime": "must be a valid ISO datetime string",
    "date_kind": "must be an ISO date string",
    "datetime_kind": "must be an ISO datetime string",
    "json": "must be an object or array",
    "body": "must be a flat JSON object",
}


@dataclass(frozen=True)
class Field:
    name: str
    data_type: str
    required: bool = False


def _type_ok(val: Column, kind: Column, data_type: str) -> Column:
    if data_type == "text":
        return kind == "STRING"
    if data_type == "integer":
        return kind == "BIGINT"
    if data_type == "float":
        return (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    if data_type == "boolean":
        return kind == "BOOLEAN"
    if data_type in ("date", "datetime"):
        s = F.try_variant_get(val, "$", "string")
        if data_type == "date":
            return (kind == "STRING") & s.rlike(ISO_DATE_PATTERN) & s.try_cast("date").isNotNull()
        norm = F.regexp_replace(s, "Z$", "")
        return (kind == "STRING") & s.rlike(ISO_DATETIME_PATTERN) & norm.try_cast("timestamp").isNotNull()
    if data_type == "json":
        return kind.startswith("OBJECT") | kind.startswith("ARRAY")
    raise ValueError(f"unknown type {data_type}")


def _message(kind: Column, data_type: str) -> Column:
    """Dates that are no text at all are told apart from texts that are no date."""
    if data_type not in ("date", "datetime"):
        return F.lit(MESSAGES[data_type])
    return F.when(kind == "STRING", MESSAGES[data_type]).otherwise(MESSAGES[f"{data_type}_kind"])


def _typed(val: Column, data_type: str) -> Column:
    if data_type == "json":
        return F.to_json(val)
    if data_type == "date":
        return F.try_variant_get(val, "$", "string").try_cast("date")
    if data_type == "datetime":
        s = F.regexp_replace(F.try_variant_get(val, "$", "string"), "Z$", "")
        return F.regexp_replace(s, r"[+-]\d{2}:?\d{2}$", "").try_cast("timestamp_ntz")
    return F.try_variant_get(val, "$", spark_type(data_type).simpleString())


def _f(name: str) -> str:
    return f"_f_{name}"


def _k(name: str) -> str:
    return f"_k_{name}"


def validate(records: DataFrame, fields: list[Field], payload_col: str = "payload") -> DataFrame:
    """Adds ``_errors`` (array<struct<field,message>>, empty = valid), ``_v`` and per-field ``_f_*``.

    Staged projections: the payload is parsed once, each field's value and JSON kind are extracted
    once into columns, and the checks read those columns (variant expressions are not code-generated,
    so without staging every reference would re-run the extraction).
    """
    parsed = records.withColumn("_v", F.try_parse_json(F.col(payload_col)))
    vals = parsed.select("*", F.schema_of_variant(F.col("_v")).alias("_k_body"),
                         *[F.try_variant_get(F.col("_v"), f"$.{f.name}", "variant").alias(_f(f.name)) for f in fields])
    kinds = vals.select("*", *[F.schema_of_variant(F.col(_f(f.name))).alias(_k(f.name)) for f in fields])
    body_bad = F.col("_v").isNull() | ~F.col("_k_body").startswith("OBJECT")
    checks = []
    for f in fields:
        val, kind = F.col(_f(f.name)), F.col(_k(f.name))
        missing = val.isNull() | (kind == "VOID")
        err = F.when(missing & F.lit(f.required), F.struct(F.lit(f.name).alias("field"),
                                                            F.lit(MESSAGES["required"]).alias("message"))) \
            .when(~missing & ~_type_ok(val, kind, f.data_type),
                  F.struct(F.lit(f.name).alias("field"), _message(kind, f.data_type).alias("message")))
        checks.append(err)
    field_errs = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array()
    body = F.array(F.struct(F.lit("body").alias("field"), F.lit(MESSAGES["body"]).alias("message")))
    out = kinds.withColumn("_errors", F.when(body_bad, body).otherwise(field_errs))
    return out.drop("_k_body", *[_k(f.name) for f in fields])


def accepted(validated: DataFrame, fields: list[Field], payload_col: str = "payload",
             keep: list[str] | None = None) -> DataFrame:
    """Valid records as typed attribute columns + raw_payload; unknown fields survive only raw.
    ``id`` is a fresh uuid; created/updated are the ingest clock.

    Rows are selected with ``inline`` over a 0-or-1 element array instead of a Filter: a Filter would
    be pushed below the staged projections and re-evaluate every extraction inside one predicate.
    """
    row = F.struct(*[F.col(k) for k in (keep or [])], F.col(payload_col).alias("raw_payload"),
                   *[_typed(F.col(_f(f.name)), f.data_type).alias(f.name) for f in fields])
    valid_rows = F.filter(F.array(row), lambda _: F.size(F.col("_errors")) == 0)
    ok = validated.select(F.inline(valid_rows))
    return ok.select(*(keep or []), F.expr("uuid()").alias("id"), "raw_payload",
                     F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
                     *[f.name for f in fields])


def rejected(validated: DataFrame, record_key: str) -> DataFrame:
    """One row per (record, field, message); valid records have no errors and so produce no rows.

    ``explode_outer`` + a filter on the generated column: plain ``explode`` makes Spark infer
    ``size(_errors) > 0`` and push it below the staged projections (re-running every extraction).
    """
    return (validated.select(F.col(record_key), F.explode_outer("_errors").alias("e"))
            .filter(F.col("e").isNotNull())
            .select(record_key, F.col("e.field").alias("field"), F.col("e.message").alias("message")))


def model_schema(fields: list[Field]):
    """System columns first, then the attributes in declared order."""
    from pyspark.sql import types as T

    sys_cols = [T.StructField("id", T.StringType(), False), T.StructField("raw_payload", T.StringType(), True),
                T.StructField("created_at", T.TimestampNTZType(), True),
                T.StructField("updated_at", T.TimestampNTZType(), True)]
    return T.StructType(sys_cols + [T.StructField(f.name, spark_type(f.data_type), not f.required) for f in fields])


def evolve_add_columns(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Additive evolution: add declared columns missing from old data as typed NULLs; never drop."""
    out = df
    for f in fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(spark_type(f.data_type)))
    return out
