"""Model checks: one row per issue (level, code, message) for a declared model.

Schema checks run in the driver against ``df.schema`` (no data read). Data probes — PK uniqueness,
PK NULLs, fan-out of each join's right key, rows an INNER join would drop — are each a bounded
aggregate; they are combined into one union so Spark runs them as one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.plans.model import ModelError, ModelSpec, plan_joins
from kestrel.sources.tables import TableRegistry, platform_type

ISSUE_SCHEMA = T.StructType([T.StructField("level", T.StringType()), T.StructField("code", T.StringType()),
                             T.StructField("message", T.StringType())])

# Recency columns must sort newest-first.
SORTABLE_RECENCY = ("integer", "float", "date", "datetime")


def _types(reg: TableRegistry, table: str) -> dict[str, str | None]:
    return {f.name: platform_type(f.dataType) for f in reg.table(table).schema.fields}


def schema_issues(reg: TableRegistry, spec: ModelSpec) -> list[tuple[str, str, str]]:
    issues: list[tuple[str, str, str]] = []
    tables = {}
    for t in spec.tables:
        if not reg.exists(t):
            issues.append(("error", "missing_table", f"table {t} not found"))
        else:
            tables[t] = _types(reg, t)
    for a in spec.attributes:
        cols = tables.get(a.source_table)
        if cols is None:
            continue
        if a.source_column not in cols:
            issues.append(("error", "missing_column", f"{a.source_table}.{a.source_column} not found"))
        elif cols[a.source_column] is None:
            issues.append(("error", "unsupported_type", f"Unsupported source data type for {a.name}"))
        elif a.data_type and a.data_type != cols[a.source_column]:
            issues.append(("error", "type_mismatch",
                           f"{a.name}: declared {a.data_type}, source is {cols[a.source_column]}"))
    if spec.pk is None:
        issues.append(("error", "pk_unmapped", "model has no primary key attribute"))
    elif spec.pk.source_table in tables:
        field = next((f for f in reg.table(spec.pk.source_table).schema.fields if f.name == spec.pk.source_column), None)
        if field is not None and field.nullable:
            issues.append(("warning", "pk_nullable",
                           "Primary key source column is nullable. Ensure values are unique and not null."))
        if spec.pk.source_table in getattr(reg, "_derived", {}):
            issues.append(("warning", "view_pk", "Primary key comes from a derived view: uniqueness is not enforced"))
    issues += join_type_issues(tables, spec)
    try:
        _, warns = plan_joins(spec)
        issues += [("warning", w["code"], w["message"]) for w in warns]
    except ModelError as e:
        issues += [("error", i["code"], i["message"]) for i in e.issues]
    if spec.latest is not None:
        issues += recency_issues(tables, spec)
    for j in spec.joins:
        if j.how == "inner":
            issues.append(("warning", "inner_join", f"INNER join to {j.right_table}: unmatched base rows vanish"))
        if j.allow_fanout:
            issues.append(("warning", "allow_fanout", f"join to {j.right_table} may multiply rows (allow_fanout)"))
    return issues


def join_type_issues(tables: dict, spec: ModelSpec) -> list[tuple[str, str, str]]:
    out = []
    for j in spec.joins:
        lt, rt = tables.get(j.left_table, {}), tables.get(j.right_table, {})
        a, b = lt.get(j.left_column), rt.get(j.right_column)
        if j.left_column in lt and j.right_column in rt and a != b:
            out.append(("error", "join_type_mismatch",
                        f"{j.left_table}.{j.left_column} ({a}) vs {j.right_table}.{j.right_column} ({b})"))
    return out


def recency_issues(tables: dict, spec: ModelSpec) -> list[tuple[str, str, str]]:
    out = []
    keyed = [spec.base_table] + [j.right_table for j in spec.joins]
    for t in keyed:
        rec = spec.latest.recency_for(t)
        cols = tables.get(t, {})
        if rec not in cols:
            out.append(("error", "recency_column", f"Recency column '{rec}' not found in {t}"))
        elif cols[rec] not in SORTABLE_RECENCY:
            out.append(("error", "recency_column", f"Recency column '{rec}' in {t} is not sortable ({cols[rec]})"))
    return out


def _issue(df: DataFrame, when, level: str, code: str, message) -> DataFrame:
    return df.filter(when).select(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"))


def key_groups(df: DataFrame, key: str) -> DataFrame:
    """One row from one pass: ``most`` rows of any non-null key value, and ``nulls``."""
    grouped = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(F.max(F.when(F.col(key).isNotNull(), F.col("n"))).alias("most"),
                       F.coalesce(F.max(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("nulls"))


def data_probes(reg: TableRegistry, spec: ModelSpec) -> DataFrame | None:
    """PK duplicates and NULLs of the base table, fan-out of each non-fanout join key, rows each INNER join drops,
    wherever in the chain it stands."""
    parts: list[DataFrame] = []
    if spec.pk is not None and spec.latest is None:
        seen = key_groups(reg.table(spec.base_table), spec.pk.source_column)
        both = F.array(
            F.struct((F.col("most") > 1).alias("found"), F.lit("error").alias("level"), F.lit("pk_not_unique").alias("code"),
                     F.lit(f"primary key {spec.pk.name} is not unique").alias("message")),
            F.struct((F.col("nulls") > 0).alias("found"), F.lit("warning").alias("level"), F.lit("pk_nulls").alias("code"),
                     F.concat(F.lit(f"primary key {spec.pk.name} has "), F.col("nulls").cast("string"), F.lit(" NULL values")).alias("message")))
        parts.append(seen.select(F.inline(both)).filter("found").drop("found"))
    for j in spec.joins:
        left, right = reg.table(j.left_table), reg.table(j.right_table)
        if j.how == "inner":
            keys = right.select(F.col(j.right_column).alias("_k"))
            dropped = left.join(keys, left[j.left_column] == F.col("_k"), "left_anti").agg(F.count(F.lit(1)).alias("n"))
            whose = "base" if j.left_table == spec.base_table else j.left_table
            parts.append(_issue(dropped, "n > 0", "warning", "inner_join_drop", F.concat(
                F.lit(f"INNER join to {j.right_table} drops "), F.col("n").cast("string"), F.lit(f" {whose} rows"))))
        if spec.latest is None and not j.allow_fanout:
            parts.append(_issue(key_groups(right, j.right_column), "most > 1", "error", "fanout", F.lit(
                f"join key {j.right_table}.{j.right_column} is not unique; set allow_fanout to permit 1:N")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def model_check(spark: SparkSession, reg: TableRegistry, spec: ModelSpec, probe: bool = True) -> DataFrame:
    rows = schema_issues(reg, spec)
    issues = spark.createDataFrame(rows, ISSUE_SCHEMA)
    if probe and not any(r[0] == "error" and r[1] in ("missing_table", "missing_column") for r in rows):
        probes = data_probes(reg, spec)
        if probes is not None:
            issues = issues.unionByName(probes)
    return issues


def pk_null_count(df: DataFrame, pk: str) -> DataFrame:
    return df.agg(F.count_if(F.col(pk).isNull()).alias("pk_nulls"))
