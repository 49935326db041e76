"""Key-quality and watermark aggregates, table counts, log rollups.

Everything a validation needs from one table is computed in one scan where possible: counts, NULL
counts and min/max share a single aggregate; duplicate keys need one extra grouped aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.scalars import bucket, plain_number, text_number


def count_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``<col>_nulls`` for every column, in a single pass."""
    return df.agg(*[F.count_if(F.col(x).isNull()).alias(f"{x}_nulls") for x in columns])


def duplicate_key_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups with more than one row; NULL keys group together (as GROUP BY does)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def count_duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return duplicate_key_groups(df, keys).agg(F.count(F.lit(1)).alias("duplicate_keys"),
                                              F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_duplicates"))


def has_duplicates(df: DataFrame, keys: list[str]) -> bool:
    """Stops at the first offending group: ``limit(1)`` over the grouped result."""
    return not duplicate_key_groups(df, keys).limit(1).isEmpty()


def min_max_watermark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).cast("string").alias("min_watermark"),
                  F.max(column).cast("string").alias("max_watermark"))


def max_watermark_numeric(df: DataFrame, column: str) -> DataFrame:
    """Numeric max over a text column: '' as NULL; rendered without an exponent or trailing zeros."""
    return df.agg(plain_number(F.max(text_number(column))).alias("max_watermark"))


def max_watermark_pair(df: DataFrame, day_col: str, time_col: str) -> DataFrame:
    """Latest (day, time) pair, NULL days ignored; struct max = lexicographic (day, time)."""
    m = F.max(F.when(F.col(day_col).isNotNull(), F.struct(F.col(day_col).alias("d"), F.col(time_col).alias("t"))))
    return df.agg(m.alias("_m")).select(F.col("_m.d").alias("max_day"), F.col("_m.t").alias("max_time"))


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Exact row count per table as one union of global aggregates (one job, one stage per table)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def row_count_estimate(frames: dict[str, DataFrame]) -> DataFrame:
    """Row count per table from parquet footers: a count with no columns reads only row-group
    metadata; all tables in one job (a union of global aggregates)."""
    return table_counts(frames).withColumnRenamed("row_count", "row_estimate")


def distinct_dimension_counts(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [df.agg(F.count(F.col(k)).alias("keys"), F.count_distinct(F.col(k)).alias("distinct_keys"))
             .select(F.lit(name).alias("table_name"), "keys", "distinct_keys",
                     (F.col("keys") == F.col("distinct_keys")).alias("is_distinct"))
             for name, (df, k) in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def status_counts(df: DataFrame, status_col: str) -> DataFrame:
    """Count per status plus the total of all, a scalar subquery over the grouped rows (one scan of the table)."""
    grouped = df.groupBy(status_col).agg(F.count(F.lit(1)).alias("count"))
    return grouped.withColumn("total", grouped.select(F.coalesce(F.sum("count"), F.lit(0)).cast("long")).scalar())


def series_by_status(df: DataFrame, ts_col: str, status_col: str, start: str, end: str, unit: str = "hour") -> DataFrame:
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return (df.filter((F.col(ts_col) >= lo) & (F.col(ts_col) <= hi))
            .groupBy(bucket(unit, ts_col).alias("time"), F.col(status_col))
            .agg(F.count(F.lit(1)).alias("count")))


def column_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """Per (table, column): non-NULL count, from one aggregate per table, unpivoted to rows."""
    parts = []
    for name, df in frames.items():
        counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
        parts.append(counts.unpivot([], df.columns, "column_name", "non_null")
                     .select(F.lit(name).alias("table_name"), "column_name", "non_null"))
    return reduce(DataFrame.unionByName, parts)


def first_column_unique(frames: dict[str, DataFrame]) -> DataFrame:
    """Per table: is the first column a usable key (no NULLs, no duplicates)?"""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.count(df.columns[0]).alias("non_null"),
                    F.count_distinct(df.columns[0]).alias("distinct"))
             .select(F.lit(name).alias("table_name"),
                     ((F.col("rows") == F.col("non_null")) & (F.col("non_null") == F.col("distinct"))).alias("pk_unique"))
             for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)
