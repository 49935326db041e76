"""Counts and extremes from Parquet footers: aggregates that Spark pushes into the scan, so that no column is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

V1_LIST = "spark.sql.sources.useV1SourceList"
PUSHDOWN = "spark.sql.parquet.aggregatePushdown"


def footer_frame(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table through the reader that takes aggregates. It is one for counts and extremes only: the common
    reader knows more ways to prune and join."""
    before = spark.conf.get(V1_LIST)
    spark.conf.set(PUSHDOWN, "true")  # read when the plan is made; other reads are of the common kind and don't see it
    spark.conf.set(V1_LIST, ",".join(s for s in before.split(",") if s.strip() != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(V1_LIST, before)


def extremes(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row: ``row_count``, ``least`` and ``greatest`` of a column of whole numbers or dates; nulls are counted as
    rows, an empty table has nulls. Of other types (times, text, decimals) Spark reads the column instead, with the
    same result. The files must have their footers' statistics: a file without fails rather than being skipped."""
    df = footer_frame(spark, path)
    found = df.agg(F.count(F.lit(1)).alias("row_count"), F.min(column).alias("least"), F.max(column).alias("greatest"))
    none = spark.range(1).select(F.lit(0).cast("long").alias("row_count"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("least", "greatest")])
    whole = found.unionByName(none)  # pushed, the count of a file without row groups is null
    return whole.agg(F.sum("row_count").alias("row_count"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
