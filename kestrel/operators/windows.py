"""Window operators: newest row per key, share of total, last run per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str | list[str], recency: str, tiebreak: str | None = None) -> DataFrame:
    """Newest row per key: recency DESC NULLS LAST, then tiebreak DESC with NULL first.

    ``row_number() = 1`` lets Spark plan a partial ``WindowGroupLimit`` below the shuffle, so a key
    holding a third of all rows leaves at most one row per map partition before the exchange.
    Rows whose key is NULL form one group and collapse to a single row.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(recency).desc_nulls_last()]
    if tiebreak:
        order.append(F.col(tiebreak).desc_nulls_first())
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
    return df.withColumn("_kestrel_rn", F.row_number().over(w)).filter(F.col("_kestrel_rn") == 1).drop("_kestrel_rn")


def with_share_of_total(grouped: DataFrame, count_col: str = "count", out: str = "ratio", scale: int = 4) -> DataFrame:
    """``out`` = count / sum of the counts of all groups, computed before any LIMIT.

    The total is a scalar subquery over the grouped rows, so the table is read once: Spark reuses the grouped
    exchange, and no un-partitioned window pulls every group into one task.
    """
    total = grouped.select(F.sum(count_col)).scalar()
    return grouped.withColumn(
        out, F.round(F.col(count_col).cast("decimal(38,10)") / total.cast("decimal(38,10)"), scale).cast("double"))


def latest_by(df: DataFrame, key: str | list[str], order_col: str, value_cols: list[str]) -> DataFrame:
    """Per key, the values of the row with the greatest ``order_col`` (ties: greatest values).

    A plain aggregate (``max`` of a struct) so Spark combines map-side; no window sort of a hot key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    packed = F.max(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in value_cols])).alias("_m")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in value_cols])
