"""Partial aggregates kept per load and folded when asked: totals of a growing table without its old rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.scalars import exact_parts, joined_parts, rounded


def partials(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """A row per group of one load: its rows and, for each measure, the parts that a later fold needs: exact and left-out
    sum, plain sum, number of values, least and greatest. One combined shuffle of the groups."""
    parts = [F.count(F.lit(1)).alias("rows")]
    for m in measures:
        exact, rest = exact_parts(m)
        parts += [exact.alias(f"{m}__exact"), rest.alias(f"{m}__rest"), F.sum(F.col(m).cast("double")).alias(f"{m}__plain"),
                  F.count(m).alias(f"{m}__n"), F.min(m).alias(f"{m}__min"), F.max(m).alias(f"{m}__max")]
    return df.groupBy(*keys).agg(*parts)


def folded(kept: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Totals per group over the kept parts of all loads: ``rows`` and, for each measure, ``_sum``, ``_avg``, ``_n``, ``_min``
    and ``_max``; sum and average are rounded once, as over all rows. A sum that overflowed in one load does so in all."""
    out = [F.sum("rows").alias("rows")]
    for m in measures:
        n, lost = F.sum(f"{m}__n"), F.bool_or(F.col(f"{m}__exact").isNull() & (F.col(f"{m}__n") > 0))
        total = F.when(~lost, joined_parts(F.try_sum(f"{m}__exact"), F.sum(f"{m}__rest")))
        plain = F.sum(f"{m}__plain")
        out += [rounded(total, plain).alias(f"{m}_sum"), rounded(F.try_divide(total, n), F.try_divide(plain, n)).alias(f"{m}_avg"),
                n.alias(f"{m}_n"), F.min(f"{m}__min").alias(f"{m}_min"), F.max(f"{m}__max").alias(f"{m}_max")]
    return kept.groupBy(*keys).agg(*out)


def add_load(store, table: str, load: DataFrame, keys: list[str], measures: list[str]) -> dict:
    """Append a load's parts to the kept ones. Loads are whole and come once: insert-if-absent their rows first."""
    return store.append(table, partials(load, keys, measures))


def totals(store, table: str, keys: list[str], measures: list[str]) -> DataFrame:
    """The folded totals; reads the kept parts only, some groups a load."""
    return folded(store.read(table), keys, measures)
