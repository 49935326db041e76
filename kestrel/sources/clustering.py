"""Rows laid out along a Z-order curve over several columns, so that Parquet statistics prune on each of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 10
ACCURACY = 20_000
TEXT_BYTES = 6  # of a text's start; whole numbers of so many bytes are exact as doubles


def ordinal(name: str, kind: T.DataType) -> Column:
    """A double in the order of the column (of a text: of its first bytes)."""
    x = F.col(name)
    if isinstance(kind, T.StringType):
        start = F.rpad(F.hex(F.substring(F.encode(x, "utf-8"), 1, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
        return F.conv(start, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return x.cast("timestamp").cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return x.cast("double")
    raise TypeError(f"no order for {name}, a column of {kind.simpleString()}")


def rank(x: Column, bounds: list[float], bits: int) -> Column:
    """How many of the 2**bits - 1 sorted bounds lie below ``x``, by halving; null: none."""
    held, steps = F.lit([float(b) for b in bounds]), F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.get(held, i + step - 1) < x, i + step).otherwise(i))


def interleaved(ranks: list[Column], bits: int) -> Column:
    """One long whose bits are those of the ranks in turn."""
    n = len(ranks)
    pieces = [F.shiftleft(F.shiftright(r, b).bitwiseAND(F.lit(1)).cast("long"), b * n + c) for b in range(bits) for c, r in enumerate(ranks)]
    return reduce(Column.bitwiseOR, pieces)


def clustered(df: DataFrame, columns: list[str], parts: int | None = None, bits: int = BITS) -> DataFrame:
    """``df`` range-partitioned and sorted by its place on the Z-order curve over the ranks of ``columns``.

    Ranks come from approximate quantiles (one aggregation; 2**bits - 1 numbers a column pass the driver), so skewed
    columns are cut as evenly as others; equal values share a rank and a hot one may fill several files by the other
    columns. The result has the rows and columns of ``df``, which is read three times (quantiles, sampling, rows):
    give a written table. Without ``parts`` Spark sizes the files. No columns or no rows: ``df`` as it is.
    """
    if not columns:
        return df
    bits = min(bits, 62 // len(columns))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    shares = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    found = df.agg(*[F.percentile_approx(F.nanvl(ordinal(c, kinds[c]), F.lit(None).cast("double")), shares, ACCURACY).alias(f"b{i}")
                     for i, c in enumerate(columns)]).first()
    ranked = [(c, bounds) for c, bounds in zip(columns, found) if bounds is not None]  # a column of nulls orders nothing
    if not ranked:
        return df
    temp = [f"_kestrel_rank{i}" for i in range(len(ranked))]
    out = df.select("*", *[rank(ordinal(c, kinds[c]), bounds, bits).alias(t) for t, (c, bounds) in zip(temp, ranked)])
    out = out.withColumn("_kestrel_z", interleaved([F.col(t) for t in temp], bits)).drop(*temp)
    dealt = out.repartitionByRange(parts, "_kestrel_z") if parts else out.repartitionByRange("_kestrel_z")
    return dealt.sortWithinPartitions("_kestrel_z").drop("_kestrel_z")
