"""Point lookups without a scan: Parquet Bloom filters for key columns that the file order says nothing about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 32 << 20
IN_ONE_TEST = 10  # values of an IN that Spark hands to Parquet one by one (spark.sql.parquet.pushdown.inFilterThreshold)


def write_indexed(df: DataFrame, path: str, keys: list[str], rows_per_group: int = 1 << 20, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write ``df`` with a Bloom filter of each of ``keys`` in every row group, made for ``rows_per_group`` distinct
    values (about 1.2 bytes each at 1 % false hits), and without their dictionaries, which would take the filters' place."""
    w = df.write.option("parquet.block.size", row_group_bytes)
    for k in keys:
        w = (w.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", rows_per_group)
             .option(f"parquet.enable.dictionary#{k}", "false"))
    w.parquet(path)


def any_of(key: str, values: list) -> Column:
    """``key`` is one of ``values``, in tests small enough to reach the row groups' filters. No values: false."""
    tests = [F.col(key).isin(values[i:i + IN_ONE_TEST]) for i in range(0, len(values), IN_ONE_TEST)]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def lookup(indexed: DataFrame, key: str, values: list) -> DataFrame:
    """The rows with one of ``values``, given by the caller (a handful; more belong in a table and a join). Row groups
    whose filter has none of them are not read. ``values`` are of the column's type, as a cast would keep the test from
    Parquet; nulls match nothing."""
    return indexed.filter(any_of(key, [v for v in values if v is not None]))
