"""Query catalog: each registered query is (spark, sf_dir) -> DataFrame, with optional oracle SQL.

The oracle SQL is an independent formulation of the same result for DuckDB over the same parquet
tables; column names match the Spark result exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kestrel.sources.tables import TableRegistry, registry


@dataclass
class Entry:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    kind: str  # O (oracle), R (rows only), S (sandbox write, read back)


class Catalog:
    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def query(self, key: str, oracle: str | None = None, kind: str | None = None):
        def deco(fn: Callable[[TableRegistry], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(registry(spark, sf_dir))

            run.__name__ = key
            run.__doc__ = fn.__doc__
            if key in self.entries:
                raise KeyError(f"duplicate query key {key}")
            self.entries[key] = Entry(key, run, oracle, kind or ("O" if oracle else "R"))
            return fn

        return deco


CATALOG = Catalog()
query = CATALOG.query
