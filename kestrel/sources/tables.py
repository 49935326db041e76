"""Table registry over a directory of parquet tables, plus platform type mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

def platform_type(dt: T.DataType) -> str | None:
    """Spark type -> platform type; None means the type cannot be mapped (arrays, maps, binary...)."""
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return None


def spark_type(platform: str) -> T.DataType:
    return {
        "text": T.StringType(),
        "integer": T.LongType(),
        "float": T.DoubleType(),
        "boolean": T.BooleanType(),
        "date": T.DateType(),
        "datetime": T.TimestampNTZType(),
        "json": T.StringType(),
    }[platform]


class TableRegistry:
    """Named parquet tables under one folder, read on first use (``register_views`` exposes them to SQL).

    Reads are lazy: only the columns and rows a plan needs reach the parquet scan.
    """

    def __init__(self, spark: SparkSession, root: str, extra: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.root = root
        self._frames: dict[str, DataFrame] = extra if extra is not None else {}  # source tables (shareable)
        self._derived: dict[str, DataFrame] = {}  # frames registered by one query
        self._fs = None

    def _on_disk(self, name: str) -> bool:
        if self._fs is None:
            from kestrel.sources.fs import HadoopFS

            self._fs = HadoopFS(self.spark)
        return self._fs.exists(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}.parquet"

    def exists(self, name: str) -> bool:
        return name in self._derived or name in self._frames or self._on_disk(name)

    def table(self, name: str) -> DataFrame:
        if name in self._derived:
            return self._derived[name]
        if name not in self._frames:
            if not self._on_disk(name):
                raise KeyError(f"table not found: {name}")
            self._frames[name] = self.spark.read.parquet(self.path(name))
        return self._frames[name]

    def register(self, name: str, df: DataFrame) -> DataFrame:
        self._derived[name] = df
        return df

    def register_views(self, names: tuple[str, ...] | list[str] = tuple(DRIVER_TABLES)) -> "TableRegistry":
        """Expose the tables to ``spark.sql`` under their names."""
        for n in names:
            if self.exists(n):
                self.table(n).createOrReplaceTempView(n)
        return self

    def names(self) -> list[str]:
        on_disk = [n for n in DRIVER_TABLES if n in self._frames or self._on_disk(n)]
        return sorted(set(on_disk) | set(self._frames) | set(self._derived))



def registry(spark: SparkSession, sf_dir: str) -> TableRegistry:
    """A registry over ``sf_dir`` whose tables are listed and read on first use. Each call lists anew, so files that
    have come since are seen; derived frames registered by a query stay its own."""
    return TableRegistry(spark, sf_dir)
