"""Tables bucketed by a key: joins and aggregations on that key need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from kestrel.session import work_dir


def bucketed(df: DataFrame, key: str, purpose: str, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder, cut and sorted by ``key`` into ``buckets`` (default: the shuffle
    partitions), and read it back. Tables with as many buckets join on the key bucket by bucket.

    ``dealt`` says that ``df`` comes bucket by bucket already (it was made from such tables by joins on the key), so
    that no shuffle is needed; each task then writes the one bucket it holds. The catalog's entry is dropped at once:
    what is returned keeps the layout, and the files go with the application's other work folders.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"kestrel_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, key)
    rows.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", f"{work_dir(spark, purpose)}/data").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out
