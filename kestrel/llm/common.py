"""Helpers that the operators share: tables, staged tables, distributed order, words."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.session import work_dir

#: What separates words, as a character class body that Java, RE2 and Python read alike.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back: its lineage ends at those files, so a
    lost executor costs no recomputation and every later reader sees the same rows."""
    spark = df.sparkSession
    path = f"{work_dir(spark, purpose)}/data"
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt_in_order(keys: DataFrame, *by: Column) -> DataFrame:
    """``keys`` with ``part``, staged: ranges of the order ``by``, numbered upwards, each small enough for a task.
    Equal rows of ``by`` share a part."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(keys.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), "key-order")


def by_part(values: dict[int, int]) -> Column:
    """The value of the row's ``part``: one entry per partition, as a literal."""
    return F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in values.items() for x in kv]), F.col("part").cast("long"))


def next_key(keys: DataFrame, key: str) -> DataFrame:
    """(key, next): each distinct non-null key's successor in ascending order, the last one's the first.

    The keys are range-partitioned and sorted, so no task holds more than its share of them; only the first
    key of each partition passes through the driver. A single key is its own successor; no keys: no rows.
    """
    ids = keys.select(F.col(key).cast("long").alias("key")).filter("key IS NOT NULL").distinct()
    dealt = dealt_in_order(ids, F.col("key"))
    first = sorted(map(tuple, dealt.groupBy("part").agg(F.min("key")).collect()))  # one row per partition
    if not first:
        return dealt.select("key", F.col("key").alias("next"))
    after = by_part({p: first[(i + 1) % len(first)][1] for i, (p, _) in enumerate(first)})
    within = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return dealt.select("key", F.coalesce(within, after).alias("next"))


def positions(keys: DataFrame, key: str) -> DataFrame:
    """(key, position): distinct keys numbered from 0 in ascending order (strings by code point), null last. Dealt
    out like :func:`next_key`; the number of keys in each partition passes through the driver."""
    order = [F.col("key").isNull(), F.col("key")]
    dealt = dealt_in_order(keys.select(F.col(key).alias("key")).distinct(), *order)
    before, counts = 0, {}
    for part, n in sorted(map(tuple, dealt.groupBy("part").count().collect())):  # one row per partition
        counts[part], before = before, before + n
    if not counts:
        return dealt.select("key", F.lit(0).cast("long").alias("position"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.select("key", (within + by_part(counts)).alias("position"))


def without(rows: DataFrame, lost: DataFrame, on: dict[str, Column], most: int = 500_000, how: str = "left_anti") -> DataFrame:
    """``rows`` less those that meet a row of ``lost``: ``on`` gives, by column of ``lost``, the expression over
    ``rows`` that must equal it (null equals null). Up to ``most`` lost keys are broadcast, so that whole texts need
    no shuffle; more are joined by shuffle. ``how="left_semi"`` keeps those that meet one instead."""
    few = lost.limit(most + 1).count() <= most
    lost = lost.select([F.col(c).alias(f"_lost_{c}") for c in on])
    meets = reduce(and_, [mine.eqNullSafe(F.col(f"_lost_{c}")) for c, mine in on.items()])
    return rows.join(F.broadcast(lost) if few else lost, meets, how)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: Column) -> Column:
    """Number of maximal runs of characters that are no word separator; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")
