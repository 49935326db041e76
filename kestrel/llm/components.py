"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Each round links nodes to the smallest neighbour known (large-star: larger neighbours; small-star: smaller
    ones) and stages the edges, until they no longer change; rounds grow with the logarithm of the longest
    chain. Only two numbers a round reach the driver. Minima are combined before the shuffle, and the join that
    hands them back has one row per node on one side, so that Spark can split a hub. No edges: no rows.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: every node with all its neighbours; small: only with the smaller ones
        pairs = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(F.col("a").alias("hub"), "m")
        met = pairs.join(least, pairs["a"] == least["hub"])
        if large:
            out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select("b", "m").union(met.select("a", "m")).toDF("a", "b")
        return out.filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (seen := state(now)) != before:
        before = seen
        now = stage(star(star(now, True), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b")).distinct()
