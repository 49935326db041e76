"""The pull source: filters that reach the segments, loads that appear whole, and streams whose offset is the cursor."""

import datetime as dt
import decimal
import os
import random

import pytest
from pyspark.sql import functions as F

from kestrel.catalog.incremental import forget_last_commit
from kestrel.session import work_dir
from kestrel.sources import pull as P
from kestrel.streaming.jobs import pull_stream_to

SCHEMA = "id long, name string, amount decimal(12,2), ratio double, day date, at timestamp_ntz, flag boolean, tags array<int>"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", "a", "b", "é", "x" * 300]), rng.choice([None, decimal.Decimal("1.50"), decimal.Decimal(i)]),
             rng.choice([None, float("nan"), 0.5, float(i)]), dt.date(2024, 1, 1) + dt.timedelta(days=i % 40),
             dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), rng.choice([None, True, False]), [i]) for i in range(n)]


@pytest.fixture()
def path(spark):
    return work_dir(spark, "pull-test")


TESTS = ["id > 20", "id >= 20 AND id < 25", "id <= 3", "id = 7", "id IN (3, 70, 7000)", "name = 'a'", "name IS NULL", "name IS NOT NULL AND id > 50",
         "amount > 30", "amount = 1.5", "ratio > 40", "day >= DATE '2024-02-01'", "at BETWEEN TIMESTAMP_NTZ '2024-01-02' AND TIMESTAMP_NTZ '2024-01-02 05:00:00'",
         "flag", "NOT flag", "name LIKE 'x%'", "id % 2 = 0 AND id > 90", "id > 1000", "tags[0] = 5", "name > 'a'"]


@pytest.mark.parametrize("where", TESTS)
def test_filters_give_the_same_rows(spark, path, where):
    df = spark.createDataFrame(rows(100), SCHEMA)
    P.land(df.repartition(3), path, rowsPerBatch=7)
    got = P.pull(spark, path).filter(where)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in df.filter(where).collect())


def test_filters_are_pushed_and_shown(spark, path):
    P.land(spark.createDataFrame(rows(100), SCHEMA).coalesce(1), path, rowsPerBatch=10)
    plan = P.pull(spark, path).filter("id > 20 AND at >= TIMESTAMP_NTZ '2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in P.pull(spark, path).filter("id > 20")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Filter (" not in plan  # Spark doesn't repeat them


def test_planning_leaves_out_batches_that_hold_no_row(spark, path):
    P.land(spark.createDataFrame(rows(100), SCHEMA).coalesce(1), path, rowsPerBatch=10)
    plan = lambda *tests: [len(b) for _, b in P.Segments(path).plan(list(tests), 1000)]
    assert plan() == [10] and plan((">", "id", 84)) == [2] and plan(("=", "id", 1000)) == [] and plan(("in", "id", (5, 55))) == [2]
    assert [len(b) for _, b in P.Segments(path).plan([], 25)] == [2, 2, 2, 2, 2]
    assert plan((">", "ratio", 0.1)) == [10] or sum(plan((">", "ratio", 0.1))) <= 10  # NaN: no bounds, so nothing is left out wrongly


def test_a_load_appears_whole_or_not_at_all(spark, path):
    P.land(spark.createDataFrame(rows(10), SCHEMA), path)
    broken = spark.createDataFrame(rows(50), SCHEMA).repartition(4).withColumn("id", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        P.land(broken, path)
    assert P.pull(spark, path).count() == 10
    with pytest.raises(Exception, match="append"):
        spark.range(1).write.format(P.FORMAT).mode("overwrite").option("path", path).save()
    assert not [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("_")] or P.pull(spark, path).count() == 10


def test_empty_loads_and_no_segments(spark, path):
    with pytest.raises(Exception, match="no segments"):
        P.pull(spark, path).count()
    P.land(spark.createDataFrame([], SCHEMA), path)
    P.land(spark.createDataFrame(rows(5), SCHEMA), path)
    P.land(spark.createDataFrame([], SCHEMA), path)
    assert P.pull(spark, path).count() == 5 and P.pull(spark, path).filter("id > 99").count() == 0


def taken(spark, root):
    return sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").collect())


def test_arrivals_and_a_replay_load_each_row_once(spark, path):
    land, root, schema = f"{path}/landed", path, spark.createDataFrame([], "id long, v string").schema
    pull_stream_to(spark, land, "id", f"{root}/out", f"{root}/cp", schema)  # nothing has landed yet
    for lo in (0, 40, 80):
        P.land(spark.range(lo, lo + 40).select("id", F.concat(F.lit("v"), "id").alias("v")).repartition(3), land, rowsPerBatch=8)
        pull_stream_to(spark, land, "id", f"{root}/out", f"{root}/cp", schema)
        pull_stream_to(spark, land, "id", f"{root}/out", f"{root}/cp", schema)  # nothing new
    want = sorted((i, f"v{i}") for i in range(120))
    assert taken(spark, root) == want
    forget_last_commit(spark, f"{root}/cp")
    pull_stream_to(spark, land, "id", f"{root}/out", f"{root}/cp", schema)
    assert taken(spark, root) == want


def test_day_and_time_resume_at_the_pair(spark, path):
    schema = spark.createDataFrame([], "id long, day long, tm long").schema
    arrivals = [[(1, 1, 10), (2, 1, 20), (3, 1, None)], [(4, 1, 30), (5, 2, 5)], [(6, 2, 7), (7, 2, 6), (8, 4, None)], [(9, 4, 1), (10, 5, 0)]]
    for rows_ in arrivals:
        P.land(spark.createDataFrame(rows_, schema).coalesce(1), f"{path}/landed", rowsPerBatch=2)
        pull_stream_to(spark, f"{path}/landed", "day,tm", f"{path}/out", f"{path}/cp", schema)
    assert sorted(r[0] for r in taken(spark, path)) == list(range(1, 11))


def test_overlap_reads_late_markers_again(spark, path):
    schema = spark.createDataFrame([], "id long, at timestamp_ntz").schema
    at = lambda h: dt.datetime(2024, 1, 1, h)
    for rows_ in ([(1, at(1)), (2, at(5))], [(3, at(4)), (4, at(6))]):
        P.land(spark.createDataFrame(rows_, schema).coalesce(1), f"{path}/landed")
        pull_stream_to(spark, f"{path}/landed", "at", f"{path}/out", f"{path}/cp", schema, overlap=2 * 3600)
    assert [r[0] for r in taken(spark, path)] == [1, 2, 2, 3, 4]  # 3 came late; 2 twice


def test_options_are_checked(spark, path):
    P.land(spark.createDataFrame(rows(3), SCHEMA), path)
    for marker, how in (("nope", {}), ("id,day,at", {}), ("day,id", {"overlap": 1})):
        with pytest.raises(Exception, match="marker"):
            q = P.pull_stream(spark, path, marker, **how).writeStream.format("noop").option("checkpointLocation", f"{path}/c-{marker}").trigger(availableNow=True).start()
            q.awaitTermination()
