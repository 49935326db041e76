"""Dedup with bounded state: duplicates within the quiet period go, and the state shrinks again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kestrel.session import work_dir
from kestrel.streaming.dedup import dedup_quiet_stream, key_json

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, key string, at timestamp_ntz, big long, amount decimal(20,4)"


def plain(batches, quiet):
    """Ids that stay: batch by batch, each key's rows in the order of their times."""
    last, kept = {}, []
    for batch in batches:
        for row in sorted(batch, key=lambda r: (r[2] is not None, r[2] or START)):
            if row[2] is None:
                kept.append(row[0])
                continue
            was = last.get(row[1])
            if was is None or abs((row[2] - was).total_seconds()) > quiet:
                kept.append(row[0])
            last[row[1]] = row[2] if was is None else max(was, row[2])
    return sorted(kept)


def landed(spark, root, batches):
    for i, batch in enumerate(batches):
        spark.createDataFrame([(*r, None if r[0] % 3 else 2**62 + r[0], None) for r in batch], SCHEMA).coalesce(1).write.parquet(f"{root}/landing/f{i}")


def streamed(spark, root, quiet=dt.timedelta(hours=2), lateness="2 hours"):
    return dedup_quiet_stream(spark, f"{root}/landing/*", spark.createDataFrame([], SCHEMA).schema, f"{root}/out", ["key"], "at", quiet, lateness,
                              f"{root}/checkpoint", bytes_per_batch=1)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_version_and_state_shrinks(spark, seed):
    rng, root = random.Random(seed), work_dir(spark, "quiet")
    batches, n = [], 0
    for day in range(6):
        batch = []
        for _ in range(60):
            at = START + dt.timedelta(days=day, minutes=rng.randrange(900))
            batch.append((n, rng.choice([f"hot{day}", f"k{day}-{rng.randrange(12)}", None]), at))
            n += 1
        batches.append(batch + [(n + i, k, at) for i, (_, k, at) in enumerate(batch[:10])])  # sent twice
        n += 10
    batches.append([(n, "end", START + dt.timedelta(days=30))])
    batches.append([(n + 1, "end", START + dt.timedelta(days=60))])
    landed(spark, root, batches)
    query = streamed(spark, root)
    found = spark.read.parquet(f"{root}/out")
    assert sorted(r.id for r in found.collect()) == plain(batches, 7200)
    assert found.filter("big IS NOT NULL").agg(F.min(F.col("big") - F.col("id"))).first()[0] == 2**62  # types pass unharmed
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) > 10 and states[-1] <= 3  # of the last key


def test_a_second_run_goes_on_with_the_state(spark):
    root = work_dir(spark, "quiet-two")
    first = [(1, "a", START), (2, "b", START), (3, None, None)]
    second = [(4, "a", START + dt.timedelta(hours=1)), (5, "b", START + dt.timedelta(hours=3)), (6, "a", START + dt.timedelta(hours=2, minutes=59)), (7, None, None)]
    landed(spark, root, [first])
    streamed(spark, root)
    spark.createDataFrame([(*r, None, None) for r in second], SCHEMA).coalesce(1).write.parquet(f"{root}/landing/g")
    streamed(spark, root)
    assert sorted(r.id for r in spark.read.parquet(f"{root}/out").collect()) == plain([first, second], 7200) == [1, 2, 3, 5, 7]


def test_keys_of_a_group_do_not_meet(spark):
    """A few groups hold all keys: the rows that stay are the same, each key's time goes when it is due, and so does the group."""
    rng, root = random.Random(3), work_dir(spark, "quiet-groups")
    batches, n = [], 0
    for day in range(4):
        batch = [(n + i, rng.choice([f"k{rng.randrange(40)}", "null", None]), START + dt.timedelta(days=day, minutes=rng.randrange(900))) for i in range(150)]
        batches.append(batch)
        n += 150
    batches += [[(n, "end", START + dt.timedelta(days=30))], [(n + 1, "end", START + dt.timedelta(days=60))]]
    landed(spark, root, batches)
    query = dedup_quiet_stream(spark, f"{root}/landing/*", spark.createDataFrame([], SCHEMA).schema, f"{root}/out", ["key"], "at", dt.timedelta(hours=2),
                               "2 hours", f"{root}/checkpoint", bytes_per_batch=1, groups=2)
    assert sorted(r.id for r in spark.read.parquet(f"{root}/out").collect()) == plain(batches, 7200)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) <= 6 and states[-1] <= 3


def test_state_is_read_and_written_by_groups(spark):
    """The calls of a micro-batch, with the rows of state, follow the groups and not the keys."""
    root = work_dir(spark, "quiet-calls")
    spark.range(9000).select("id", F.concat(F.lit("k"), "id").alias("key"), F.lit(START).cast("timestamp_ntz").alias("at")).coalesce(1).write.parquet(f"{root}/landing/f")
    schema = spark.read.parquet(f"{root}/landing/f").schema
    query = dedup_quiet_stream(spark, f"{root}/landing/*", schema, f"{root}/out", ["key"], "at", dt.timedelta(hours=2), "2 hours", f"{root}/checkpoint")
    assert spark.read.parquet(f"{root}/out").count() == 9000
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(states) <= 3 * 4096  # the times, and two rows of a timer


def test_equal_keys_are_those_that_spark_groups(spark):
    df = spark.sql("""SELECT * FROM VALUES (0.0D, 'a', TIMESTAMP_NTZ'2024-01-01 00:00:00.000001'), (-0.0D, 'a', TIMESTAMP_NTZ'2024-01-01 00:00:00.000001'),
        (0.0D, 'a', TIMESTAMP_NTZ'2024-01-01 00:00:00.000002'), (NULL, 'a', NULL), (0.0D, NULL, NULL), (double('NaN'), 'NaN', NULL), (double('NaN'), 'NaN', NULL),
        (NULL, 'null', NULL), (NULL, NULL, NULL), (1.5D, '","t":', NULL) AS v(x, y, t)""")
    keyed = df.withColumn("k", key_json(df, ["x", "y", "t"]))
    assert keyed.filter("k IS NULL").count() == 0
    assert keyed.select("k").distinct().count() == df.distinct().count() == 8
