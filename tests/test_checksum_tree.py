"""The checksum tree finds what the full compare finds, and opens only what differs."""

import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import reconcile as RC

SCHEMA = "k long, part string, a long, b long"


def tables(spark, n, changes, seed=1):
    rng = random.Random(seed)
    source = [(i, rng.choice(["x", "y", None]), rng.choice([None, i]), rng.choice([None, i])) for i in range(n)]
    target = list(source)
    for _ in range(changes):
        at = rng.randrange(len(target))
        kind = rng.randrange(3)
        if kind == 0:
            target.pop(at)
        elif kind == 1:
            target.append((n + rng.randrange(10**6), "x", 1, None))
        else:
            k, p, a, b = target[at]
            target[at] = (k, p, b, a)  # swapped: NULLs must not hide it
    return spark.createDataFrame(source, SCHEMA), spark.createDataFrame(target, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("changes", [0, 1, 9, 400])
@pytest.mark.parametrize("fanout,leaf_rows", [(4, 1), (16, 10), (256, 10_000)])
def test_same_as_the_full_compare(spark, changes, fanout, leaf_rows):
    s, t = tables(spark, 600, changes, changes + fanout)
    assert rows(RC.checksum_reconcile(s, t, ["k"], fanout=fanout, leaf_rows=leaf_rows)) == rows(RC.full_reconcile(s, t, ["k"]))
    full = RC.compared_keys(s, t, ["k"]).filter("NOT (s_n <=> t_n AND s_h <=> t_h)").select("k")
    assert rows(RC.differing_keys(s, t, ["k"], fanout=fanout, leaf_rows=leaf_rows).select("k")) == rows(full)


def test_only_differing_buckets_are_opened(spark):
    s, t = tables(spark, 4000, 3)
    left, right, levels, agree = RC.checksum_tree(s, t, ["k"], fanout=16, leaf_rows=2)
    assert [x.differing for x in levels] == [3] * len(levels) or max(x.differing for x in levels) <= 6
    assert levels[0].rows_differing > 5 * levels[-1].rows_differing and left.count() + agree == 4000
    assert max(left.count(), right.count()) < 40
    same = RC.checksum_tree(s, s, ["k"])
    assert len(same[2]) == 1 and same[2][0].differing == 0 and same[3] == 4000 and same[0].count() == 0


def test_a_tree_that_spares_nothing_is_left_at_once(spark):
    s, _ = tables(spark, 500, 0)
    assert len(RC.checksum_tree(s, s.withColumn("a", F.lit(-1).cast("long")), ["k"], fanout=16, leaf_rows=1)[2]) == 1
    few = RC.checksum_tree(s, s.filter("k % 50 > 0"), ["k"], fanout=64, leaf_rows=1, most_open=5)  # above: nothing is opened
    assert few[3] == 0 and few[0].count() == 500


def test_null_and_repeated_keys_and_empty_sides(spark):
    s = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 1, 1), (None, "n", 1, 1), (2, "b", 2, 2), (3, "c", 3, 3)], SCHEMA)
    t = spark.createDataFrame([(1, "a", 1, 1), (None, "n", 1, 1), (3, "c", 3, 3), (2, "b", 2, 2), (2, "b", 2, 2)], SCHEMA)
    assert rows(RC.checksum_reconcile(s, t, ["k"], fanout=4, leaf_rows=1)) == rows(RC.full_reconcile(s, t, ["k"]))
    for a, b in ((s.limit(0), t), (s, t.limit(0)), (s.limit(0), t.limit(0))):
        assert rows(RC.checksum_reconcile(a, b, ["k"])) == rows(RC.full_reconcile(a, b, ["k"]))
    assert rows(RC.checksum_reconcile(s, t, ["k", "part"], fanout=4)) == rows(RC.full_reconcile(s, t, ["k", "part"]))
