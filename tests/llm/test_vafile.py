import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import vafile as V


def plain(rows, k, rounds, dims):
    """[(id, cluster, distance)], centroids: every vector against every centroid, in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(64.0 * float(x))) for x in v]))
    byte = lambda v: np.array(v, "<i4").tobytes()
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), byte(r[1])))
    cents = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        found = assign()
        for c in range(len(cents)):
            mine = [v for (_, v), (n, _) in zip(kept, found) if n == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, *f) for (i, _), f in zip(kept, assign())), key=str), cents


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash") for i, v in rows],
                                 "vec_id long, embedding array<double>, cluster string").repartition(3)


def rows_of(rng, n, dims):
    spots = rng.normal(0, 1, (5, dims))
    return [(i, (spots[rng.integers(5)] + rng.normal(0, 0.4, dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("bits", [2, 6])
def test_against_every_distance(spark, bits):
    rng = np.random.default_rng(bits)
    rows = rows_of(rng, 300, 8)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # copies
    rows += [(7, [0.5] * 8), (7, [-0.5] * 8), (None, [0.25] * 8), (8, None), (9, [0.0] * 7), (10, [0.0] * 7 + [None]), (11, [0.0] * 7 + [float("nan")]),
             (12, [float("inf")] + [0.0] * 7), (13, []), (14, [0.0] * 9)]
    found, cents = V.clustered(frame(spark, rows), 16, 3, dims=8, bits=bits)
    want, centroids = plain(rows, 16, 3, 8)
    assert cents == centroids
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_intervals_hold_the_distance_and_spare_most_vectors():
    rng = np.random.default_rng(3)
    x = np.floor(64 * np.array([v for _, v in rows_of(rng, 2000, 16)])).astype(np.int64)
    first, last = V.cell_edges(x[:500], x.min(0), x.max(0), 5)
    cells = V.cells_of(V.approximations([v.astype("<i4").tobytes() for v in x], first, 5), 16, 5)
    d = np.arange(16)
    assert ((first[cells, d] <= x) & (x <= last[cells, d])).all()
    cents = x[:10]
    m = np.rint(cents.mean(0)).astype(np.int64)
    exact = ((x[:, None] - cents) ** 2).sum(2)
    tables = V.Intervals(cents, first, last)
    low, high = tables.bounds(cells)
    part = exact - ((x - m) ** 2).sum(1)[:, None]
    assert ((low <= part) & (part <= high)).all()
    near = tables.near(cells)
    assert near[np.arange(len(x)), exact.argmin(1)].all()
    assert near.sum(1).mean() < 3 and (near.sum(1) == 1).any()  # of 10 centroids, some twice in a spot


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [0.5, 0.5]) for i in range(6)] + [(6, [1.0, 0.0])]
    found, cents = V.clustered(frame(spark, rows), 5, 3, dims=2)
    want, centroids = plain(rows, 5, 3, 2)
    assert cents == centroids and sorted((tuple(r) for r in found.collect()), key=str) == want


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.25, 8.0])]
    found, cents = V.clustered(frame(spark, rows), 16, 2, dims=2)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 16, 2, 2)[0] and len(cents) == 2
    empty = V.with_inertia(frame(spark, rows).limit(0), centroids=4, rounds=2, dims=2)
    assert empty.collect() == [] and empty.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError, match="bits"):
        V.clustered(frame(spark, rows), 2, 1, dims=2, bits=9)


def test_inertia_and_digests(spark):
    rows = rows_of(np.random.default_rng(5), 80, 4)
    want, cents = plain(rows, 4, 2, 4)
    by = {c: sum(d for _, n, d in want if n == c) for c in range(4)}
    for r in V.with_inertia(frame(spark, rows), centroids=4, rounds=2, dims=4).collect():
        assert r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def test_full_vectors_meet_approximations_without_an_exchange(spark):
    kept = V.quantised(frame(spark, rows_of(np.random.default_rng(6), 50, 4)), "vec_id", "embedding", 4, 64.0)
    vectors = V.bucketed(kept.withColumn("row", F.monotonically_increasing_id()), "row", "vectors")
    x = V.matrix([bytes(r.ints) for r in vectors.collect()], 4)
    first, last = V.cell_edges(x, *V.extremes(vectors, 4), 4)
    state = V.bucketed(vectors.select("row", "id", F.col("ints").alias("code"), F.lit(None).cast("int").alias("cluster")), "row", "va-file", dealt=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = V.assigned(state, vectors, x[:3], first, last, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
