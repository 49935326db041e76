"""Centroid clustering (k-means) over a vector-approximation file.

1. *Vectors.* Components become integers, floor(scale * x). A vector is kept if it has exactly ``dims`` components, none
   null or non-finite, and none beyond ``widest(dims)`` as an integer, so that every distance fits a long.
2. *VA-file.* Each dimension's range is cut into 2^bits cells by the quantiles of a bounded sample (``SAMPLE`` vectors of
   least hash); the outermost cells reach to the least and greatest value of all vectors. A vector's approximation is
   its cell in each dimension, ``bits`` bits each. Approximations and full vectors are two tables with the same buckets.
3. *Assignment.* Less its distance to a common point m, a vector's squared distance to a centroid c is a sum over
   dimensions of (c - m)(c + m - 2x), linear in x. Lookup tables hold its least and greatest value for each cell, so a
   scan of the approximations gives an interval for each centroid. Centroids whose interval begins beyond the least end
   are out; where one is left, it is the nearest. Only where intervals overlap is the full vector fetched, by a join
   of the two tables bucket by bucket, and compared exactly with the centroids that are left.
4. *Update.* Each centroid's exact sums are kept from round to round; only vectors that have changed their cluster are
   fetched, taken from one sum and added to the other. A task reduces its vectors to one row a cluster.

Rows are independent of each other, so copies of one vector are dealt out like any others. Through the driver pass the
sample, the centroids and their sums, and a row a cluster. Lookup tables take 2^(bits + 4) bytes for each
dimension and centroid in each task, which suits some thousand centroids.

Defined results: null ids are kept, and are the last to become first centroids; ids that repeat are clustered row by
row; of equal hashes the vector that is smaller as bytes becomes a centroid first; with fewer vectors than centroids
there are as many centroids as vectors; no vector kept: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import stage
from kestrel.sources.bucketed import bucketed

#: Vectors whose quantiles cut the cells.
SAMPLE = 4096


def widest(dims: int) -> int:
    """The greatest component for which sums over all dimensions fit 63 bits."""
    return 1 << (59 - dims.bit_length()) // 2


def quantised(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """(id, ints): the kept vectors' integers, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = pc.equal(pc.list_value_length(batch.column(1)), dims).fill_null(False)
            ids, vectors = batch.column(0).filter(fit), batch.column(1).filter(fit)
            x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))
            whole = (np.abs(x) <= widest(dims)).all(axis=1)  # not of NaN and infinity; a null is NaN here
            ints = [v.tobytes() for v in x[whole].astype("<i4")]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(whole)), pa.array(ints, pa.binary())], ["id", "ints"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ints binary")


def matrix(ints, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(ints), "<i4").reshape(-1, dims).astype(np.int64)


def extremes(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value of each dimension over all vectors; a task reduces its vectors to two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0).to_pylist(), dims)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = vectors.select("ints").mapInArrow(run, "d int, low long, high long").groupBy("d").agg(F.min("low"), F.max("high")).collect()
    _, low, high = zip(*sorted(map(tuple, found)))
    return np.array(low), np.array(high)


def cell_edges(sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): the least and greatest integer of each dimension's cells. Cells without any integer repeat the
    one before and are never used."""
    cuts = np.ceil(np.quantile(sample, np.arange(1, 1 << bits) / (1 << bits), axis=0)).astype(np.int64)
    first = np.vstack([low, np.clip(cuts, low, high)])
    return first, np.maximum(np.vstack([first[1:] - 1, high]), first)


def approximations(ints, first: np.ndarray, bits: int) -> list[bytes]:
    """Each vector's cells, ``bits`` bits a dimension."""
    x = matrix(ints, first.shape[1])
    cells = np.empty(x.shape, np.uint8)
    for d in range(x.shape[1]):
        cells[:, d] = np.searchsorted(first[1:, d], x[:, d], side="right")
    packed = np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits:].reshape(len(x), -1), axis=1)
    return [p.tobytes() for p in packed]


def cells_of(codes, dims: int, bits: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return np.unpackbits(packed, axis=1)[:, :dims * bits].reshape(len(codes), dims, bits) @ (1 << np.arange(bits)[::-1])


class Intervals:
    """Lookup tables: for each dimension, cell and centroid the least and greatest part of the distance."""

    def __init__(self, centroids: np.ndarray, first: np.ndarray, last: np.ndarray):
        m = np.rint(centroids.mean(axis=0)).astype(np.int64)
        at = [((centroids - m)[None] * ((centroids + m)[None] - 2 * edge[:, None, :])).transpose(2, 0, 1) for edge in (first, last)]
        self.low, self.high = np.ascontiguousarray(np.minimum(*at)), np.ascontiguousarray(np.maximum(*at))

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector for each centroid."""
        low = np.zeros((len(cells), self.low.shape[2]), np.int64)
        high = low.copy()
        for d in range(cells.shape[1]):
            low += self.low[d][cells[:, d]]
            high += self.high[d][cells[:, d]]
        return low, high

    def near(self, cells: np.ndarray) -> np.ndarray:
        """True where a centroid may be the nearest."""
        low, high = self.bounds(cells)
        return low <= high.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The nearest centroid of each vector among those marked; of equal distances the smaller number."""
    row, c = np.nonzero(near)
    distance = np.full(near.shape, np.iinfo(np.int64).max)
    for lo in range(0, len(row), step):
        r, k = row[lo:lo + step], c[lo:lo + step]
        distance[r, k] = ((x[r] - centroids[k]) ** 2).sum(axis=1)
    return distance.argmin(axis=1)


def scan(state: DataFrame, centroids: np.ndarray, first: np.ndarray, last: np.ndarray, bits: int) -> DataFrame:
    """``state`` with ``va``: the number of the one centroid whose interval leaves no other (else -1), and a bit for
    each centroid that may be the nearest."""
    @F.pandas_udf("nearest int, near binary")
    def by_interval(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = Intervals(centroids, first, last)
        for codes in batches:
            near = tables.near(cells_of(codes, first.shape[1], bits))
            one = np.where(near.sum(axis=1) == 1, near.argmax(axis=1), -1)
            yield pd.DataFrame({"nearest": one.astype(np.int32), "near": [b.tobytes() for b in np.packbits(near, axis=1)]})

    return state.withColumn("va", by_interval("code"))


def assigned(state: DataFrame, vectors: DataFrame, centroids: np.ndarray, first: np.ndarray, last: np.ndarray, bits: int) -> DataFrame:
    """``state`` after an assignment: ``was`` is the cluster before, ``cluster`` the nearest centroid."""
    dims, k = first.shape[1], len(centroids)

    @F.pandas_udf("int")
    def exactly(ints: pd.Series, near: pd.Series) -> pd.Series:
        out, there = np.zeros(len(ints), np.int32), np.flatnonzero(ints.notna())
        if len(there):
            left = np.unpackbits(np.frombuffer(b"".join(near.iloc[there]), np.uint8).reshape(len(there), -1), axis=1)[:, :k].astype(bool)
            out[there] = nearest(matrix(ints.iloc[there], dims), left, centroids)
        return pd.Series(out)

    found = bucketed(scan(state, centroids, first, last, bits), "row", "va-scan", dealt=True)
    overlap = F.col("va.nearest") < 0
    full = vectors.select(F.col("row").alias("full_row"), "ints")
    met = found.join(full, (F.col("row") == F.col("full_row")) & overlap, "left")
    return met.select("row", "id", "code", F.col("cluster").alias("was"),
                      F.when(overlap, exactly("ints", "va.near")).otherwise(F.col("va.nearest")).alias("cluster"))


def moved(state: DataFrame, vectors: DataFrame, dims: int) -> list[tuple]:
    """(cluster, dimension, sum, vectors) of what the last assignment added to each cluster, less what it took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            x = matrix(batch.column(2).to_pylist(), dims)
            for side, sign in ((batch.column(0), -1), (batch.column(1), 1)):
                number = side.fill_null(-1).to_numpy(zero_copy_only=False)
                for c in np.unique(number[number >= 0]).tolist():
                    mine = number == c
                    was, n = sums.get(c, (0, 0))
                    sums[c] = was + sign * x[mine].sum(axis=0), n + sign * int(mine.sum())
        if sums:
            made = [[c for c in sums for _ in range(dims)], [*range(dims)] * len(sums), np.concatenate([s for s, _ in sums.values()]).tolist(),
                    [n for _, n in sums.values() for _ in range(dims)]]
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), pa.array(made[1], pa.int32()), pa.array(made[2], pa.int64()),
                                              pa.array(made[3], pa.int64())], ["cluster", "d", "sum", "n"])

    changed = state.filter(~F.col("cluster").eqNullSafe(F.col("was"))).join(vectors.select("row", "ints"), "row")
    parts = changed.select("was", "cluster", "ints").mapInArrow(run, "cluster int, d int, sum long, n long")
    total = parts.groupBy("cluster", "d").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))
    return [(r.cluster, r.d, int(r["sum"]), r.n) for r in total.collect()]  # a row for each cluster and dimension


def clustered(df: DataFrame, centroids: int, rounds: int, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: float = 64.0,
              salt: str = "1:", bits: int = 6) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance), final centroids): each kept vector's nearest centroid and its squared distance, after
    ``rounds`` rounds. The first centroids are the vectors with the smallest hex SHA-256 of ``salt`` and the id."""
    if not 1 <= bits <= 8:
        raise ValueError(f"bits must be 1 to 8, not {bits}")
    kept = stage(quantised(df, id_col, vec_col, dims, scale), "vectors")
    by_hash = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).asc_nulls_last()
    sample = matrix([bytes(r.ints) for r in kept.orderBy(by_hash, "ints").limit(max(SAMPLE, centroids)).select("ints").collect()], dims)
    if not len(sample):
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    vectors = bucketed(kept.withColumn("row", F.monotonically_increasing_id()), "row", "vectors")
    first, last = cell_edges(sample, *extremes(vectors, dims), bits)

    @F.pandas_udf("binary")
    def approximated(ints: pd.Series) -> pd.Series:
        return pd.Series(approximations(ints, first, bits), dtype=object)

    state = bucketed(vectors.select("row", "id", approximated("ints").alias("code"), F.lit(None).cast("int").alias("cluster")), "row", "va-file", dealt=True)
    now = sample[:centroids]
    sums, counts = [[0] * dims for _ in now], [0] * len(now)
    for _ in range(rounds):
        state = bucketed(assigned(state, vectors, now, first, last, bits), "row", "va-file", dealt=True)
        for c, d, added, n in moved(state, vectors, dims):
            sums[c][d] += added
            counts[c] += n if d == 0 else 0
        now = np.array([[s // n for s in total] if n else old for total, n, old in zip(sums, counts, now.tolist())], np.int64)

    @F.pandas_udf("long")
    def squared(ints: pd.Series, cluster: pd.Series) -> pd.Series:
        return pd.Series(((matrix(ints, dims) - now[cluster.to_numpy(np.int64)]) ** 2).sum(axis=1), dtype="int64")

    final = assigned(state, vectors, now, first, last, bits).drop("code")
    return final.join(vectors.select("row", "ints"), "row").select("id", "cluster", squared("ints", "cluster").alias("distance")), now.tolist()


def with_inertia(df: DataFrame, **how) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of :func:`clustered`: distances summed over
    the cluster and over all, and the digest of the final centroid's integers, joined by commas. A sum that no long
    holds is null."""
    found, final = clustered(df, **how)
    found = stage(found, "clusters")
    summed = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a cluster
    total, fits = sum(int(r.s) for r in summed), lambda n: int(n) if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    by_cluster = found.sparkSession.createDataFrame([(r.cluster, fits(r.s), fits(total), digest[r.cluster]) for r in summed],
                                                    "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by_cluster), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
