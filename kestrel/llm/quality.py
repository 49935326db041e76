"""Quality classifier: logistic regression on hashed word n-grams, learnt by follow-the-regularised-leader.

Features are counts of hashed unigrams and bigrams, as log(1 + count), scaled to length 1. A token is a run of
word characters or of other visible ones, in lower case. A token that only repeats the one before, and a line that
repeats an earlier line of its text, are written as one marker each, so that repetition itself can be learnt.

Learning uses FTRL-proximal with per-coordinate rates and L1 and L2 terms, on a sample of at most ``train_rows``
labelled documents (those with the smallest hashes of their ids; a documented bound, so the sample's features fit in
the one task that learns). Only weights that L1 leaves non-zero come back, at most one for each of the 2**BITS
buckets; they are broadcast, and every whole text is scored where it lies as a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Chunks of text whose token hashes are remembered, for each task.
REMEMBERED = 1 << 17
# Tokens that no text contains.
SAME, LINE_AGAIN = (np.uint32(zlib.crc32(x)) for x in (b"\0same token", b"\0line again"))
ODD = np.uint64(0x9E3779B97F4A7C15)


class Features(dict):
    """Chunk of text (no white space) -> its tokens' hashes as uint32 bytes, remembered."""

    def __missing__(self, chunk: str) -> bytes:
        found = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in TOKEN.findall(chunk.lower())], np.uint32).tobytes()
        if len(chunk) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found

    def tokens(self, text: str) -> np.ndarray:
        seen, parts = set(), []
        for line in text.split("\n"):
            ids = b"".join(map(self.__getitem__, line.split()))
            if not ids:
                continue
            parts.append(LINE_AGAIN.tobytes() * (len(ids) // 4) if line in seen else ids)
            seen.add(line)
        t = np.frombuffer(b"".join(parts), np.uint32).copy()
        t[1:][(t[1:] == t[:-1]) & (t[1:] != LINE_AGAIN)] = SAME
        return t

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, values) of a text; null, empty and blank texts have none."""
        one = self.tokens(text or "").astype(np.uint64)
        two = (one[:-1] * ODD + one[1:]) * ODD + np.uint64(1)
        grams = np.concatenate((one * ODD, two)) >> np.uint64(64 - BITS)
        at, counts = np.unique(grams.astype(np.int32), return_counts=True)
        value = np.log1p(counts)
        return at, value / np.sqrt(value @ value) if len(value) else value


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights of 2**BITS buckets and, last, the intercept (not regularised by L1), from the examples in order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        zs = z[at]
        held = np.where(at == 1 << BITS, 0.0, l1)
        return np.where(np.abs(zs) <= held, 0.0, (np.sign(zs) * held - zs) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for (at, value), label in zip(examples, labels):
            at, value = np.append(at, 1 << BITS), np.append(value, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange((1 << BITS) + 1))


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          train_rows: int = 10_000, epochs: int = 5, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.0) -> np.ndarray:
    """Dense weights, learnt only from labelled rows that :func:`held_out` leaves; none: all 0, every score 0.5.

    Rows with a null id or label are not labelled. An id with several labels has their rounded mean; of several
    texts with one id the least is learnt. The result has 2**BITS + 1 numbers.
    """
    told = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
            .filter(~held_out("id")).groupBy("id").agg(F.round(F.avg("y")).alias("y")))
    sample = told.orderBy(F.xxhash64("id"), "id").limit(train_rows)  # narrow: ids and labels
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
             .groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for batch in batches:
            rows = [made(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), batch.column("y"), pa.array([a for a, _ in rows], pa.list_(pa.int32())),
                 pa.array([v for _, v in rows], pa.list_(pa.float64()))], ["id", "y", "at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(zlib.crc32(str(i).encode()), i, y, np.asarray(a.values), np.asarray(v.values)) for b in batches
                for i, y, a, v in zip(b.column("id").to_pylist(), b.column("y").to_pylist(), b.column("at"), b.column("value"))]
        rows.sort(key=lambda r: r[:2])
        w = ftrl([r[3:] for r in rows], np.array([r[2] for r in rows]), epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["bucket", "weight"])

    made = texts.select(F.col("id").cast("long"), "y", "text").mapInArrow(features, "id long, y double, at array<int>, value array<double>")
    learnt = made.repartition(1).mapInArrow(learn, "bucket int, weight double").toPandas()  # at most 2**BITS + 1 rows
    weights = np.zeros((1 << BITS) + 1)
    weights[learnt["bucket"].to_numpy(np.int64)] = learnt["weight"].to_numpy()
    return weights


def scorer(docs: DataFrame, weights: np.ndarray):
    """A column function: a text's score, between 0 and 1, higher where label 1 is likelier. Null, empty and blank
    texts get the intercept's."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, made = shared.value, Features()
        for batch in texts:
            sums = [float(w[at] @ value) + w[-1] for at, value in map(made, batch)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35))))

    return score


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """(id, held_out, score, predicted), one row per input row; predicted is 1 from ``threshold`` on. Empty table:
    no rows."""
    score = scorer(docs, train(docs, labels, id_col, text_col, **how))
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """The input rows that are not rejected, all columns kept."""
    return docs.filter(scorer(docs, train(docs, labels, id_col, text_col, **how))(F.col(text_col)) >= threshold)
