import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kestrel.llm import quality


def plain_features(text):
    """{bucket: value} by dictionaries and Python integers."""
    tokens, seen = [], set()
    for line in (text or "").split("\n"):
        own = [t for w in line.split() for t in quality.TOKEN.findall(w.lower())]
        if own:
            tokens += [b"\0line again"] * len(own) if line in seen else [t.encode() for t in own]
            seen.add(line)
    hashes = [zlib.crc32(t) for t in tokens]
    again = zlib.crc32(b"\0line again")
    hashes = [zlib.crc32(b"\0same token") if i and h == hashes[i - 1] and h != again else h for i, h in enumerate(hashes)]
    k, m = 0x9E3779B97F4A7C15, 2**64 - 1
    grams = [h * k & m for h in hashes] + [(a * k + b) * k + 1 & m for a, b in zip(hashes, hashes[1:])]
    counts = {}
    for g in grams:
        counts[g >> 64 - quality.BITS] = counts.get(g >> 64 - quality.BITS, 0) + 1
    norm = sum(np.log1p(c) ** 2 for c in counts.values()) ** 0.5
    return {b: np.log1p(c) / norm for b, c in counts.items()}


def test_features_match_a_plain_version(monkeypatch):
    monkeypatch.setattr(quality, "REMEMBERED", 4)
    made = quality.Features()
    for text in [None, "", " \n\t", "one", "As As As as b", "a%%% b### a", "x y\nx y\nx y\nz", "Été été　ete", "w " * 70, "q" * 100]:
        at, value = made(text)
        want = plain_features(text)
        assert at.tolist() == sorted(want) and np.allclose(value, [want[b] for b in sorted(want)])


def test_ftrl_matches_a_plain_version():
    rnd = random.Random(4)
    examples = [(np.array(sorted(rnd.sample(range(30), 5)), np.int32), np.array([rnd.random() for _ in range(5)])) for _ in range(60)]
    labels = np.array([float(3 in a or 7 in a) for a, _ in examples])
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.1
    z, n = {}, {}

    def weight(i):
        zi, held = z.get(i, 0.0), 0.0 if i == 1 << quality.BITS else l1
        return 0.0 if abs(zi) <= held else (np.sign(zi) * held - zi) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)
    for _ in range(2):
        for (at, value), y in zip(examples, labels):
            x = dict(zip(at.tolist(), value.tolist())) | {1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality.ftrl(examples, labels, 2, alpha, beta, l1, l2)
    assert np.allclose(got[:30], [weight(i) for i in range(30)]) and np.isclose(got[-1], weight(1 << quality.BITS))
    assert not got[30:-1].any()


def corpus(spark, n=400):
    rnd = random.Random(8)
    good = ["river", "stone", "walks", "under", "light", "of", "the", "old", "bridge"]
    text = lambda bad: " ".join((rnd.choice(good) + "%%%") if bad else rnd.choice(good) for _ in range(rnd.randint(5, 60)))
    rows = [(i, text(i % 4 == 0), None, "clash") for i in range(n)]
    docs = spark.createDataFrame(rows + [(n, None, "l", ""), (n + 1, "", "l", ""), (None, "the river", "l", ""), (3, "the", "", "")],
                                 "doc_id long, text string, score string, held_out string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)] + [(None, 1, 0), (5, None, 0), (n + 7, 1, 1), (6, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_scores_of_held_out_documents(spark):
    docs, labels = corpus(spark)
    got = quality.scored(docs, labels).collect()
    assert len(got) == 404
    for r in got:
        assert r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.id < 400]
    assert held and all(r.predicted == int(r.id % 4 != 0) for r in held)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_labels_of_the_held_out_fold_are_never_read(spark):
    docs, labels = corpus(spark, 100)
    wrong = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, labels) == quality.train(docs.repartition(4), wrong.repartition(3))).all()


def test_the_sample_is_bounded_and_nothing_to_learn_is_allowed(spark):
    docs, labels = corpus(spark, 100)
    assert quality.train(docs, labels, train_rows=20).any()
    none = labels.filter("false")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(docs.filter("false"), labels).count() == 0


def test_held_out_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.scored(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    told = got.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "id"), "id").collect()
    assert sum(r.predicted == r.quality for r in told) >= 0.95 * len(told)
    assert sum(r.predicted for r in told if r.quality) >= 0.99 * sum(r.quality for r in told)
