import hashlib
import re

from pyspark.sql import functions as F

from kestrel.llm import dedup
from kestrel.session import work_dir

ROWS = [(5, "a  b", "x"), (3, "a\tb", "y"), (9, "a b", None), (4, "A b", ""), (7, None, ""), (6, "", ""), (8, " ", ""),
        (None, "a b", ""), (None, "only null id", ""), (2, "é x", ""), (1, "é x", ""), (10, "long " * 20000, ""),
        (11, "long\n" * 20000, ""), (12, "twice", ""), (12, "twice", ""), (13, "same id", ""), (13, "a b", "")]


def plain(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    out = []
    for (i, *_), n in zip(rows, norm):
        ids = [j for (j, *_), m in zip(rows, norm) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, hashlib.sha256(n.encode()).hexdigest(), keep, len(ids)))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, body string").repartition(3)


def key(r):
    return str(r)


def test_matches_a_plain_version(spark):
    got = dedup.duplicates(docs_of(spark, ROWS)).collect()
    assert sorted(((r.id, r.digest, r.keep_id, r.group_size) for r in got), key=key) == sorted(plain(ROWS), key=key)
    assert all(r.kept for r in got if r.group_size == 1)
    by = {}
    for r in got:
        by.setdefault(r.digest, []).append(r.kept)
    assert all(sum(k) == 1 for k in by.values())


def test_a_weak_digest_changes_nothing_but_the_digest(spark):
    got = dedup.duplicates(docs_of(spark, ROWS), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1)).collect()
    assert sorted(((r.id, r.keep_id, r.group_size) for r in got), key=key) == sorted(((i, k, n) for i, _, k, n in plain(ROWS)), key=key)
    assert sum(r.kept for r in got) == len({d for _, d, _, _ in plain(ROWS)})


def test_kept_rows_keep_their_columns(spark):
    docs = docs_of(spark, ROWS)
    kept = dedup.drop_duplicates(docs)
    assert kept.schema == docs.schema
    want = {(d, k) for _, d, k, _ in plain(ROWS)}
    got = [(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest(), r.doc_id) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want


def test_state_goes_on_over_several_runs_and_batches(spark):
    """Later files meet the state of earlier ones, nothing expires, and a finished stream run again adds nothing."""
    root, seen = work_dir(spark, "dedup-test"), []
    for part in (ROWS[:6], ROWS[6:]):
        docs = docs_of(spark, part).select(F.col("doc_id").alias("id"), dedup.normalised(F.col("text")).alias("body"))
        docs.withColumn("digest", dedup.sha256(F.col("body"))).write.mode("append").parquet(f"{root}/landed")
        seen += part
        landed = spark.read.parquet(f"{root}/landed")
        for _ in range(2):
            state = dedup.fold_stream(landed, f"{root}/landed", f"{root}/check", batch_files=1)
            assert {(r.digest, r.keep_id, r.n) for r in state.collect()} == {(d, k, n) for _, d, k, n in plain(seen)}


def test_later_calls_meet_earlier_documents(spark):
    root = work_dir(spark, "dedup-test")
    dedup.duplicates(docs_of(spark, ROWS[:6]), checkpoint=root)
    got = dedup.duplicates(docs_of(spark, ROWS[6:]), checkpoint=root).collect()
    assert sorted(((r.id, r.digest, r.keep_id, r.group_size) for r in got), key=key) == sorted(plain(ROWS), key=key)


def test_empty_table(spark):
    docs = docs_of(spark, [])
    assert dedup.duplicates(docs).count() == 0 and dedup.drop_duplicates(docs).count() == 0
