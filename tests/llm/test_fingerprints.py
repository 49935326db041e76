import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kestrel.llm import fingerprints as fp
from kestrel.llm.common import next_key, positions


def plain_hashes(text, width=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = max(1, len(words) - width + 1) if words else 0
    return {hashlib.md5(" ".join(words[i:i + width]).encode()).hexdigest()[:16] for i in range(n)}


def plain_sketch(text):
    every = plain_hashes(text)
    low = {h for h in every if h[0] in "0123"}
    if len(low) >= 4:
        return "4", sorted(low)
    least = sorted(every)[:4]
    return ("g", least) if len(every) <= 4 else (least[-1] + "0", least)


def plain_likeness(a, b):
    below = min(a[0], b[0])
    x, y = ({h for h in s[1] if h < below} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_matches_a_plain_version(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice("alpha beta gamma délta 😀 é fox dog".split())
    texts = [None, "", " \n", "a", "a b c d", "a b c d e", "😀" * 9] + [" ".join(word() for _ in range(rnd.choice([3, 12, 90, 2500]))) for _ in range(25)]
    rows = [(i * i * 7 - 40, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string").repartition(4)
    got = {r.id: r for r in fp.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    order = sorted((i, t or "") for i, t, _ in rows)
    for at, (i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        k = len(text) // 4
        edited = text[:len(text) - k] + following[:k]
        r, a, b, c = got[i], plain_sketch(text), plain_sketch(edited), plain_sketch(following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.sketch.below, r.sketch.hashes) == a and (r.edited_sketch.below, r.edited_sketch.hashes) == b
        assert r.near_edited == plain_likeness(a, b) and r.near_next == plain_likeness(a, c)


def test_one_null_and_repeated_ids_and_empty_table(spark):
    make = lambda rows: fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert make([]) == []
    (one,) = make([(5, "abcdefgh")])
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    both = make([(None, "abcdefgh"), (None, "ABCDEFGH")])  # all null: one of them stands for the next
    assert {r.edited_sha256 for r in both} == {hashlib.sha256(x).hexdigest() for x in (b"abcdefAB", b"ABCDEFAB")}
    rows = make([(1, "aaaaaaaa"), (1, "bbbb"), (2, "zzzz"), (2, "yyyyyy"), (None, "cccccccc")])
    want = {b"aaaaaayy", b"bbby", b"zzza", b"yyyyya", b"ccccccaa"}
    assert {r.edited_sha256 for r in rows} == {hashlib.sha256(x).hexdigest() for x in want}


def test_sketches_merge_and_estimate_containment(spark):
    rnd = random.Random(9)
    big = [f"w{rnd.randrange(4000)}" for _ in range(20000)]
    small = big[300:1300]
    df = spark.createDataFrame([(" ".join(big), " ".join(small), " ".join(big[:9000]), " ".join(big[9000 - 4:]))], "big string, small string, p string, q string")
    for c in ("big", "small", "p", "q"):
        df = fp.with_sketch(df, F.col(c), f"s_{c}")
    s = {c: F.col(f"s_{c}") for c in ("big", "small", "p", "q")}
    r = df.select(fp.containment(s["small"], s["big"]).alias("inside"), fp.containment(s["big"], s["small"]).alias("share"),
                  fp.likeness(s["big"], s["small"]).alias("alike"), (fp.merged(s["p"], s["q"]) == s["big"]).alias("whole")).first()
    assert r.inside == 1.0 and r.whole
    true = len(plain_hashes(" ".join(small))) / len(plain_hashes(" ".join(big)))
    assert r.share == pytest.approx(true, abs=0.02) and r.alike == pytest.approx(true, abs=0.02)


def test_helper_columns_stay_clear_of_the_input(spark):
    df = spark.createDataFrame([("a b c d e f", 1, 2, 3)], "t string, _s_words int, _s_hashes int, _s_low int")
    assert fp.with_sketch(df, F.col("t"), "s").columns == [*df.columns, "s"]


def test_order_helpers(spark):
    ids = [5, -3, 9, 9, None, 0, 2**62, -2**62]
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    distinct = sorted({i for i in ids if i is not None})
    assert {tuple(r) for r in next_key(df, "k").collect()} == set(zip(distinct, distinct[1:] + distinct[:1]))
    names = ["b", "é", "Z", None, "a", "😀", "", "a"]
    got = {r.key: r.position for r in positions(spark.createDataFrame([(n,) for n in names], "k string"), "k").collect()}
    assert got == {n: i for i, n in enumerate([*sorted({n for n in names if n is not None}), None])}
