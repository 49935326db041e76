import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kestrel.llm import simhash


def plain_fingerprint(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, limit=2):
    """{fp: smallest fp reachable}, by comparing every pair."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin(a ^ b).count("1") <= limit:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


TEXTS = [None, "", "  \t\n", "one", "One", "two words", "a b c", "A B  C", "Straße ÉCOLE été", "a b c d " * 50,
         "nul\x00byte in it", "x " * 3000, "emoji 😀 here now"]


def test_fingerprints_match_a_plain_version(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, fp string")
    got = {r.id: r.fp % 2**64 for r in simhash.fingerprints(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def test_long_text_is_hashed_in_stretches(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.simhash(text, 3, 42)
    monkeypatch.setattr(simhash, "STRETCH", 64)
    assert simhash.simhash(text, 3, 42) == whole == plain_fingerprint(text)


def test_gray_rank_is_the_inverse_of_the_gray_code():
    n = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 700])
def test_index_finds_exactly_the_near_pairs(n):
    rnd = np.random.default_rng(n)
    codes = rnd.integers(0, 2**64, size=n, dtype=np.uint64)
    codes[n // 2:] = codes[: n - n // 2] ^ (np.uint64(1) << rnd.integers(0, 64, n - n // 2).astype(np.uint64))
    codes = np.unique(codes)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    got = set()
    for q, node in simhash.search(simhash.build_index(codes), codes, 2, room=256):
        got |= set(zip(q.tolist(), node.tolist()))
    bits = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(bits <= 2))))


@pytest.mark.parametrize("cell_rows", [1 << 13, 16])
def test_links_connect_what_brute_force_connects(spark, cell_rows):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = [b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(5)] + base + [0, 1, 3, 7]
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, cell_rows).collect()
    want = plain_components(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for a, b in links:
        assert bin((a ^ b) % 2**64).count("1") <= 64 and want[a % 2**64] == want[b % 2**64]
        x, y = sorted((find(a % 2**64), find(b % 2**64)))
        root[y] = x
    assert {f: find(f) for f in fps} == want


def test_blocks_share_out_the_open_bits():
    masks = simhash.blocks(0, 3, 64)
    assert masks[0] | masks[1] | masks[2] == 2**64 - 1 and masks[0] & masks[1] == masks[0] & masks[2] == 0
    wider = simhash.blocks(masks[0], 3, 5)
    assert all(m & masks[0] == masks[0] and bin(m & ~masks[0]).count("1") == 5 for m in wider)


def test_uneven_bits_are_dealt_again_until_cells_fit(spark):
    """Fingerprints that differ in the same few bits only fill one cell of every block."""
    rnd = random.Random(8)
    high = rnd.getrandbits(64) & ~((1 << 12) - 1)
    fps = [high | rnd.getrandbits(12) for _ in range(900)] + [rnd.getrandbits(64) for _ in range(100)]
    fps = sorted(set(fps) - {f for f in fps if bin(f & 4095).count("1") % 3 != 0 and f >> 12 == high >> 12})
    links = simhash.links(spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long"), 2, cell_rows=32).collect()
    want, root = plain_components(fps), {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for a, b in links:
        x, y = sorted((find(a % 2**64), find(b % 2**64)))
        root[y] = x
    assert {f: find(f) for f in fps} == want


def test_components_of_documents(spark):
    near = "the quick brown fox jumps over the lazy dog and runs into the deep green forest near town " * 8
    texts = TEXTS + [near, near + "x", near, "zz yy"]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, near), (7, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.fp % 2**64, r.component) for r in simhash.near_groups(docs).collect()]
    fp = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fp)
    least = {c: min(i for (i, _), f in zip(rows, fp) if comp[f] == c and i is not None) for c in set(comp.values())}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(((i, f, least[comp[f]]) for (i, _), f in zip(rows, fp)), key=key)
    kept = simhash.drop_near_duplicates(docs.withColumn("component", F.lit("c")))
    assert kept.columns == ["doc_id", "text", "component"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(docs).count() == 0 and simhash.drop_near_duplicates(docs).count() == 0
