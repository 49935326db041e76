import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrel.llm import token_files as tf
from kestrel.session import work_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    """Bits of an unlimited Huffman code."""
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def best_limited_cost(counts, limit):
    """By trying all length multisets that satisfy Kraft's equality (few symbols)."""
    counts = sorted((c for c in counts if c), reverse=True)

    def go(i, room, least):
        if i == len(counts):
            return 0
        best = float("inf")
        for n in range(least, limit + 1):
            need = 1 << limit - n
            if room - need >= len(counts) - i - 1:
                best = min(best, counts[i] * n + go(i + 1, room - need, n))
        return best
    return go(0, 1 << limit, 1)


@pytest.mark.parametrize("seed", range(6))
def test_lengths_are_optimal_and_prefix_free(seed):
    rnd = random.Random(seed)
    counts = np.array([rnd.choice([0, 1, 2, 5, 100, 10**6]) for _ in range(9)])
    counts[:2] = 3
    lengths = tf.code_lengths(counts, 4)
    assert (lengths * counts).sum() == best_limited_cost(counts.tolist(), 4) and lengths.max() <= 4
    assert (lengths > 0).tolist() == (counts > 0).tolist()
    wide = tf.code_lengths(counts, 16)
    assert (wide * counts).sum() == huffman_cost(counts.tolist())
    codes = [format(c, f"0{n}b") for c, n in zip(tf.canonical(wide).tolist(), wide.tolist()) if n]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes) and len(set(codes)) == len(codes)


def test_limits():
    assert tf.code_lengths(np.zeros(5, int)).sum() == 0 and tf.code_lengths(np.array([0, 7])).tolist() == [0, 1]
    assert tf.code_lengths(np.array([1, 1, 1, 1]), 2).tolist() == [2] * 4
    with pytest.raises(ValueError):
        tf.code_lengths(np.ones(5, int), 2)
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    assert tf.code_lengths(np.array(fib)).max() == 16


def test_blocks_round_trip(monkeypatch):
    rnd = np.random.default_rng(3)
    docs = [np.minimum(rnd.geometric(0.02, n), 4000).astype(np.uint32) for n in (1, 127, 128, 129, 0, 5000, 3)]
    lengths = tf.code_lengths(np.bincount(np.concatenate(docs)))
    payload, checkpoints = tf.pack(docs, lengths, tf.canonical(lengths))
    sizes = np.array([len(d) for d in docs])
    assert len(checkpoints) == sum(-(-n // tf.EVERY) for n in sizes)
    assert (tf.unpack(payload, checkpoints, sizes, *tf.table(lengths)) == np.concatenate(docs)).all()
    with pytest.raises(ValueError):
        tf.pack([np.array([lengths.size - 1 if not lengths[-1] else 0], np.uint32)], lengths * 0, tf.canonical(lengths))


@pytest.mark.parametrize("block", [1 << 19, 64])
def test_files_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(tf, "BLOCK_IDS", block)
    monkeypatch.setattr(tf, "REMEMBERED", 50)
    rnd = random.Random(1)
    texts = [None, "", " ", "  \n\n x", "<|endoftext|> a<|endoftext|>", "it's 12 o'clock　now!!", "é😀 " * 300, "a" * 9000, "x y " * 20000]
    texts += ["".join(rnd.choice(["the", " ", "  ", "\n", "Quick", "é", "!?", "7", "😀"]) for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    rows = [(i * 31 % 97 - 20, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = work_dir(spark, "token-test")
    tf.write(tf.encode(docs, VOCABULARY, 0), path)
    got = {r.id: r for r in tf.read(spark, path).collect()}
    library, start = Tokenizer.from_file(VOCABULARY), 0
    assert len(got) == len(rows)
    for i, text, _ in sorted(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].start == start
        start += len(ids)
    order = spark.read.parquet(f"{path}/blocks").orderBy("part", "block").collect()
    assert [d for b in order for d in b.doc_ids] == sorted(got)
    assert len(order) > 3 or block > 64


def test_null_and_repeated_ids_wide_ids_and_no_rows(spark):
    ids = lambda *x: tf.narrowed(np.array(x, np.uint32))
    rows = [(None, ids(70000, 1)), (4, ids(5)), (4, ids(6, 6)), (2, ids())]
    path = work_dir(spark, "token-test")
    tf.write(spark.createDataFrame([(a, bytearray(b), w) for a, (b, w) in rows], "id long, ids binary, width int"), path)
    got = tf.read(spark, path).collect()
    assert sorted((r.id or -1, bytes(r.ids)) for r in got) == sorted((a or -1, np.frombuffer(b, f"<u{w}").astype("<u4").tobytes()) for a, (b, w) in rows)
    assert [r.start for r in got if r.id is None] == [0] and [r.start for r in got if r.id == 2] == [2]
    none = work_dir(spark, "token-test")
    tf.write(spark.createDataFrame([], "id long, ids binary, width int"), none)
    assert tf.read(spark, none).count() == 0


def test_query_checksums(spark):
    from kestrel.llm.catalog import op10_token_files

    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, []
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [0]
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, op10_token_files(spark, sf).collect())) == want
