import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrel.llm import bpe

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ALPHABET = [chr(i) for i in range(256)] + list("ΣσςİıǅßÉ中文字你😀🏽٣²½Ⅷ") + ["é", " ", "　", "<|endoftext|>", "<|startoftext|>",
                                                                          "'ll", "'S", "  ", "the", "ing"]


def texts():
    rnd = random.Random(1)
    out = ["", "a" * 4000, "!" * 700, "ab" * 2000, "  \n\n x", "</w>", "ΑΣ ΟΔΟΣ"]
    out += ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    out += ["".join(rnd.choice("ab the in") for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    return out


@pytest.mark.parametrize("file", FILES)
def test_ids_and_texts_are_the_librarys(spark, file):
    path, rows = public_tokenizers.path(file), list(enumerate(texts()))
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(rows + [(-1, None)], "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert len(got) == len(rows) + 1 and got[-1].ids == [] and got[-1].decoded == ""
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].ids == ids, text
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False), text
    once = {r.doc_id: r for r in bpe.encode(docs.withColumn("back", F.lit(1)), path, decoded="back").collect()}
    assert all((once[i].text, once[i].ids, once[i].back) == (r.text, r.ids, r.decoded) for i, r in got.items())


def test_the_tokens_fit_as_the_merges_say():
    """On a small vocabulary: the backtracking encoder gives what applying merges in rank order gives."""
    rnd = random.Random(2)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        while len(merges) < 14:
            a, b = rnd.choice(list(vocab)), rnd.choice(list(vocab))
            if a + b not in vocab and len(a + b) < 9:
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        # Only vocabularies as training makes them: every token is what its own symbols merge to.
        if any(merged(t, merges) != [t] for t in vocab):
            continue
        m = bpe.Merges(vocab, merges)
        names = {i: t for t, i in vocab.items()}
        for _ in range(40):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))
            assert [names[i] for i in m.encode(word)] == merged(word, merges)


def merged(word, merges):
    rank = {m: i for i, m in enumerate(merges)}
    parts = list(word)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_small_batches_and_memory_of_chunks(monkeypatch):
    codec = bpe.Codec(open(public_tokenizers.path(FILES[0]), encoding="utf-8").read())
    want = [codec.encode(t) for t in texts()[:200]]
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec.clear()
    assert [codec.encode(t) for t in texts()[:200]] == want
    import pyarrow as pa
    assert list(bpe.slices(pa.array([1, None, bpe.BATCH_BYTES, 5]))) == [(0, 2), (2, 3), (3, 4)]
    assert np.frombuffer(codec.encode("hello"), np.int32).tolist()


def test_empty_table(spark):
    path = public_tokenizers.path(FILES[0])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, path), path).count() == 0
