import random
import re

import numpy as np
import pytest

from kestrel.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, width):
    """{id: (n_words, hit positions, items)} by comparing every window with every window."""
    tests = [(str(i) if i is not None else "", ws[k:k + width] if len(ws) >= width else ws)
             for i, t in items for ws in [words(t)] if ws for k in range(max(1, len(ws) - width + 1))]
    out = {}
    for i, text in docs:
        ws, hit, names = words(text), set(), set()
        for name, window in tests:
            for at in range(len(ws) - len(window) + 1):
                if ws[at:at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    names.add(name)
        out[i] = len(ws), sorted(hit), sorted(names)
    return out


ITEMS = [(1, "One two three four five six"), (2, "four FIVE six seven"), (3, "Straße É été_été"), (4, None), (5, ""), (6, "?!"),
         (10, "one two three"), (None, "lonely words here now"), (1, "another one, of item one"), (7, "solo")]
DOCS = [(0, None), (1, ""), (2, "...\n\t!"), (3, "x one-two,three FOUR five y"), (4, "four five six seven one two three four"),
        (5, "straße É été été and solo"), (6, "lonely words here now"), (7, "one two three" * 3), (8, "ONE TWO THREE " * 40),
        (9, "clean text of other things"), (10, "Straße é été été"), (11, "item one"), (12, "of item one")]


def spread(spans):
    return [w for s in spans for w in range(s.first, s.last + 1)]


@pytest.mark.parametrize("most_bytes", [1 << 25, 120])
@pytest.mark.parametrize("width", [3, 4])
def test_against_every_window(spark, width, most_bytes):
    rng = random.Random(width)
    more = [(100 + i, " ".join(rng.choice("one two three four five six seven solo É item of".split()) for _ in range(rng.randrange(40)))) for i in range(60)]
    docs = spark.createDataFrame(DOCS + more, "doc_id long, text string").repartition(3)
    found = D.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), width=width, most_bytes=most_bytes).collect()
    want = plain(DOCS + more, ITEMS, width)
    assert {r.id: (r.n_words, spread(r.spans), r["items"]) for r in found} == want
    assert all(r.n_hit == len(want[r.id][1]) and r.contaminated == bool(want[r.id][1]) for r in found)


def test_removal_keeps_the_rest_and_all_columns(spark):
    docs = spark.createDataFrame([(1, "Say: One, two THREE! bye", "a"), (2, "fine", "b"), (3, None, "c"), (1, "one two three one two three", "d"), (4, "É one two three é", "e")],
                                 "doc_id long, text string, _contamination string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    cut = {r._contamination: r.text for r in D.decontaminated(docs, bench, width=3).collect()}
    assert cut == {"a": "Say: ! bye", "b": "fine", "c": None, "d": "", "e": "É  é"}
    left = D.decontaminated(docs, bench, remove="documents", width=3)
    assert left.columns == docs.columns and sorted(r._contamination for r in left.collect()) == ["b", "c"]
    with pytest.raises(ValueError, match="remove"):
        D.decontaminated(docs, bench, remove="lines")


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in D.contamination(docs, none).collect()] == [(3, 0, [])]
    assert D.contamination(docs.limit(0), none).collect() == []


def test_long_texts_are_cut_in_stretches(monkeypatch):
    found = D.HashSet([("b c d", "7"), ("d e", "8")])
    text = b"a b c d e " * 500 + b"x" * 300 + b" d e"
    whole = found.found([text, b"", b"c d e"])
    monkeypatch.setattr(D, "STRETCH", 16)
    assert found.found([text, b"", b"c d e"]) == whole
    assert whole[0][0] == 2503 and whole[0][2] == ["7", "8"] and whole[2] == (3, [1, 3], ["8"])


def test_no_two_windows_share_a_hash():
    windows = [" ".join(f"w{(i * 7 + k) % 991}" for k in range(10)) for i in range(5000)]
    made = D.HashSet([(w, str(i)) for i, w in enumerate(windows)])
    hashes = made.of_length[10][1]
    assert len(hashes) == len(set(windows)) == len(np.unique(hashes))
