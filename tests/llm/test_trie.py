import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kestrel.llm import trie


def plain(rows):
    """{(depth, conv_id): node} by collecting the members of every prefix."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    key = lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest())
    order = {c: [t[2:] for t in sorted(ts, key=key)] for c, ts in own.items()}
    for c in order:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seqs[c] = tuple(order.get(base, [])[:h] + order[c][h:])
    nodes = {(): []}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    ends = {p: sorted(c for c in m if len(seqs[c]) == len(p)) for p, m in nodes.items()}
    kids, saved, leaves = {p: 0 for p in nodes}, {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, m in nodes.items():
        mine = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += mine
            leaves[p[:d]] += kids[p] == 0
    return sorted((len(p), min(m) if m else None, min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in nodes.items())


COLUMNS = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows, parts=None):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts or old))
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, n long")
        made = trie.conversation_trie(df)
        return sorted(tuple(r[c] for c in COLUMNS) for r in made.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def conversations(rng, n, longest, words):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in range(n) for t in range(rng.randrange(longest))]


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_against_all_prefixes(spark, parts):
    rng = random.Random(parts)
    rows = conversations(rng, 120, 12, ["a", "b", "Straße", "", "long text of more words"])
    rows += [(c, 0, "system", "the same") for c in range(30, 110)]
    rng.shuffle(rows)
    assert found(spark, rows, parts) == plain(rows)


def test_copies_nulls_ties_and_repeated_rows(spark):
    rows = [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(20)]
    rows += [(1, None, None, None), (1, 5, "user", "x"), (1, 5, "user", "x"), (1, 5, "assistant", "x"), (2, 2**60, "user", None), (None, 1, "user", "lost"),
             (-3, 0, "user", "neg"), (-5, 0, "user", "five"), (-7, 1, "user", "seven"), (0, 0, "user", "zero"), (3, 1, "us", "er:"), (4, 1, "use", "r:")]
    assert found(spark, rows, 5) == plain(rows)


def test_a_deep_chain_across_shards(spark):
    rows = [(c * 5, t, "user", f"t{t}" if t < 150 else f"own {c} {t}") for c in range(12) for t in range(150 + c)]
    rows += [(1, 1, "user", "y")]
    assert found(spark, rows, 9) == plain(rows)


def test_turnless_and_empty(spark):
    assert found(spark, [(3, 0, "user", "only")], 4) == plain([(3, 0, "user", "only")])
    assert found(spark, []) == [(0, None, None, 0, 0, 1, 0, trie.EMPTY_SHA)]
    assert found(spark, [(None, 0, "user", "x")]) == [(0, None, None, 0, 0, 1, 0, trie.EMPTY_SHA)]


def test_medians_balance_the_siblings():
    tree = trie.SearchTree()
    for i in trie.medians(1023):
        tree.insert(i, [i], [1], 1, i)
    depth = [0] * len(tree.key)
    for at in range(1, len(tree.key)):
        for side in (tree.less, tree.more):
            if side[at]:
                depth[side[at]] = depth[at] + 1
    assert max(depth) == 9 and sorted(trie.medians(10)) == list(range(10))


def test_hot_turns_are_not_shuffled_by_their_text(spark):
    rows = [(c, 0, "system", "hot") for c in range(300)] + [(c, 1, "user", f"own {c}") for c in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    coded = trie.coded_turns(df, "conv_id", "turn", "role", "text")
    assert coded.count() == 600 and coded.groupBy("id").count().agg(F.max("count")).first()[0] == 300
