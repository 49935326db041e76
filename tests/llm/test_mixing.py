import random

import pytest
from pyspark.sql import functions as F

from kestrel.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def corpus(n=3000):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        source = rnd.choice(["hot"] * 6 + ["a", "é", "Z", None, "zz", "tiny"])
        rows.append((i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 200])), source if i % 100 or source != "tiny" else "b", "clash"))
    return rows + [(n, None, "a", ""), (n + 1, "", None, ""), (None, "one two", "a", ""), (n + 2, "x " * 50000, "hot", "")]


def plain_targets(sizes, weights, share, most):
    """Deal out, stop what is above, deal the excess out again."""
    free, target = set(sizes), dict.fromkeys(sizes, 0.0)
    left = share * sum(sizes.values())
    while free and left > 1e-9:
        total, spare = sum(weights[s] for s in free), 0.0
        for s in free:
            target[s] += left * weights[s] / total
        for s in [s for s in free if target[s] >= most * sizes[s]]:
            spare += target[s] - most * sizes[s]
            target[s] = most * sizes[s]
            free.discard(s)
        left = spare
    return target


def test_targets_taken_and_reruns(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, [3, 1, 2]).collect()
    assert sorted((str(r.id), r.size) for r in got) == sorted((str(i), len((t or "").split())) for i, t, *_ in rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = plain_targets(sizes, {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    largest = {}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:  # within one document of the target
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    again = mixing.mix(docs.repartition(5), [3, 1, 2]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_many_small_documents_hit_the_target_in_several_levels(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.expr("if(id % 3 = 0, 's', 'hot')").alias("source"), F.lit("").alias("size"))
    got = mixing.mix(docs, [3, 1, 2]).groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert {r.source for r in got} == {"s", "hot"}
    assert all(abs(r.taken - r.target) <= 3 + 1e-6 for r in got)


def test_documents_keep_their_chance(spark):
    """Sizes of 1 to 10 words: each size's mean number of copies is target / size of the source."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(id % 10) + 1)").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs, [1.0], share=0.7).groupBy("size").agg(F.avg("copies").alias("mean"), F.avg(F.col("target") / F.col("source_size")).alias("want"))
    assert all(abs(r.mean - r.want) < 0.08 and abs(r.want - 0.7) < 1e-9 for r in got.collect())


def test_copies_are_rows(spark):
    rows = corpus(400) + [(3, "same row", "a", ""), (3, "same row", "a", ""), (3, "other text", "a", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mixed_documents(docs, [3, 1, 2])
    assert mixed.columns == docs.columns
    want = {}
    for r in mixing.mix(docs, [3, 1, 2]).collect():
        want[r.id, r.size] = want.get((r.id, r.size), 0) + r.copies
    have = dict.fromkeys(want, 0)
    for r in mixed.collect():
        have[r.doc_id, len((r.text or "").split())] += 1
    assert have == want


def test_rows_of_one_id_and_text_keep_their_own_columns(spark):
    rows = [(1, "a b c", src, f"{src} {i}") for src in "pq" for i in range(40)] + [(None, "d e", src, "null id") for src in ("p", "q", None)]
    rows += [(2, "same", "q", "equal")] * 30 + [(i, "x y", "p", "other") for i in range(10, 30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r.doc_id, r.text, r.source)
    want, have, each = {}, {}, {}
    text = {(i, len((t or "").split()), src): t for i, t, src, _ in rows}
    for r in mixing.mix(docs, [3, 1, 2], share=1.2).collect():
        k = r.id, text[r.id, r.size, r.source], r.source
        want.setdefault(k, []).append(r.copies)
    made = [sorted(map(str, mixing.mixed_documents(d, [3, 1, 2], share=1.2).collect())) for d in (docs, docs.repartition(7))]
    assert made[0] == made[1]
    for r in mixing.mixed_documents(docs, [3, 1, 2], share=1.2, broadcast_rows=0).collect():
        have[key(r)] = have.get(key(r), 0) + 1
        each[tuple(r)] = each.get(tuple(r), 0) + 1
    assert have == {k: sum(n) for k, n in want.items() if sum(n)}
    assert any(len(set(n)) > 1 for n in want.values())  # some of a group are taken once more
    for src in "pq":
        counts = sorted(each.get((1, "a b c", src, f"{src} {i}"), 0) for i in range(40))
        assert counts == sorted(want[1, "a b c", src])


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), [3, 1, 2]).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, " ", "a", ""), (2, None, None, "")], SCHEMA), [3, 1, 2]).collect()
    assert [(r.size, r.target, r.copies) for r in got] == [(0, 0.0, 0)] * 2



def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def xx(*values):
    """Spark's xxhash64 of ints (4 bytes) and longs (8 bytes): each value's hash is seeded with the one before."""
    import xxhash

    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(int(v).to_bytes(4 if kind == "int" else 8, "little", signed=True), h)
    return h


def drawn(*values):
    return (xx(*values) >> 11) * 2.0 ** -53


def plain_mix(items, seed):
    """{(id, row): extra} of items (id, row, size, x) of one source: leaves, then one node after the other."""
    import math

    fan = mixing.FAN
    depth = max(0, math.ceil(math.log(max(1, len(items) / fan), fan) - 1e-9))
    todo = [(signed(xx(("int", seed), ("long", i), ("long", r), ("long", s))) % fan ** depth, i, r, s, x) for i, r, s, x in items]
    extra = {}
    for level in range(depth + 1):
        nodes = {}
        for node, *item in todo:
            nodes.setdefault(node, []).append(item)
        todo = []
        for node, members in sorted(nodes.items()):
            members.sort(key=lambda m: (drawn(("int", seed + 1), ("int", level), ("long", m[0]), ("long", m[1])), m[0], m[1]))
            held = members[0]
            for new in members[1:]:
                (i1, r1, s1, x1), (i2, r2, s2, x2) = held, new
                up1, down1, up2, down2 = s1 * (1 - x1), s1 * x1, s2 * (1 - x2), s2 * x2
                to_held, to_new = min(up1, down2), min(down1, up2)
                if drawn(("int", seed), ("int", level), ("long", i1), ("long", r1), ("long", i2), ("long", r2)) * (to_held + to_new) < to_new:
                    if up1 <= down2:
                        extra[i1, r1], held = 1, [i2, r2, s2, x2 - up1 / s2]
                    else:
                        extra[i2, r2], held = 0, [i1, r1, s1, x1 + down2 / s1]
                elif down1 <= up2:
                    extra[i1, r1], held = 0, [i2, r2, s2, x2 + down1 / s2]
                else:
                    extra[i2, r2], held = 1, [i1, r1, s1, x1 - up2 / s1]
                held[3] = max(0.0, min(1.0, held[3]))
            todo.append((node // fan, *held))
    for _, i, r, _, x in todo:
        extra[i, r] = int(drawn(("int", seed + 2), ("long", i), ("long", r)) < x)
    return extra


def test_a_plain_version_takes_the_same_copies(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.expr("concat(repeat('w ', int(id * 7 % 23) + 1), id)").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs, [1.0], share=0.37, seed=11).collect()
    want = plain_mix([(r.id, r.row, r.size, r.target / r.source_size) for r in got], 11)
    assert {(r.id, r.row): r.copies for r in got} == want


def test_many_equal_rows_are_one_item(spark):
    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.expr("if(id % 10 = 0, null, 'hot')").alias("source"))
    got = mixing.mix(docs, [3, 1, 2], share=1.3).groupBy("source", "target", "copies").count().collect()
    assert sum(r["count"] for r in got) == 30_000
    for source in ("hot", None):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r["count"] * 3 for r in mine) - mine[0].target) <= 3 + 1e-6
        assert max(r.copies for r in mine) - min(r.copies for r in mine) <= 1


def test_equal_rows_are_written_out_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 8)
    items = spark.createDataFrame([(1, 1, 5, 1, 0, 1), (2, 2, 5, 8, 3, 0), (3, 3, 5, 9, 9, 0), (4, 4, 5, 100, 40, 1)], "id long, row long, size long, n long, sure long, extra long")
    got = {(r.id, r.extra): r["count"] for r in mixing.written_out(items, []).groupBy("id", "extra").count().collect()}
    assert got == {(1, 1): 1, (2, 1): 3, (2, 0): 5, (3, 1): 9, (4, 1): 41, (4, 0): 59}
