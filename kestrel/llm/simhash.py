"""SimHash near-duplicates through a Gray-order hierarchical index.

``fingerprints`` makes a 64-bit SimHash of every whole text. ``links`` finds all pairs of distinct fingerprints
within a few differing bits:

1. *Gray order.* Fingerprints are sorted by Gray rank (the number whose reflected Gray code they are): neighbours
   then differ in few bits, and all that share their leading bits stand together.
2. *Cells.* The 64 bits are cut into ``limit + 1`` blocks. Two fingerprints that differ in ``limit`` bits at most agree on
   one block at least, so each is dealt into ``limit + 1`` cells, one by each block's value: a constant number,
   however many fingerprints there are. Of a block only as many bits count as the number of fingerprints calls for.
3. *Index.* Inside a cell, fixed runs of consecutive fingerprints are leaves; each upper node covers a run of lower ones.
   A node keeps a mask of the bits on which everything beneath it agrees and their values; bits that an ancestor
   already fixed are factored out of its own mask, so each bit is compared once on a way down.
4. *Search.* Queries walk down all levels at once, adding up the differences on each node's own bits; a node whose sum
   exceeds the limit is pruned with all beneath it. At the leaves the sum is the exact bit distance, so every link is
   found and none is guessed.

A cell is bounded by its number of distinct fingerprints. Should one outgrow ``cell_rows``, because bits are uneven, its
rows (and only they) are dealt again in the same way by blocks of the bits that the cell doesn't fix, until cells
fit; where few enough bits are left, a cell cannot be larger. A fingerprint has at most C(64,0)+C(64,1)+C(64,2) = 2081
partners at two bits, and each task reduces its pairs to a spanning forest (union-find), so the links that leave it number
at most the fingerprints it has read. Exact copies share one fingerprint and are never paired.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import stage, without
from kestrel.llm.components import components

#: Shingles hashed at a time; bounds the memory that one very long text needs.
STRETCH = 1 << 16


def simhash(text: str | None, width: int, seed: int) -> int:
    """Unsigned 64-bit fingerprint of one text; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), seed)
    n, counts = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, STRETCH):
        part = words[at:min(at + STRETCH, n) + width - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[:len(part) - width + 1].tolist(), ends[width - 1:].tolist())
        hashes = np.array([digest(line[a:b], seed) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the SimHash as a signed long. Null and empty texts, and those without words: 0. A text of
    fewer than ``width`` words is one shingle. One row per input row, ids null or repeated included."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, width, seed) for t in texts], np.uint64).view(np.int64), dtype="int64")

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_index(codes: np.ndarray, fanout: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the root down to the Gray-sorted codes; each level is (own masks, agreed values). Node i of a
    level covers nodes i*fanout up to (i+1)*fanout - 1 of the next."""
    agree, value = [np.full(len(codes), ~np.uint64(0))], [codes]
    while len(value[0]) > 1:
        at = np.arange(0, len(value[0]), fanout)
        all_ones, any_one = np.bitwise_and.reduceat(value[0], at), np.bitwise_or.reduceat(value[0], at)
        agree.insert(0, np.bitwise_and.reduceat(agree[0], at) & ~(all_ones ^ any_one))
        value.insert(0, all_ones)
    own = [agree[0]]
    for upper, lower in zip(agree, agree[1:]):
        own.append(lower & ~np.repeat(upper, fanout)[:len(lower)])
    return list(zip(own, value))


def search(index: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, limit: int, fanout: int = 8, room: int = 1 << 21):
    """Yield (query positions, code positions) of all pairs within ``limit`` bits, in slices of bounded size."""
    todo = [(0, np.arange(lo, min(lo + room // 8, len(queries))), None, None) for lo in range(0, len(queries), room // 8)]
    while todo:
        level, q, node, spent = todo.pop()
        if node is None:
            node, spent = np.zeros(len(q), np.int64), np.zeros(len(q), np.uint8)
        else:  # from the nodes that survived to their children
            size = len(index[level][0])
            node = (node[:, None] * fanout + np.arange(fanout)).ravel()
            q, spent = np.repeat(q, fanout), np.repeat(spent, fanout)
            there = node < size
            q, node, spent = q[there], node[there], spent[there]
        own, value = index[level]
        spent = spent + np.bitwise_count((queries[q] ^ value[node]) & own[node])
        near = spent <= limit
        q, node, spent = q[near], node[near], spent[near]
        if level + 1 == len(index):
            if len(q):
                yield q, node
        else:
            step = room // fanout
            todo += [(level + 1, q[lo:lo + step], node[lo:lo + step], spent[lo:lo + step]) for lo in range(0, len(q), step)]


def spanning(left: np.ndarray, right: np.ndarray, parent: np.ndarray) -> None:
    """Union the pairs into ``parent`` (smaller position wins), vectorised: hook larger roots on smaller ones and
    shorten the paths until every pair has one root."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def blocks(fixed: int, n: int, width: int) -> list[int]:
    """Masks of the bits that ``fixed`` leaves open, dealt into ``n`` blocks of which at most ``width`` bits count.
    Bits in turn go to different blocks, so that neighbouring bits that depend on each other do not meet in one."""
    open_ = [b for b in range(63, -1, -1) if not fixed >> b & 1]
    return [fixed | sum(1 << b for b in open_[i::n][:width]) for i in range(n)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, limit: int = 2, cell_rows: int = 1 << 13) -> DataFrame:
    """(a, b): a spanning forest of all links between the distinct values of ``fps.fp`` (a long): a and b are
    connected through it exactly if a chain of values leads from one to the other, each step differing in at most
    ``limit`` bits. Fewer than two values: no rows."""
    distinct = stage(fps.select("fp").distinct(), "fingerprints")
    cell_rows = max(cell_rows, 1 << (limit + 1))  # a larger cell has an open bit for each block
    n, rounds = distinct.count(), 0
    bits = lambda rows: max(0, (2 * rows // cell_rows).bit_length())  # noqa: E731  that leave about half of cell_rows in a cell

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        """A copy of each fingerprint for each mask; a cell is a mask and the bits under it."""
        each = F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in masks])).alias("mask")
        return rows.select("fp", each).withColumn("cell", F.col("fp").bitwiseAND(F.col("mask")))

    def found(batch: pd.DataFrame) -> pd.DataFrame:
        codes = batch["fp"].to_numpy(np.int64).view(np.uint64)
        codes = codes[np.argsort(gray_rank(codes))]
        parent = np.arange(len(codes))
        if len(codes) > 1:
            for q, node in search(build_index(codes), codes, limit):
                spanning(q, node, parent)
        linked = np.flatnonzero(parent != np.arange(len(codes)))
        return pd.DataFrame({"a": codes[linked].view(np.int64), "b": codes[parent[linked]].view(np.int64)})

    out, todo = [], dealt(distinct, blocks(0, limit + 1, bits(n)) if n > cell_rows // 2 else [0])
    while True:
        large = stage(todo.groupBy("mask", "cell").count().filter(F.col("count") > cell_rows), "large-cells")
        masks = {r[0] % (1 << 64): r[1] for r in large.groupBy("mask").agg(F.max("count")).collect()}  # at most limit + 1 to the power of the rounds
        if not masks:
            return reduce(DataFrame.union, [*out, todo.groupBy("mask", "cell").applyInPandas(found, "a long, b long")])
        rounds += 1  # each takes more bits than the last, so there are few
        large_rows = stage(todo.join(large, ["mask", "cell"], "left_semi"), "large-cells-rows")
        out.append(todo.join(large, ["mask", "cell"], "left_anti").groupBy("mask", "cell").applyInPandas(found, "a long, b long"))
        wider = [dealt(large_rows.filter(F.col("mask") == signed(m)).select("fp"), blocks(m, limit + 1, bits(most) + 4 * (rounds - 1))) for m, most in sorted(masks.items())]
        todo = stage(reduce(DataFrame.union, wider), "cells")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, limit: int = 2) -> DataFrame:
    """(id, fp, component): component is the smallest id that a chain of links reaches, the row's own included.

    One row per input row. Rows with equal fingerprints are one class; an id null is never the smallest unless all
    of the component's ids are null. Empty table: no rows.
    """
    made = stage(fingerprints(docs, id_col, text_col, width, seed), "simhash")
    classes = made.groupBy("fp").agg(F.min("id").alias("least"))
    roots = stage(components(links(classes, limit)).withColumnRenamed("node", "fp"), "roots")
    linked = classes.join(roots, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    alone = classes.join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component"))
    return made.join(named.unionByName(alone), "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The input rows less near-duplicates, all columns kept: of each component the row with the smallest id
    stays. Ids should be unique; rows that share one stay or go together."""
    groups = near_groups(docs, id_col, **how)
    lost = groups.filter(~F.col("id").eqNullSafe(F.col("component"))).select("id").distinct()
    return without(docs, stage(lost, "near-duplicates"), {"id": F.col(id_col)})
