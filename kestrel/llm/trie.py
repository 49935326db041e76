"""Conversation prefix trie: ternary search trees over dictionary-encoded turns, one for each range of the sequences.

1. *Dictionary.* Distinct turns (role, text) are numbered in the order of their digests, by ranges. Turns get their
   numbers by a shuffle join; turns that hold at least 1/1000 of all rows, at most 1000 by that, by a broadcast.
2. *Sequences.* A conversation's turns become an array of (number, bytes of the text); equal arrays are one sequence with a
   count and a smallest member, combined in each task. The digest of a sequence's members is streamed: ranges of ids
   are joined to strings where they lie, and one task feeds a sequence's strings in order to SHA-256.
3. *Shards.* Sequences are range-partitioned in lexical order. A shard's task inserts them into one ternary search tree,
   the middle of each run first, so that the trees of siblings are balanced. Every node of it is a trie node; children
   come after their parents, so one pass from the last node to the first accumulates leaves and savings.
4. *Boundary nodes.* Only prefixes of a shard's first and last sequence can lie in two shards. They carry a digest of their
   path and only their own parts; the parts are merged by digest, and subtree sums over the merged nodes are made by
   doubling: in round k every node hands its sum to the ancestor 2^k above. Other nodes are final within their shard.

A conversation's numbers, 16 bytes a turn, are one value: a task holds one conversation without its texts, and a shard
holds its distinct sequences. Copies, however many, are one sequence.

Defined results: rows of a null conv_id belong to no conversation and are left out; a null role or text is empty; null
turns come first; rows that agree in conv_id and turn follow each other in the order of their turns' digests; an empty
table gives the root alone, without members, its conv_id null.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import positions, stage

TURNS = "array<struct<id:bigint,bytes:bigint>>"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def coded_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, id, bytes): each row with its turn's number and the bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = stage(conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                                                                         digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")), "turns")
    counted = stage(turns.groupBy("digest").count(), "turn-counts")
    numbers = stage(positions(counted, "digest"), "dictionary")
    hot = counted.filter(F.col("count") >= F.lit(max(2, -(-turns.count() // 1000)))).select("digest")  # at most 1000
    hot_numbers = numbers.join(F.broadcast(hot), F.col("key") == F.col("digest"), "left_semi").toDF("digest", "hot_id")
    met = turns.join(F.broadcast(hot_numbers), "digest", "left")
    known = met.filter("hot_id IS NOT NULL").select("conv_id", "turn", F.col("hot_id").alias("id"), "bytes")
    rest = met.filter("hot_id IS NULL").join(numbers.toDF("digest", "id"), "digest")
    return known.union(rest.select("conv_id", "turn", "id", "bytes"))


def rebuilt(turns: DataFrame, block: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, turns): every conversation c as the first h turns of conversation c - c % block, then its own after
    its first h, where h = crc32(decimal c) % most. A conversation that isn't there has no turns; % takes the sign of c."""
    in_order = F.sort_array(F.collect_list(F.struct("turn", "id", "bytes")))
    own = stage(turns.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("own")), "own-turns")
    first = own.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    met = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % block, "h": h}).join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(TURNS)), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(head, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("turns"))


def members(convs: DataFrame) -> DataFrame:
    """(seq, ends): for each ``seq`` the SHA-256 of its conv_ids in ascending order, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for of, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != seq:
                    if seq is not None:
                        done.append((seq, digest.hexdigest()))
                    seq, digest = of, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], ["seq", "ends"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["seq", "ends"])

    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = convs.select("conv_id", "seq").repartitionByRange(parts, "conv_id").withColumn("part", F.spark_partition_id())
    joined = dealt.groupBy("seq", "part").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    in_order = joined.repartition(parts, "seq").sortWithinPartitions("seq", "part")
    return in_order.select("seq", "ids").mapInArrow(run, "seq binary, ends string")


def sequences(convs: DataFrame) -> DataFrame:
    """(turns, n, least, ends): the distinct sequences of ``convs`` (conv_id, turns)."""
    seq = F.unhex(F.sha2(F.array_join(F.col("turns.id").cast("array<string>"), " "), 256))
    keyed = stage(convs.withColumn("seq", seq), "rebuilt")
    counted = keyed.groupBy("seq", "turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    return stage(counted.join(members(keyed), "seq").select("turns", "n", "least", "ends"), "sequences")


class SearchTree:
    """A ternary search tree whose nodes are trie nodes: ``key`` is a node's last turn; ``less``, ``more`` lead to siblings,
    ``down`` to the tree of children. Node 0 is the root of the trie. Columns hold 8 bytes a node."""

    def __init__(self):
        self.key, self.less, self.more, self.down, self.parent, self.depth, self.bytes, self.n, self.least, self.ends = (array("q") for _ in range(10))
        self.node(-1, -1, 0, 0)

    def node(self, key: int, parent: int, depth: int, size: int) -> int:
        for column, value in ((self.key, key), (self.less, 0), (self.more, 0), (self.down, 0), (self.parent, parent), (self.depth, depth),
                              (self.bytes, size), (self.n, 0), (self.least, (1 << 63) - 1), (self.ends, -1)):
            column.append(value)
        return len(self.key) - 1

    def child(self, parent: int, key: int, size: int) -> int:
        at = self.down[parent]
        if not at:
            self.down[parent] = at = self.node(key, parent, self.depth[parent] + 1, size)
            return at
        while self.key[at] != key:
            side = self.less if key < self.key[at] else self.more
            if not side[at]:
                side[at] = new = self.node(key, parent, self.depth[parent] + 1, size)
                return new
            at = side[at]
        return at

    def insert(self, sequence: int, ids: list[int], sizes: list[int], n: int, least: int) -> list[int]:
        """The nodes from the root to the sequence's end."""
        path = [0]
        for key, size in zip(ids, sizes):
            path.append(self.child(path[-1], key, size))
        for at in path:
            self.n[at] += n
            self.least[at] = min(self.least[at], least)
        self.ends[path[-1]] = sequence
        return path


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each run before its halves."""
    runs = [(0, n)]
    while runs:
        lo, hi = runs.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            runs += [(mid + 1, hi), (lo, mid)]


NODES = ("path binary, above binary, depth long, conv_id long, parent_conv_id long, n long, children long, leaves long, saved long, "
         "bytes long, ends string")


def shard_nodes(rows: pa.Table) -> Iterator[list[tuple]]:
    """The nodes of one shard's trie, as rows of ``NODES``; ``rows``: its sequences in ascending order. ``path`` is set for
    nodes that other shards may share, ``above`` for them and their children; their counts hold what other nodes, whole in this
    shard, add to them."""
    ids, ends = rows.column("ids"), rows.column("ends")
    sizes, n, least = rows.column("sizes"), rows.column("n"), rows.column("least")
    tree, edge = SearchTree(), {}
    for i in medians(rows.num_rows):
        nodes = tree.insert(i, ids[i].as_py(), sizes[i].as_py(), n[i].as_py(), least[i].as_py())
        if i in (0, rows.num_rows - 1):
            for at in nodes:
                edge[at] = b""
    for at in sorted(edge):  # parents first
        edge[at] = hashlib.sha256(edge[tree.parent[at]] + tree.key[at].to_bytes(8, "big", signed=True)).digest() if at else b""
    size = len(tree.key)
    children, leaves, saved = (array("q", bytes(8 * size)) for _ in range(3))
    out = []
    for at in range(size - 1, -1, -1):
        parent, shared = tree.parent[at], at in edge
        if not shared:
            if not children[at]:
                leaves[at] = 1
            saved[at] += (tree.n[at] - 1) * tree.bytes[at]
            children[parent] += 1
            leaves[parent] += leaves[at]
            saved[parent] += saved[at]
        out.append((edge.get(at), edge.get(parent), tree.depth[at], tree.least[at], tree.least[parent] if at else None, tree.n[at], children[at], leaves[at],
                    saved[at], tree.bytes[at], ends[tree.ends[at]].as_py() if tree.ends[at] >= 0 else None))
        if len(out) == 1 << 14:
            yield out
            out = []
    yield out


def subtree_sums(own: DataFrame) -> DataFrame:
    """(path, leaves, saved) of ``own`` (path, above, leaves, saved; nodes of a tree) summed over each node's subtree."""
    now = stage(own.select("path", F.col("above").alias("up"), "leaves", "saved"), "subtree-sums")
    while now.filter("up IS NOT NULL").limit(1).count():  # rounds: the logarithm of the depth
        given = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        farther = now.select(F.col("path").alias("up"), F.col("up").alias("next"))
        now = stage(now.join(given, "path", "left").join(farther, "up", "left").select(
            "path", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "subtree-sums")
    return now.select("path", "leaves", "saved")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """The trie of ``seqs`` (turns, n, least, ends), a row for each node: depth, conv_id (the smallest member), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (over the subtree, (n_convs - 1) times the bytes of a node's last text), ends (the
    digest of those that end here, else null)."""
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if whole:
            schema = [("path", pa.binary()), ("above", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n", "children", "leaves", "saved", "bytes")),
                      ("ends", pa.string())]
            for made in shard_nodes(pa.Table.from_batches(whole)):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*made), schema)], [name for name, _ in schema])

    dealt = seqs.select(F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("sizes"), "n", "least", "ends").repartitionByRange(parts, "ids")
    nodes = stage(dealt.sortWithinPartitions("ids").mapInArrow(run, NODES), "shard-nodes")

    total = lambda c: F.sum(c).alias(c)
    shared = stage(nodes.filter("path IS NOT NULL").groupBy("path", "above", "depth", "bytes").agg(
        F.min("conv_id").alias("conv_id"), total("n"), total("children"), total("leaves"), total("saved"), F.max("ends").alias("ends")), "shared-nodes")
    below = shared.filter("above IS NOT NULL").groupBy(F.col("above").alias("path")).agg(F.count("*").alias("shared_children"))
    shared = stage(shared.join(below, "path", "left").withColumn("children", F.col("children") + F.coalesce("shared_children", F.lit(0))), "shared-nodes")
    own = shared.select("path", "above", (F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0)).alias("leaves"),
                        (F.col("saved") + (F.col("n") - 1) * F.col("bytes")).alias("saved"))
    parents = shared.select(F.col("path").alias("above"), F.col("conv_id").alias("parent"))
    merged = shared.drop("leaves", "saved").join(subtree_sums(own), "path").join(parents, "above", "left")
    return named(nodes.filter("path IS NULL AND above IS NULL"), F.col("parent_conv_id")).unionByName(
        named(with_parent(nodes.filter("path IS NULL AND above IS NOT NULL"), parents), F.col("parent"))).unionByName(named(merged, F.col("parent")))


def with_parent(nodes: DataFrame, parents: DataFrame, most: int = 200_000) -> DataFrame:
    """``nodes`` with their parent's conv_id; up to ``most`` parents (a digest and a number each) are broadcast."""
    few = parents.limit(most + 1).count() <= most
    return nodes.join(F.broadcast(parents) if few else parents, "above")


def named(nodes: DataFrame, parent: Column) -> DataFrame:
    return nodes.select("depth", "conv_id", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
                        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends")


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      block: int = 5, most: int = 9) -> DataFrame:
    """The trie of all conversations, rebuilt by ``rebuilt``, with ends_sha256 for every node."""
    seqs = sequences(rebuilt(coded_turns(conversations, conv_col, turn_col, role_col, text_col), block, most))
    if seqs.isEmpty():
        root = "SELECT 0L AS depth, CAST(NULL AS LONG) AS conv_id, CAST(NULL AS LONG) AS parent_conv_id, 0L AS n_convs, 0L AS n_children, 1L AS n_leaves, 0L AS saved_tokens, CAST(NULL AS STRING) AS ends"
        found = seqs.sparkSession.sql(root)
    else:
        found = prefix_trie(seqs)
    return found.withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY_SHA))).drop("ends")
