"""Token ids in files of canonical, length-limited Huffman codes.

Ids travel as little-endian unsigned integers of ``width`` bytes: 2 where all of a document's fit, else 4.

Writing: ids are counted over the whole corpus, package-merge gives the optimal code lengths of at most LIMIT bits,
and the canonical code follows from the lengths alone. Documents are range-partitioned by id and sorted; each task
packs its documents, in order, into independent blocks of about BLOCK_IDS ids. Inside a block every document starts at
a byte, and checkpoints hold the bit offset of every EVERY-th id of each document. Blocks are rows of Parquet files,
so Spark commits, retries and lists them on any store: ``part`` and ``block`` (order), ``ids_before`` (ids of earlier
blocks of the part), ``doc_ids``, ``n_ids``, ``checkpoints`` (unsigned 64-bit, little-endian) and ``payload``; beside
them, ``lengths`` holds the code length of every id that occurs.

Reading: a block needs nothing but the table of the code, which maps every LIMIT-bit prefix to an id and its length.
All checkpoints of a block are decoded side by side, one table look-up each per step.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrel.llm.bpe import GPT_PATTERN, WHITE, byte_symbols, forget_half, slices
from kestrel.llm.common import by_part
from kestrel.session import work_dir

LIMIT = 16
EVERY = 128
BLOCK_IDS = 1 << 19
#: Words whose ids are remembered, for each worker process; and other pieces.
REMEMBERED, REMEMBERED_PIECES = 1 << 20, 1 << 17

BLOCKS = "part int, block int, ids_before long, doc_ids array<long>, n_ids array<long>, checkpoints binary, payload binary"


class WhiteRun(Exception):
    """A word cut off at a space that has more white space beside it."""


class Library(dict):
    """The ``tokenizers`` library behind a memory: word -> the ids of a space and that word, as 32-bit bytes; of a word
    with one or two line ends before it, the ids of that.

    In the byte-level pattern no piece runs from visible characters into the white space after them, and of several
    white spaces only the last joins what follows. So a text cut at its single spaces, and before its line ends, has
    the ids of these words in a row. Texts with longer runs of white space are cut into chunks (white space, then visible characters); a chunk's ids
    are those of its pieces, and the library's model encodes every piece that is not remembered. Files with a
    normalizer, another pattern or a post-processor, and texts that hold a special token's string, go through the
    library as a whole.
    """

    def __init__(self, spec: str):
        super().__init__()
        self.pieces: dict[str, bytes] = {}
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        spec = json.loads(spec)
        pre = spec["pre_tokenizer"] or {}
        self.by_chunk = (not spec["normalizer"] and not spec["post_processor"] and pre.get("type") == "ByteLevel"
                         and pre["use_regex"] and not pre["add_prefix_space"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.chunk = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.piece = regex.compile(GPT_PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.symbols = "".join(byte_symbols())

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                forget_half(self)
            self[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # a single piece
            return self.keep(word, self.encode_piece(" " + word))
        visible = word.lstrip("\n")
        if not visible or visible[0].isspace():
            raise WhiteRun
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            mark, ids = self.of_piece(word[-1]), self.get(word[:-1])
            if ids is None:  # a word that comes once takes one place, with its mark or without
                return self.keep(word[:-1], self.encode_piece(" " + word[:-1])) + mark
            return self.keep(word, ids + mark)
        if word[0] == "\n":
            return self.keep(word, b"".join(map(self.of_chunk, self.chunk.findall(word))))
        chunks = self.chunk.findall(" " + word)
        if len(chunks) > 1:  # white space other than a space
            return b"".join(map(self.of_chunk, chunks))
        return self.keep(word, self.of_pieces(chunks[0]))

    def of_chunk(self, chunk: str) -> bytes:
        if chunk[0] == " " and len(chunk) > 1 and not chunk[1].isspace():
            return self[chunk[1:]]
        return self.of_pieces(chunk)

    def of_pieces(self, chunk: str) -> bytes:
        return b"".join(map(self.of_piece, self.piece.findall(chunk)))

    def of_piece(self, piece: str) -> bytes:
        if piece[0] == " " and piece[1:].isalpha():
            return self[piece[1:]]
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.encode_piece(piece)
            if len(piece) <= 64:
                if len(self.pieces) >= REMEMBERED_PIECES:
                    forget_half(self.pieces)
                self.pieces[piece] = ids
        return ids

    def encode_piece(self, piece: str) -> bytes:
        symbols = codecs.charmap_decode(piece.encode(), "strict", self.symbols)[0]
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        words = iter(text.replace("\n", " \n").replace("\n \n", "\n\n").split(" "))
        try:
            return b"".join(map(self.of_chunk, self.chunk.findall(next(words)))) + b"".join(map(self.__getitem__, words))
        except WhiteRun:
            return b"".join(map(self.of_chunk, self.chunk.findall(text)))


def narrowed(ids: np.ndarray) -> tuple[bytes, int]:
    """(bytes, width) of ids."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return ids.astype(f"<u{width}").tobytes(), width


def widened(ids: pa.Array, width: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, f"<u{w}") for x, w in zip(ids.to_pylist(), width.to_pylist())]


def encode(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", tallied: bool = False) -> DataFrame:
    """(id, ids, width): the ids of every text, null as empty, with ``end_id`` after them. One row per input row; the
    vocabulary file (a path on the driver) is broadcast. ``tallied`` adds a column ``counts``, null in these rows, and
    one more row per task, in which only ``counts`` is set: how often each id from 0 on occurs in the task (int64), so
    that :func:`write` needs no pass of its own for them."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"spec": f.read()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "codec" not in shared.value:
            shared.value["codec"] = Library(shared.value["spec"])
        codec, end, counts = shared.value["codec"], array("I", [end_id]).tobytes(), np.zeros(0, np.int64)

        def rows(names: pa.Array, ids: pa.Array, width: list, tally: list) -> pa.RecordBatch:
            columns = [names, ids, pa.array(width, pa.int32()), pa.array(tally, pa.binary())][: 4 if tallied else 3]
            return pa.RecordBatch.from_arrays(columns, ["id", "ids", "width", "counts"][: len(columns)])

        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(pc.binary_length(texts)):
                found = [codec.encode(t or "") + end for t in texts[lo:hi].to_pylist()]
                flat = np.frombuffer(b"".join(found), np.uint32)
                if tallied:
                    counts = added_up(counts, np.bincount(flat))
                if int(flat.max()) < 1 << 16 and len(flat) < 1 << 30:  # all of 2 bytes: narrowed together
                    ends = np.cumsum([0, *map(len, found)]) // 2
                    ids = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.astype("<u2"))])
                    width = [2] * len(found)
                else:
                    own = [narrowed(np.frombuffer(x, np.uint32)) for x in found]
                    ids, width = pa.array([x for x, _ in own], pa.binary()), [w for _, w in own]
                yield rows(batch.column("id")[lo:hi], ids, width, [None] * len(found))
        if len(counts):
            yield rows(pa.array([None], pa.int64()), pa.array([None], pa.binary()), [None], [counts.tobytes()])

    kinds = "id long, ids binary, width int" + (", counts binary" if tallied else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits for the ids with a count; 0 for the others."""
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves, packages, coins = counts[used].astype(np.float64), np.zeros(0), []
    for _ in range(limit):  # merge the packages of pairs from the row below with the leaves
        row = np.concatenate((leaves, packages))
        order = np.argsort(row, kind="stable")
        coins.append(order < len(leaves))
        row = row[order]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    for is_leaf in reversed(coins):  # a leaf's length is the number of rows that take it
        n = int(is_leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes that go with ``lengths``: shorter first, then by id."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for n in np.unique(lengths[used]):
        at = used[lengths[used] == n]
        code <<= int(n) - before
        codes[at] = code + np.arange(len(at))
        code, before = code + len(at), int(n)
    return codes


def table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) of every ``limit``-bit prefix."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    room = 1 << (limit - lengths[used])
    ids, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
    n = int(room.sum())
    ids[:n], bits[:n] = np.repeat(used, room), np.repeat(lengths[used], room)
    return ids, bits


def pack(ids: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, checkpoints) of the documents of one block."""
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids)
    n_bits = lengths[flat]
    if len(flat) and not n_bits.all():
        raise ValueError("an id without a code")
    ends = np.concatenate(([0], np.cumsum(n_bits)))
    first = np.concatenate(([0], np.cumsum(sizes)))
    total = ends[first[1:]] - ends[first[:-1]]
    start = np.concatenate(([0], np.cumsum((total + 7) // 8 * 8)))  # each document starts at a byte
    at = ends[:-1] + np.repeat(start[:-1] - ends[first[:-1]], sizes)
    window = codes[flat] << (64 - (at & 31) - n_bits).astype(np.uint64)
    word, n_words = at >> 5, int(start[-1] >> 5) + 2
    # Bits never overlap, so sums are unions; they stay below 2**32, exact in floating point.
    words = np.bincount(word, (window >> np.uint64(32)).astype(np.float64), n_words) + np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
    lanes = (sizes + EVERY - 1) // EVERY
    marks = np.arange(lanes.sum()) * EVERY + np.repeat(first[:-1] - (np.cumsum(lanes) - lanes) * EVERY, lanes)
    return words.astype(">u4").tobytes()[: int(start[-1]) // 8], at[marks].astype("<u8")


def unpack(payload: bytes, checkpoints: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The ids of a block's documents, one after the other (uint32)."""
    lanes = (sizes + EVERY - 1) // EVERY
    doc, first = np.repeat(np.arange(len(sizes)), lanes), np.cumsum(sizes) - sizes
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    out_at, left = first[doc] + nth * EVERY, np.minimum(EVERY, sizes[doc] - nth * EVERY)
    order = np.argsort(-left, kind="stable")
    pos, out_at, left = checkpoints.astype(np.int64)[order], out_at[order], left[order]
    raw = np.frombuffer(payload + bytes(4), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from every byte
    out, mask = np.zeros(int(sizes.sum()), np.uint32), np.uint32((1 << limit) - 1)
    active = np.searchsorted(-left, -np.arange(EVERY), side="left")  # lanes with more than k ids
    for k in range(EVERY):
        n = active[k]
        if not n:
            break
        p = pos[:n]
        prefix = window[p >> 3] >> (32 - limit - (p & 7)).astype(np.uint32) & mask
        out[out_at[:n] + k] = ids[prefix]
        pos[:n] = p + bits[prefix]
    return out


def added_up(counts: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Counts by id plus ``more``."""
    if len(more) > len(counts):
        more, counts = counts, more.copy()
    counts[: len(more)] += more
    return counts


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Counts by id over all rows, from the rows' ids or, if there are any, from the tasks' tallies; each task sends
    one row for each id it has met."""
    tallied = "counts" in tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            if tallied:
                for tally in batch.column("counts").to_pylist():
                    counts = added_up(counts, np.frombuffer(tally, np.int64))
                continue
            for width in (2, 4):
                ids = batch.column("ids").filter(pc.equal(batch.column("width"), width))
                counts = added_up(counts, np.bincount(np.frombuffer(b"".join(ids.to_pylist()), f"<u{width}")))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["token", "n"])

    read = tokens.select("counts").where(F.col("counts").isNotNull()) if tallied else tokens.select("ids", "width")
    summed = read.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    counts = np.zeros(int(summed["token"].max()) + 1 if len(summed) else 0, np.int64)
    counts[summed["token"].to_numpy(np.int64)] = summed["n"].to_numpy()
    return counts


def write(tokens: DataFrame, path: str) -> None:
    """Write ``tokens`` (id, ids, width as by :func:`encode`) to files under ``path``, in ascending order of id: null
    ids first, rows with one id by their ids' hash. No rows: files without blocks. Rows with a tally are none of them.

    The ids are staged once, since both the counts and the blocks read them.
    """
    spark = tokens.sparkSession
    staged_at = f"{work_dir(spark, 'ids')}/data"
    tallied = "counts" in tokens.columns
    tokens.select("id", "ids", "width", *(["counts"] if tallied else [])).write.option("compression", "zstd").parquet(staged_at)
    staged = spark.read.schema("id long, ids binary, width int" + (", counts binary" if tallied else "")).parquet(staged_at)

    lengths = code_lengths(count_ids(staged))
    if tallied:
        staged = staged.where(F.col("counts").isNull()).drop("counts")
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "token long, length int").coalesce(1).write.parquet(f"{path}/lengths")
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = shared.value
        part, state = TaskContext.get().partitionId(), {"block": 0, "before": 0}

        def block(names: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            payload, checkpoints = pack(ids, lengths, codes)
            sizes = [len(x) for x in ids]
            row = [[part], [state["block"]], [state["before"]], [names], [sizes], [checkpoints.tobytes()], [payload]]
            state["block"] += 1
            state["before"] += sum(sizes)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "block", "ids_before", "doc_ids", "n_ids", "checkpoints", "payload"])

        names, ids, n = [], [], 0
        for batch in batches:
            for name, x in zip(batch.column("id").to_pylist(), widened(batch.column("ids"), batch.column("width"))):
                names.append(name)
                ids.append(x)
                n += len(x)
                if n >= BLOCK_IDS:
                    yield block(names, ids)
                    names, ids, n = [], [], 0
        if names:
            yield block(names, ids)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("ids")]
    ordered = staged.repartitionByRange(parts, F.col("id")).sortWithinPartitions(*order)
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids) of the documents in the files: ``start`` is the number of ids before theirs in the order of
    the files, ``ids`` are unsigned 32-bit integers. The totals of the parts, one number each, pass through the driver."""
    lengths = spark.read.schema("token long, length int").parquet(f"{path}/lengths").toPandas()  # at most the vocabulary
    code = np.zeros(int(lengths["token"].max()) + 1 if len(lengths) else 0, np.int64)
    code[lengths["token"].to_numpy(np.int64)] = lengths["length"].to_numpy()
    shared = spark.sparkContext.broadcast(table(code))
    files = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = files.groupBy("part").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n")).collect()
    before, base = 0, {}
    for part, n in sorted(map(tuple, sums)):
        base[part], before = before, before + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(name)[row] for name in batch.schema.names}
                sizes = np.asarray(cell["n_ids"].values, dtype=np.int64)
                flat = unpack(cell["payload"].as_py(), np.frombuffer(cell["checkpoints"].as_py(), "<u8"), sizes, ids, bits)
                ends = np.cumsum(sizes)
                starts = cell["start"].as_py() + ends - sizes
                texts = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int64).tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([cell["doc_ids"].values, pa.array(starts), texts.cast(pa.binary())], ["id", "start", "ids"])

    start = (by_part(base) if base else F.lit(0).cast("long")) + F.col("ids_before")
    return files.withColumn("start", start).drop("part", "block", "ids_before").mapInArrow(decode, "id long, start long, ids binary")
