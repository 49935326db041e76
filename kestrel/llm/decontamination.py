"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, met by every window of the corpus.

1. *Test n-grams.* Every benchmark item is cut into windows of ``width`` consecutive words (an item of fewer words is
   one window of all of them); equal windows are one entry that names all its items.
2. *Hash set.* The entries' words are numbered, and each window is hashed as a polynomial of its word numbers. The set
   holds one 64-bit hash for each window; the factor is chosen so that no two windows of the set share one. It is
   broadcast: at most ``most_bytes`` of windows and item names at a time, counted before anything is collected. A
   larger benchmark is met in as many blocks, one pass over the corpus each, with what was found carried along.
3. *Scan.* A document's words become numbers (0: a word that no test window has), and the hashes of all its windows are
   computed side by side. A window whose hash is in the set is verified word by word, so no hit is guessed.
4. *Removal.* Hit windows are merged into spans of words. ``decontaminated`` cuts the spans out of the texts, or leaves
   out the documents.

Words: A-Z in lower case, then maximal runs of a-z, 0-9 and every character beyond ASCII. The corpus is not shuffled.

Defined results: a null or empty text has no words and is clean; a null or empty item has no windows; items with a null
id still hit, under the name "" (empty); items that repeat an id are one item with the windows of all; documents that
repeat are judged one by one; an empty benchmark hits nothing; an empty corpus gives no rows. Very long texts are cut
into words a stretch at a time and held as one number a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.bpe import kept, slices
from kestrel.llm.common import lower_ascii, stage

#: Between words, of texts in lower case; Java reads it, and Python for bytes of UTF-8.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes: A-Z to a-z; what separates words to a space; all else as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text that are cut into words at a time.
STRETCH = 1 << 22

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),  # first word, word after the last; again and again
    T.StructField("items", T.ArrayType(T.StringType())),
])
ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def test_windows(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(window, item): the distinct windows of each item, words joined by a space."""
    words = F.filter(F.split(lower_ascii(F.col(text_col)), BETWEEN), lambda w: w != "")
    cut = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words.alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(width)), " "))
    return cut.select("item", F.explode(windows).alias("window")).distinct()


class HashSet:
    """The set of test windows: ``words`` gives a word's number, ``of_length`` by number of words the sorted hashes,
    a bitmap of their leading bits, the windows' word numbers, and where each window's items lie in ``items``."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.names = sorted({item for _, item in pairs})
        number = {name: i for i, name in enumerate(self.names)}
        by_window: dict[str, list[int]] = {}
        for window, item in pairs:
            by_window.setdefault(window, []).append(number[item])
        self.words: dict[bytes, int] = {}
        cut: dict[int, list[tuple[list[int], list[int]]]] = {}
        for window, items in by_window.items():
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in window.encode("utf-8", "surrogatepass").split(b" ")]
            cut.setdefault(len(ids), []).append((ids, items))
        self.of_length = {length: self.table(length, rows) for length, rows in sorted(cut.items())}

    @staticmethod
    def table(length: int, rows: list[tuple[list[int], list[int]]]):
        windows = np.array([ids for ids, _ in rows], np.int32)
        factor = 0x9E3779B97F4A7C15
        while True:  # until no two windows share a hash
            factors = np.array([pow(factor, k + 1, 1 << 64) for k in range(length)], np.uint64)
            hashes = HashSet.hashes(windows.ravel(), factors)[::length]
            order = np.argsort(hashes, kind="stable")
            if (hashes[order][1:] != hashes[order][:-1]).all():
                break
            factor = (factor * 0xD1342543DE82EF95 + 1) % (1 << 64) | 1
        shift = np.uint64(64 - max(10, min(24, (len(rows) * 32).bit_length())))
        bitmap = np.zeros(1 << int(64 - shift), bool)
        bitmap[hashes >> shift] = True
        ends = np.cumsum([0, *(len(rows[i][1]) for i in order)])
        items = np.array([x for i in order for x in rows[i][1]], np.int64)
        return factors, hashes[order], shift, bitmap, windows[order], ends, items

    @staticmethod
    def hashes(ids: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """The hash of each window of len(factors) consecutive ids."""
        n = len(ids) - len(factors) + 1
        wide, out = ids.astype(np.uint64), np.zeros(max(n, 0), np.uint64)
        for k, f in enumerate(factors):
            out += wide[k:k + n] * f
        return out ^ out >> np.uint64(32)

    def numbers(self, raw: bytes) -> np.ndarray:
        """The number of each word of a text."""
        folded, get, parts, at = raw.translate(FOLD), self.words.get, [], 0
        while at < len(folded):
            end = len(folded) if len(folded) - at <= STRETCH else folded.find(b" ", at + STRETCH)
            end = len(folded) if end < 0 else end
            found = folded[at:end].split()
            parts.append(np.fromiter((get(w, 0) for w in found), np.int32, len(found)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, windows): where windows of the set occur, and which, verified word by word."""
        for length, (factors, hashes, shift, bitmap, windows, _, _) in self.of_length.items():
            if len(ids) < length:
                continue
            made = self.hashes(ids, factors)
            starts = np.flatnonzero(bitmap[made >> shift])
            at = np.minimum(np.searchsorted(hashes, made[starts]), len(hashes) - 1)
            same = hashes[at] == made[starts]
            starts, at = starts[same], at[same]
            for k in range(length):
                same = ids[starts + k] == windows[at, k]
                starts, at = starts[same], at[same]
            yield length, starts, at

    def found(self, texts: list[bytes]) -> list[tuple[int, list[int], list[str]]]:
        """(number of words, spans, items) of each text."""
        each = [self.numbers(t) for t in texts]
        begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in each]))).astype(np.int64)
        ids = np.zeros(begins[-1], np.int32)  # a 0 behind each text: no window reaches across
        for x, lo in zip(each, begins):
            ids[lo:lo + len(x)] = x
        out: list[tuple[int, list[int], list[str]]] = [(len(x), [], []) for x in each]
        step, items = np.zeros(len(ids) + 1, np.int32), {}
        for length, starts, at in self.hits(ids):
            if not len(starts):
                continue
            step[starts] += 1
            step[starts + length] -= 1
            _, _, _, _, _, ends, of = self.of_length[length]
            doc = np.searchsorted(begins, starts, side="right") - 1
            cuts = np.flatnonzero(np.diff(doc)) + 1
            for d, mine in zip(doc[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                items.setdefault(d, []).extend(of[ends[w]:ends[w + 1]] for w in np.unique(mine))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(step) > 0)).astype(np.int8)))
        doc = np.searchsorted(begins, edges[::2], side="right") - 1
        for d, lo, hi in zip(doc.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
            out[d][1].extend((lo - int(begins[d]), hi - int(begins[d])))
        for d, parts in items.items():
            out[d][2].extend(self.names[i] for i in np.unique(np.concatenate(parts)))
        return out


def united(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of spans."""
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += (lo, hi)
    return out


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def scanned(docs: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", width: int = 10, most_bytes: int = 1 << 25) -> DataFrame:
    """``docs`` with a struct ``out`` of n_words, spans (pairs of word positions: first, one past the last) and items
    (names of the items with a window in the text, sorted)."""
    pairs = stage(test_windows(benchmark, width, item_col, item_text_col), "test-windows")
    n_bytes = pairs.agg(F.sum(F.octet_length("window") + F.octet_length("item") + 16)).first()[0] or 0
    n_blocks = -(-n_bytes // most_bytes) or 1
    schema = T.StructType([*docs.schema.fields, T.StructField(out, FOUND)])
    names = docs.columns

    for block in range(n_blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast({"spec": [(r.window, r.item) for r in mine.toLocalIterator()]})

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=block == 0) -> Iterator[pa.RecordBatch]:
            test = kept(shared, HashSet)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                for lo, hi in slices(pc.binary_length(texts)):
                    made = test.found([t or b"" for t in texts[lo:hi].cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()])
                    if not first:
                        before = batch.column(batch.schema.get_field_index(out))[lo:hi].to_pylist()
                        made = [(n, united(b["spans"], spans), sorted({*b["items"], *items})) for b, (n, spans, items) in zip(before, made)]
                    made = [{"n_words": n, "spans": spans, "items": items} for n, spans, items in made]
                    mine = batch.slice(lo, hi - lo).select(names)
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(made, ARROW_FOUND)], schema.fieldNames())

        docs = docs.mapInArrow(run, schema)
        if n_blocks > 1:  # else all blocks' sets would be held at once
            docs = stage(docs, "decontamination")
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, n_words, n_hit, spans, items, contaminated) for each row of ``docs``: how many of its words lie inside an
    occurrence of a test window, where (array of first and last, counted in words from 0, last included), and the
    names of the items that the windows belong to, sorted as strings (by code point)."""
    found = scanned(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, "found", **how)
    spans = F.when(F.size("found.spans") > 0, F.transform(F.sequence(F.lit(0), F.size("found.spans") - 2, F.lit(2)), lambda i: F.struct(
        F.get("found.spans", i).alias("first"), (F.get("found.spans", i + 1) - 1).alias("last")))).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("id", F.col("found.n_words").alias("n_words"), spans.alias("spans"), F.col("found.items").alias("items")).select(
        "id", "n_words", n_hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: str, spans: list[int]) -> str:
    """The text without what lies from the first to the last word of each span; all else stays as it is."""
    raw = text.encode("utf-8", "surrogatepass")
    words, out, at, word = re.finditer(rb"[^ ]+", raw.translate(FOLD)), [], 0, -1
    for first, end in zip(spans[::2], spans[1::2]):
        while word < end - 1:
            m, word = next(words), word + 1
            if word == first:
                out.append(raw[at:m.start()])
        at = m.end()
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without what the benchmark's windows hit, all columns kept: ``remove="spans"`` cuts the hit spans out
    of the texts, ``remove="documents"`` leaves out the rows with a hit."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be spans or documents, not {remove!r}")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_spans(t, list(s)) for t, s in zip(texts, spans)], dtype=object)

    mark = free_name(docs, "_contamination")
    found = scanned(docs, benchmark, mark, text_col, **how)
    hit = F.size(F.col(f"{mark}.spans")) > 0
    if remove == "documents":
        return found.filter(~hit).select(*docs.columns)
    clean = F.when(hit, cut(F.when(hit, F.col(text_col)), F.col(f"{mark}.spans"))).otherwise(F.col(text_col))
    return found.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
