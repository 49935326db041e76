"""BPE encoding by backtracking, and decoding through an offset table.

A vocabulary file (the ``tokenizers`` JSON format) is read on the driver and broadcast; its size is that of the
vocabulary, not of the data. From it every worker process builds once:

- an Aho-Corasick automaton over all tokens. One pass over a word gives the longest token at every position;
- for every token its longest proper prefix that is a token too;
- a pair-compatibility table, filled as pairs are met: two tokens may stand side by side exactly if merging the
  symbols of both would give these two tokens and no merge across their border.

A word is encoded left to right: take the longest token; if it is incompatible with the one before, or ends where
no encoding goes on, take its next shorter prefix; if none is left, mark the position as a dead end and step back.
Each position dies at most once and is tried with at most as many tokens as end there, so the time is linear in the
word's length, however long, and the result is that of applying the merges in order of rank.

Decoding looks ids up in one string array, that is in a block of bytes with offsets.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The patterns of the two public vocabularies, and what Unicode counts as white space.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xa0  -     　"

#: Chunks of text whose ids are remembered, for each worker process.
REMEMBERED = 1 << 18
#: Text that one output batch holds, about.
BATCH_BYTES = 4 << 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Merges:
    """Encodes words, given as strings with one character for each symbol, by backtracking."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]]):
        self.ids, self.length = tokens, {i: len(t) for t, i in tokens.items()}
        self.halves, self.rank, self.joint = {}, dict.fromkeys(tokens.values(), -1), {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = tokens[a], tokens[b], tokens[a + b]
            self.halves[whole], self.rank[whole], self.joint[left, right] = (left, right), rank, rank
        self.automaton = ahocorasick.Automaton()
        for t, i in tokens.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = {i: next((tokens[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in tokens), None) for t, i in tokens.items()}
        self.compatible: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging keeps a and b apart. Undo the merges on either side of their border, latest first; a
        merge across it that would have come earlier than the one undone last joins them. Of equal ranks the one
        further left comes first."""
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        left, right, before = a, b, len(self.rank) + 1
        while True:
            across = self.joint.get((left, right))
            if across is not None and across < before:
                fit = False
                break
            x, y = self.rank[left], self.rank[right]
            if x == y == -1:
                fit = True
                break
            if x > y:
                left, before = self.halves[left][1], x
            else:
                right, before = self.halves[right][0], y + 1
        if len(self.compatible) >= REMEMBERED:
            forget_half(self.compatible)
        self.compatible[a, b] = fit
        return fit

    def encode(self, word: str) -> list[int]:
        if (whole := self.ids.get(word)) is not None:  # the longest token, with none before it
            return [whole]
        length, shorter, compatible, fits = self.length, self.shorter, self.compatible, self.fits
        n, longest = len(word), {}
        for end, token in self.automaton.iter(word):
            longest[end + 1 - length[token]] = token  # a later end is a longer token
        out: list[int] = []
        dead: set[int] = set()
        at, token, last = 0, longest[0], None
        while at < n:
            while token is not None:
                end = at + length[token]
                if end not in dead:
                    if last is None:
                        break
                    fit = compatible.get((last, token))
                    if fit or fit is None and fits(last, token):
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at, last, token = end, token, longest.get(end)
            else:
                dead.add(at)
                token = out.pop()
                at, last = at - length[token], out[-1] if out else None
        return out


def forget_half(remembered: dict) -> None:
    """Drop the entries that came first."""
    for key in list(islice(remembered, len(remembered) // 2)):
        del remembered[key]


class Codec(dict):
    """Ids of a chunk of text as int32 bytes. Chunks are remembered; the text between two white spaces never shares
    a token with its neighbours, so a text's ids are those of its chunks in a row."""

    def __init__(self, spec: str):
        super().__init__()
        spec = json.loads(spec)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words = bool(self.suffix)  # the word vocabulary: lower case, white space dropped
        ids = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges({self.symbols(t): i for t, i in ids.items()}, [tuple(map(self.symbols, m)) for m in merges])
        self.special = {t["content"]: np.int32(t["id"]).tobytes() for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.byte = byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p) if self.words else GPT_PATTERN
        self.piece = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.chunk = re.compile(f"[^{WHITE}]+" if self.words else f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

    def symbols(self, token: str) -> str:
        """A token with one character for each symbol: a symbol that ends a word is moved up by 0x10000."""
        if self.suffix and token.endswith(self.suffix):
            token = token.removesuffix(self.suffix)
            return token[:-1] + chr(0x10000 + ord(token[-1]))
        return token

    def __missing__(self, chunk: str) -> bytes:
        text = chunk
        if self.words:
            text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # no final sigma
        if self.words and text.isalpha():  # most chunks are letters, perhaps with one mark: no need to match
            return self.word(text) if text == chunk else self.keep(chunk, self.word(text))
        if self.words and text[-1] in ".,;:!?" and text[:-1].isalpha():
            found = self.word(text[:-1]) + self.word(text[-1])
        else:
            found = b"".join(map(self.word, self.piece.findall(text)))
        return self.keep(chunk, found)

    def keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= 64:
            if len(self) >= REMEMBERED:
                forget_half(self)
            self[text] = ids
        return ids

    def word(self, piece: str) -> bytes:
        """Ids of one piece, none of whose tokens reaches beyond it."""
        if self.words and (found := self.get(piece)):  # such a piece is a chunk too
            return found
        if piece.isascii() and piece.isprintable():  # these bytes stand for themselves, but for the space
            word = piece.replace(" ", self.byte[32])
        else:
            word = "".join(map(self.byte.__getitem__, piece.encode("utf-8", "surrogatepass")))
        if self.suffix:
            word = word[:-1] + chr(0x10000 + ord(word[-1]))
        found = array("i", self.merges.encode(word)).tobytes()
        return self.keep(piece, found) if self.words else found

    def encode(self, text: str) -> bytes:
        if "<" in text and self.special and self.cut.search(text):
            return b"".join(self.special.get(part) or self.encode_plain(part) for part in self.cut.split(text))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.chunk.findall(text)))


class Decoder:
    """The offset table: every token's text (or bytes) in one Arrow array, by id."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        self.words = bool(spec["model"].get("end_of_word_suffix"))
        names = {t["id"]: t["content"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in spec["model"]["vocab"].items()} | names
        table = [by_id.get(i, "") for i in range(max(by_id, default=-1) + 1)]
        if self.words:
            self.table = pa.array(table, pa.string())
        else:
            back = {c: b for b, c in enumerate(byte_symbols())}
            self.table = pa.array([t.encode() if i in names else bytes(back[c] for c in t) for i, t in enumerate(table)], pa.binary())

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of a list array of ids: the word vocabulary's tokens with a space between, the byte vocabulary's
        bytes read as UTF-8 (what is no UTF-8 as U+FFFD)."""
        ids = ids.cast(pa.list_(pa.int32()))
        parts = pa.ListArray.from_arrays(ids.offsets, self.table.take(ids.values))
        if self.words:
            return pc.binary_join(parts, " ")
        return pa.array([b.decode("utf-8", "replace") for b in pc.binary_join(parts, b"").to_pylist()], pa.string())


def kept(shared, kind: type):
    """The ``kind`` made of a broadcast ``{"spec": JSON}``; the broadcast keeps it for the life of the worker process."""
    if kind.__name__ not in shared.value:
        shared.value[kind.__name__] = kind(shared.value["spec"])
    return shared.value[kind.__name__]


def share(df: DataFrame, vocabulary: str):
    """Broadcast the vocabulary file at ``vocabulary`` (a path on the driver)."""
    with open(vocabulary, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast({"spec": f.read()})


def slices(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of BATCH_BYTES, or of one larger row, given each row's bytes (null: none)."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + BATCH_BYTES, side="right")))
        yield lo, hi
        lo = hi


def added(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column ``out`` of token ids (array<int>), as the vocabulary's own library gives them without
    added special tokens; special tokens' strings inside a text are those tokens. Null and empty texts: no ids. With
    ``decoded``, a column of that name holds what :func:`decode` makes of the ids, in the same pass over the data.
    Input columns named like these are replaced; all others stay. Empty table: no rows."""
    shared = share(docs, vocabulary)
    schema = T.StructType([f for f in docs.schema.fields if f.name not in (out, decoded) or f.name == text_col])
    rest = schema.fieldNames()
    schema = added(schema, out, T.ArrayType(T.IntegerType()))
    schema = added(schema, decoded, T.StringType()) if decoded else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, decoder = kept(shared, Codec), kept(shared, Decoder) if decoded else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi in slices(pc.binary_length(texts)):
                found = [codec.encode(t or "") for t in texts[lo:hi].to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                offsets[1:] = np.cumsum([len(x) // 4 for x in found])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                made = [ids, decoder.decode(ids)] if decoder else [ids]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *made], schema.fieldNames())

    return docs.select(rest).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with a column ``out``: the text of each row's ids, special tokens included. Null: empty. An id that
    the vocabulary doesn't have is an error. An input column named like ``out`` is replaced."""
    shared, tokens = share(tokens, vocabulary), tokens.drop(out) if out != ids_col else tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = kept(shared, Decoder)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            for lo, hi in slices(pc.multiply(pc.list_value_length(ids), 4)):
                part = ids.take(pa.array(range(lo, hi), pa.int32()))  # offsets from 0
                part = pc.coalesce(part, pa.scalar([], part.type)) if part.null_count else part
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, decoder.decode(part)], [*batch.schema.names, out])

    return tokens.mapInArrow(run, added(tokens.schema, out, T.StringType()))
