"""Chat formatting: conversations as training texts in windows of a token budget, with a loss mask.

The template marks turns as ``<|im_start|>role``, a line end, the text and ``<|im_end|>``. Inside roles and texts
every ``<``, backslashes, ``|`` gets one backslash more, so no control string of theirs survives, and taking it away
gives the text back exactly. Line ends and backslashes of a role are escaped too, as a line end closes it.

Windows are spans of whole turns. Over the prefix sums of the turns' tokens a span ends with the last turn that
still fits; every window after the one with the conversation's first system turn repeats that turn and the last few
turns before its span, as far as they fit. The loss mask covers the text of every assistant turn in the window that
brings it first; where it is repeated it is context.

Turns are dealt out by conversation and block of BLOCK turns in order, whatever their numbers, so a conversation with
a third of all turns is cut over many tasks; no window crosses a block, and a block gets the system turn and the last
turns before it as context. Only conversations of more than a block are numbered for that, by ranges of their order.
Each task reads its blocks in order and holds one of them at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import stage, without

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 1024
PIECE = re.compile(r"\w+|[^\w\s]")
WINDOWS = "conv_id long, block long, window int, n_context int, n_tokens long, over_budget boolean, text string, loss array<struct<begin:int,end:int>>"


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def n_tokens(text: str) -> int:
    """Words and single other visible characters: an estimate that needs no vocabulary."""
    return sum(1 for _ in PIECE.finditer(text))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with ``position``, from 0 in the order of each conversation, staged. Ranges
    of the order are sorted side by side, equal turns cut anywhere; bounds hold beginnings of texts only."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begin = 256  # equal beginnings of this length stay in one range, as the texts behind them may differ
    tie = F.when(F.char_length("text") < begin, F.col("_row"))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, begin), tie)
    at = F.monotonically_increasing_id()  # the partition above 33 bits for the row in it
    dealt = stage(dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text", at.alias("_at")), "chat-order")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    held = dealt.groupBy("conv_id", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # few rows: one per conversation and range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_in"), (before - F.col("_first")).alias("_shift"))
    met = dealt.join(held, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_in")))
    return met.select("conv_id", "turn", "role", "text", (F.col("_at") + F.col("_shift")).alias("position"))


def formatted(turns: list[tuple[str, str]], n_context: int) -> tuple[str, list[dict]]:
    """(text, loss spans in code points) of (role, text) turns, the first ``n_context`` of them repeated."""
    parts, at, loss = [], 0, []
    for i, (role, text) in enumerate(turns):
        head, body = f"{START}{escaped_role(role)}\n", escaped(text)
        if role == "assistant" and i >= n_context:
            loss.append({"begin": at + len(head), "end": at + len(head) + len(body)})
        parts += head, body, END, "\n"
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in text.split(START)[1:]:
        role, body = part.split("\n", 1)
        turns.append((unescaped_role(role), unescaped(body[: body.index(END)])))
    return turns


def spans(costs: list[int], system: int | None, system_cost: int, n_before: int, budget: int, history_turns: int) -> Iterator[tuple[int, int, int, bool]]:
    """(first context turn, first new turn, end, whether the system turn is put in front) of each window.

    ``costs`` are the tokens of the turns, of which the first ``n_before`` come from earlier blocks and are context
    only; ``system`` is the position of the system turn, -1 if it lies before them, None if there is none.
    """
    prefix = np.concatenate(([0], np.cumsum(costs)))
    at, n = n_before, len(costs)
    while at < n:
        front = system is not None and system < at
        room = budget - system_cost * front
        back = max(0, at - history_turns)
        if front:
            back = max(back, system + 1)
        while back < at and prefix[at + 1] - prefix[back] > room:  # the next turn comes first, then what is nearest
            back += 1
        end = max(at + 1, int(np.searchsorted(prefix, prefix[back] + room, side="right")) - 1)
        yield back, at, end, front
        at = end


def windows(conversations: DataFrame, budget: int = 1024, history_turns: int = 2, block: int = BLOCK, tokens: Callable[[str], int] = n_tokens,
            per_turn: int = 4) -> DataFrame:
    """The windows of ``conversations`` (conv_id, turn, role, text; other columns are not read).

    A turn costs its text's tokens and ``per_turn`` for its marks. A window holds at most ``budget`` tokens, but a
    single turn that is longer, or is so with the system turn, gets a window to itself (``over_budget``); no text is
    ever cut or left out. Null texts and roles are empty. Turns of one number stand in order of role and text,
    repeated rows as often as they come, null turns first; a null conv_id is a conversation. ``n_context`` turns at
    the start of a window repeat earlier ones, of however many blocks. Empty table: no rows.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    long = stage(rows.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > block), "chat-long")
    conv = {"conv_id": F.col("conv_id")}
    own = without(rows, long, conv).withColumn("block", F.lit(0).cast("long"))
    cut = numbered(without(rows, long, conv, how="left_semi"))
    last = long.select(F.col("conv_id").alias("_conv"), F.expr(f"(n - 1) div {block}").alias("last"))
    of = lambda shift: F.expr(f"(position + {shift}) div {block}")
    # What a block needs from earlier ones: the last turns before it, and the first system turn if it lies before those.
    near = cut.filter(of(history_turns) > of(0)).join(last, F.col("conv_id").eqNullSafe(F.col("_conv")))
    near = near.withColumn("until", F.least(of(history_turns), "last")).filter(F.col("until") > of(0))
    tail = near.withColumn("block", F.explode(F.sequence(of(0) + 1, F.col("until")))).select("conv_id", "block", F.lit(1).alias("kind"), "turn", "role", "text")
    system = cut.filter("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("position", "turn", "role", "text")).alias("first")).select("conv_id", "first.*")
    system = system.join(last, F.col("conv_id").eqNullSafe(F.col("_conv"))).filter(F.col("last") > of(history_turns))
    system = system.withColumn("block", F.explode(F.sequence(of(history_turns) + 1, F.col("last")))).select("conv_id", "block", F.lit(0).alias("kind"), "turn", "role", "text")
    own = own.unionByName(cut.select("conv_id", "turn", "role", "text", of(0).alias("block")))
    dealt = system.unionByName(tail).unionByName(own.select("conv_id", "block", F.lit(2).alias("kind"), "turn", "role", "text"))
    dealt = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "turn", "role", "text")
    kinds = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("n_context", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()),
                       ("text", pa.string()), ("loss", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        stream = (r for b in batches for r in b.to_pylist())
        for (conv, number), group in groupby(stream, key=lambda r: (r["conv_id"], r["block"])):
            group = list(group)
            turns = [(r["role"], r["text"]) for r in group if r["kind"]]
            n_before = sum(r["kind"] == 1 for r in group)
            if group[0]["kind"] == 0:
                position, first = -1, (group[0]["role"], group[0]["text"])
            else:
                position = next((i for i, (role, _) in enumerate(turns) if role == "system"), None)
                first = None if position is None else turns[position]
            cost = lambda t: tokens(t[1]) + per_turn
            costs, system_cost = list(map(cost, turns)), cost(first) if first else 0
            for w, (back, at, end, front) in enumerate(spans(costs, position, system_cost, n_before, budget, history_turns)):
                shown = [first] * front + turns[back:end]
                text, loss = formatted(shown, front + at - back)
                total = sum(costs[back:end]) + system_cost * front
                out.append({"conv_id": conv, "block": number, "window": w, "n_context": front + at - back, "n_tokens": total, "over_budget": total > budget, "text": text, "loss": loss})
                size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, kinds)

    return dealt.select(F.col("conv_id").cast("long").alias("conv_id"), "block", "kind", "role", "text").mapInArrow(run, WINDOWS)


def read_back(formatted_windows: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted texts and masks alone: the number and digest of its turns, the
    length and digest of the text under the mask, and the code points of all its windows. A digest over a whole
    conversation is worked out in order, in one task that holds one window at a time."""
    rows = formatted_windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        out = []
        stream = (r for b in batches for r in b.to_pylist())
        for conv, group in groupby(stream, key=lambda r: r["conv_id"]):
            turns, loss, n, loss_chars, chars, n_windows = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for w in group:
                for role, text in parsed(w["text"])[w["n_context"]:]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in w["loss"]:
                    text = unescaped(w["text"][span["begin"]:span["end"]])
                    loss.update(text.encode())
                    loss_chars += len(text)
                chars += len(w["text"])
                n_windows += 1
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return rows.select("conv_id", "n_context", "text", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
