"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size s is wanted t / s times: some whole copies and a fraction. The
fractions of a source are rounded against each other: two documents meet, and a random transfer of words between
them, fair on average, makes one of the two fractions 0 or 1 while the words both stand for stay the same. The
other one goes on. So every document keeps its expected number of copies, and a source ends with the words wanted
but for the rounding of one last document.

Pairs meet in a reduction tree: a hash of the row deals the documents of a source to leaves of about FAN rows, each
leaf leaves one residual, FAN residuals meet in the next node, and so on up to one root per source. A source with a
third of all documents so takes part in as many tasks as any; each level is staged. All draws are hashes of the
rows that meet, so reruns agree. Equal rows would only pass words among themselves until all but one are integral, so
they are one item from the start, counted in each task before the shuffle: n rows that want x more each are sure of
the whole copies in n * x, and the rest is the item's fraction.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import n_words, positions, stage

FAN = 64
#: What an item carries: its rows' id, text and size, how many they are, and the copies that they are sure of together.
ITEM = ("id", "row", "size", "n", "sure")
#: Equal rows that one task writes out at a time.
RUN = 4096


def cyclic_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """(source, weight): the sources in code point order, null last, weigh ``weights`` in turn."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    at = (F.col("position") % len(weights) + 1).cast("int")
    return positions(sources, "source").select(F.col("key").alias("source"), F.element_at(cycle, at).alias("weight"))


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: ``share`` of all sizes, dealt out by weight; a
    target above ``most`` times its source's size stops there and the excess is dealt out again by weight, until
    none is above. One row of sums per round reaches the driver. Weights must be positive; where all targets stop,
    the rest is not dealt out. An empty source or a corpus without words: 0."""
    cap = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, stopped = 0.0, -1
    while True:  # words per weight; a source stops where its weight asks for its cap or more
        stops = cap <= F.col("weight") * rate
        n, held, free = sources.agg(F.count_if(stops), F.sum(F.when(stops, cap)), F.sum(F.when(~stops, F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, rate = n, (share * total - (held or 0.0)) / free
    return sources.withColumn("target", F.least(cap, F.col("weight") * rate) if free else cap)


def draw(*what: Column) -> Column:
    """A number in [0, 1) that depends on ``what`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) * F.lit(2.0 ** -53)


def meeting(seed: int, level: int) -> Callable[[Column, Column], Column]:
    """How two items (ITEM, x) meet: the state after it, whose ``done`` collects those
    that became integral."""
    def meet(held: Column, new: Column) -> Column:
        f = lambda c, k: c.getField(k)
        up1, down1 = f(held, "size") * (1 - f(held, "x")), f(held, "size") * f(held, "x")
        up2, down2 = f(new, "size") * (1 - f(new, "x")), f(new, "size") * f(new, "x")
        to_held, to_new = F.least(up1, down2), F.least(down1, up2)  # words that may move either way
        u = draw(F.lit(seed), F.lit(level), f(held, "id"), f(held, "row"), f(new, "id"), f(new, "row"))
        first = u * (to_held + to_new) < to_new  # move to_held words to the one held, with the chance that keeps both fair
        held_done = F.when(first, up1 <= down2).otherwise(down1 <= up2)
        x = (F.when(first & held_done, f(new, "x") - up1 / f(new, "size"))
             .when(first, f(held, "x") + down2 / f(held, "size"))
             .when(held_done, f(new, "x") + down1 / f(new, "size"))
             .otherwise(f(held, "x") - up2 / f(held, "size")))
        pick = lambda a, b, k: F.when(held_done, f(a, k)).otherwise(f(b, k)).alias(k)
        done = F.struct(*[pick(held, new, k) for k in ITEM], (first == held_done).cast("long").alias("extra"))
        return F.struct(F.concat(f(held, "done"), F.array(done)).alias("done"), *[pick(new, held, k) for k in ITEM], F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).alias("x"))

    return meet


def round_fractions(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """(keys, ITEM, extra) for every row of ``rows`` (keys, ITEM, x), no two of which are equal: x rounded to extra, 0 or 1."""
    most = rows.groupBy(keys).count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log(max(1, most / FAN), FAN) - 1e-9))
    leaf = F.pmod(F.xxhash64(F.lit(seed), "id", "row", "size"), F.lit(FAN ** depth))
    todo, out = rows.withColumn("node", leaf), []
    nothing = F.array().cast(f"array<struct<{','.join(f'{k}:long' for k in ITEM)},extra:long>>")
    for level in range(depth + 1):
        item = F.struct(draw(F.lit(seed + 1), F.lit(level), "id", "row").alias("order"), *ITEM, "x")
        node = todo.groupBy(*keys, "node").agg(F.sort_array(F.collect_list(item)).alias("items"))  # about FAN, see above
        one = F.element_at("items", 1)
        start = F.struct(nothing.alias("done"), *[one[k].alias(k) for k in (*ITEM, "x")])
        folded = F.aggregate(F.slice("items", F.lit(2), F.size("items")), start, meeting(seed, level))
        node = stage(node.select(*keys, "node", folded.alias("r")), "mixing")
        out.append(node.select(*keys, F.inline("r.done")))
        todo = node.select(*keys, F.expr(f"node div {FAN}").alias("node"), *[f"r.{k}" for k in (*ITEM, "x")])
    last = (draw(F.lit(seed + 2), "id", "row") < F.col("x")).cast("long")
    out.append(todo.select(*keys, *ITEM, last.alias("extra")))
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, id, row, size, x) as items (keys, ITEM, x): equal rows are one."""
    n = rows.groupBy(*keys, "id", "row", "size", "x").agg(F.count("*").alias("n"))
    sure = F.floor(F.col("n") * F.col("x"))
    return n.select(*keys, "id", "row", "size", "n", sure.alias("sure"), (F.col("n") * F.col("x") - sure).alias("x"))


def written_out(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, row, size, extra): a row for each of an item's n rows, ``sure + extra`` of them with 1. Many equal rows
    are dealt out in runs, so that no task writes them all."""
    more = F.col("sure") + F.col("extra")
    out = items.filter("n = 1").select(*keys, "id", "row", "size", more.alias("extra"))
    runs = items.filter("n > 1").select(*keys, "id", "row", "size", "n", more.alias("_more"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("_run"))
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(parts, "id", "row", "_run").withColumn("_lo", F.col("_run") * RUN)
    places = F.sequence(F.col("_lo"), F.least(F.col("_lo") + RUN, F.col("n")) - 1)
    return out.unionByName(runs.select(*keys, "id", "row", "size", "_more", F.explode(places).alias("_at")).select(
        *keys, "id", "row", "size", (F.col("_at") < F.col("_more")).cast("long").alias("extra")))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", broadcast_sources: int = 100_000) -> DataFrame:
    """(id, row, source, size, source_size, target, copies), one row per input row.

    ``size`` is the number of words of the text (null: 0), ``row`` a hash of it. A document is taken at most
    ``ceil(most)`` times. Texts without words take part in no rounding and count as taken floor(target / size of the
    source) times. A null source is a source; null and repeated ids are documents like others; rows that agree in id,
    text and source are taken as often as each other or once more. An id must be a whole number. Empty table: no rows. Other columns are not read.
    """
    sizes = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("row"),
                              n_words(F.col(text_col)).alias("size")), "sizes")
    summed = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    weighed = cyclic_weights(summed, weights)
    per = stage(targets(summed.join(weighed, summed["source"].eqNullSafe(weighed["source"])).select(summed["*"], "weight"), share, most), "targets")
    few = per.limit(broadcast_sources + 1).count() <= broadcast_sources
    met = sizes.join(F.broadcast(per) if few else per, sizes["source"].eqNullSafe(per["source"]))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = met.select("id", "row", sizes["source"], "size", "source_size", "target", F.floor(wanted).alias("whole"), (wanted - F.floor(wanted)).alias("x"))
    keys = ["source", "source_size", "target", "whole"]
    plain = "x = 0 OR size = 0"
    items = stage(counted(rows.filter(f"NOT ({plain})"), keys), "mixing-items")
    none = items.filter("x = 0").select(*keys, *ITEM, F.lit(0).cast("long").alias("extra"))
    rounded = round_fractions(items.filter("x > 0"), keys, seed).unionByName(none)
    every = written_out(rounded, keys).unionByName(rows.filter(plain).select(*keys, "id", "row", "size", F.lit(0).cast("long").alias("extra")))
    return every.select("id", "row", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def first_rows(rows: DataFrame, group: list[str], order: list[str], n: Column) -> DataFrame:
    """``rows``, staged, with ``_first``: whether the row is one of the first ``n`` of its group in the order of a hash of
    the columns ``order``. Ranges of groups and hashes are sorted side by side, equal rows cut anywhere."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(rows, "copies-rows")  # a retried task must find each row under the number it had
    dealt = rows.withColumn("_hash", F.xxhash64(*order)).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *group, "_hash", "_tie")
    at = F.monotonically_increasing_id()  # the partition above 33 bits for the row in it
    dealt = stage(dealt.sortWithinPartitions(*group, "_hash").withColumn("_at", at), "copies-order").withColumn("_part", F.shiftright("_at", 33))
    held = dealt.groupBy(*group, "_part").agg(F.min("_at").alias("_start"), F.count("*").alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*[F.col(c).alias(f"_of{c}") for c in group], F.col("_part").alias("_in"), (before - F.col("_start")).alias("_shift"))
    meets = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in group], F.col("_part") == F.col("_in"))
    return dealt.join(held, meets).withColumn("_first", F.col("_at") + F.col("_shift") < n)


def mixed_documents(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    broadcast_rows: int = 500_000, **how) -> DataFrame:
    """``docs``, each row as often as the mix takes it, all columns kept. The numbers of copies (not the texts) are
    broadcast while there are at most ``broadcast_rows``, else joined by shuffle. Rows that agree in id, text and
    source are taken as often as each other or once more; which ones once more depends on their columns' values."""
    taken = mix(docs, weights, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    least = F.min("copies")
    taken = stage(taken.groupBy("id", F.xxhash64("row", "source").alias("row")).agg(least.alias("_copies"), (F.sum("copies") - F.count("*") * least).alias("_more")), "copies")
    few = taken.limit(broadcast_rows + 1).count() <= broadcast_rows
    taken = taken.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "_copies", "_more")
    meets = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.xxhash64(text_col), source_col) == F.col("_row"))
    met = docs.join(F.broadcast(taken) if few else taken, meets)
    again = lambda df: df.filter("_copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)
    alike = again(met.filter("_more = 0"))
    if taken.filter("_more > 0").isEmpty():
        return alike
    hashed = [f.name for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]  # what a hash can read
    rest = first_rows(met.filter("_more > 0"), ["_id", "_row"], hashed, F.col("_more"))
    return alike.unionByName(again(rest.withColumn("_copies", F.col("_copies") + F.col("_first").cast("long"))))
