"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A shingle's hash is the first 16 hex digits of the MD5 of its words, joined by one space. A sketch keeps every
distinct hash below a fixed fraction of all hashes, here 1/4: those that start with 0 to 3. So what it keeps does not
depend on the other hashes: sketches of parts merge into that of the whole by union, and two sketches of very
unequal documents still hold the same hashes wherever the documents agree, which gives containment.

A text of a few shingles would keep few or none. A text with fewer than FLOOR hashes below the fraction keeps its FLOOR smallest
instead (all of them, if it has no more), and ``below`` says up to where it is complete; two sketches are compared
below the smaller of their two limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import SPACE, next_key, stage

FRACTION = "4"  # hashes below this string: one in 4
FLOOR = 4


def with_sketch(df: DataFrame, text: Column, out: str, width: int = 5) -> DataFrame:
    """``df`` with a column ``out``: struct(below, hashes), the hashes ascending. Words are runs of anything but ASCII
    white space, as they stand. Fewer than ``width`` words are one shingle; null and wordless texts have no hash."""
    taken = {c.lower() for c in df.columns}
    free = lambda name: name if name.lower() not in taken else free(name + "_")
    words, hashes = free(f"_{out}_words"), free(f"_{out}_hashes")
    shingle = lambda ws, i: F.substring(F.md5(F.array_join(F.slice(ws, i, width), " ")), 1, 16)
    n = F.size(words)
    df = df.withColumn(words, F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != ""))
    df = df.withColumn(hashes, F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: shingle(F.col(words), i))))
    low = free(f"_{out}_low")
    df = df.withColumn(low, F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < FRACTION))))
    df = df.withColumn(hashes, F.when(F.size(low) >= FLOOR, F.lit(None)).otherwise(F.array_sort(F.array_distinct(hashes))))
    least = F.slice(hashes, 1, FLOOR)
    below = (F.when(F.size(low) >= FLOOR, F.lit(FRACTION)).when(F.size(hashes) <= FLOOR, F.lit("g"))
             .otherwise(F.concat(F.element_at(least, -1), F.lit("0"))))  # "g" is above every hash, h + "0" just above h
    kept = F.when(F.size(low) >= FLOOR, F.col(low)).otherwise(least)
    return df.withColumn(out, F.struct(below.alias("below"), kept.alias("hashes"))).drop(words, hashes, low)


def comparable(a: Column, b: Column) -> tuple[Column, Column]:
    below = F.least(a["below"], b["below"])
    return F.filter(a["hashes"], lambda h: h < below), F.filter(b["hashes"], lambda h: h < below)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles, 0 to 1; exact for texts of up to FLOOR different shingles.
    Two texts without words: 1."""
    x, y = comparable(a, b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too. An ``a`` without any below the limit is contained if it has no
    words, else unknown (null)."""
    x, y = comparable(a, b)
    return (F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))
            .when(F.size(a["hashes"]) == 0, F.lit(1.0)))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together: the union of what both keep, complete below the smaller limit."""
    x, y = comparable(a, b)
    return F.struct(F.least(a["below"], b["below"]).alias("below"), F.array_sort(F.array_union(x, y)).alias("hashes"))


def packed(sketch: Column) -> Column:
    """The sketch with its hashes as bytes, eight each: a third of their size as an array of strings."""
    return F.struct(sketch["below"].alias("below"), F.unhex(F.array_join(sketch["hashes"], "")).alias("bytes"))


def unpacked(sketch: Column) -> Column:
    return F.struct(sketch["below"].alias("below"), F.regexp_extract_all(F.lower(F.hex(sketch["bytes"])), F.lit(".{16}"), 0).alias("hashes"))


def as_text(sketch: Column) -> Column:
    return F.concat_ws(":", sketch["below"], F.array_join(sketch["hashes"], ","))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next), one row per input row.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by as many first ones of the
    next document, or all it has. Next is the document with the next larger id, for the last one the first; of several
    with that id, the least beginning and the least sketch. A null id stands after all others, so its next
    is the first; if every id is null, next is one of them. Null texts are empty. Empty table: no rows.

    Whole texts are shuffled once, by id, and meet there the sketch of the next text and as much of its beginning as
    they need; both joins read that one shuffle, and sketches grouped by the id they go to are joined where they lie (a
    null id is a number and a mark, as a null-safe equality would deal the same keys out anew). A text's sketch is worked out on either side of the join, which
    costs less than to move it again. The documents' order is worked out on ids alone.
    """
    given = F.col(id_col).cast("long")
    texts = docs.select(F.coalesce(given, F.lit(0)).alias("key"), given.isNull().alias("none"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own_id = F.when(~F.col("none"), F.col("key")).alias("id")
    sizes = stage(texts.groupBy("key", "none").agg(F.max(F.expr("char_length(text) div 4")).cast("int").alias("need")).select(own_id, "need"), "sizes")
    after = next_key(sizes, "id").select(F.col("key").alias("to"), "next")
    first = sizes.agg(F.min("id").alias("next")).select(F.lit(None).cast("long").alias("to"), "next")
    links = after.unionByName(first)
    as_key = lambda c: (F.coalesce(c, F.lit(0)).alias(f"{c}_key"), F.isnull(c).alias(f"{c}_none"))
    links = stage(links.join(sizes, links["to"].eqNullSafe(sizes["id"])).select(*as_key("to"), *as_key("next"), "need"), "links")

    at = (F.col("key") == F.col("next_key")) & (F.col("none") == F.col("next_none"))
    seen = with_sketch(texts.join(links, at), F.col("text"), "sketch", width)
    of_next = seen.groupBy("to_key", "to_none").agg(F.min(F.expr("substring(text, 1, need)")).alias("start"), F.min(packed(F.col("sketch"))).alias("next_sketch"))
    met = texts.join(of_next, (F.col("key") == F.col("to_key")) & (F.col("none") == F.col("to_none")))
    met = met.withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.expr("n_chars div 4").cast("int")
    met = met.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring(F.col("start"), F.lit(1), quarter)))
    made = with_sketch(with_sketch(met, F.col("text"), "sketch", width), F.col("edited"), "edited_sketch", width)
    made = made.withColumn("next_sketch", unpacked(F.col("next_sketch")))
    return made.select(own_id, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch",
                       likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
