"""Validation of a loaded table, reconciliation of source against target, verdicts.

``validate_target`` computes every per-table check in one pass: a grouped aggregate by the key
(combined map-side) is folded into row count, duplicate keys, PK NULL counts and watermark min/max,
and that single result row becomes check rows by exploding an array of structs. The verdict rules
are column expressions, so they run over any number of tables at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.session import staged

# Live-lag tolerance of replicating tables.
TOLERANCE_ROWS = 50
TOLERANCE_RATIO = 0.0001


# Names of the checks of a loaded table, and what a check that isn't passed says.
CHECKS = {
    "exists": "target_table_exists", "rows": "target_row_count", "same_rows": "source_target_row_count", "key": "primary_key_column",
    "key_nulls": "primary_key_null_count", "key_repeats": "primary_key_duplicate_count", "marker": "watermark_column", "marker_end": "target_watermark",
}
SAYS = {
    "same_rows": "Source row count does not match target row count", "key": "Primary key column not found",
    "key_nulls": "Primary key column contains null values", "key_repeats": "Duplicate primary key values found",
    "marker": "Watermark column not found in target table", "min": "Target watermark minimum is null", "max": "Target watermark maximum is null",
}


def _s(c: Column) -> Column:
    return c.cast("string")


def validate_target(target: DataFrame, pk_columns: list[str], watermark: str | None,
                    source_count: int | None = None, table_name: str = "target") -> DataFrame:
    """Check rows (check_name, status, source_value, target_value, message) for a loaded table."""
    cols = set(target.columns)
    present_pk = [c for c in pk_columns if c in cols]
    has_wm = bool(watermark and watermark in cols)
    if present_pk and len(present_pk) == len(pk_columns):
        # one pass: group by the key (combined map-side), then fold the groups into every statistic
        per_key = target.groupBy(*present_pk).agg(
            F.count(F.lit(1)).alias("_n"),
            *([F.min(watermark).alias("_wmin"), F.max(watermark).alias("_wmax")] if has_wm else []))
        aggs = [F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count_if(F.col("_n") > 1).alias("dups")]
        aggs += [F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"nulls_{c}")
                 for c in present_pk]
        if has_wm:
            aggs += [F.min("_wmin").cast("string").alias("wm_min"), F.max("_wmax").cast("string").alias("wm_max")]
        stats = per_key.agg(*aggs)
    else:
        aggs = [F.count(F.lit(1)).alias("n")]
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in present_pk]
        if has_wm:
            aggs += [F.min(watermark).cast("string").alias("wm_min"),
                     F.max(watermark).cast("string").alias("wm_max")]
        stats = target.agg(*aggs)
    rows: list[Column] = []

    def row(name, status, src, tgt, msg):
        rows.append(F.struct(F.lit(name).alias("check_name"), status.alias("status"), _s(src).alias("source_value"),
                             _s(tgt).alias("target_value"), _s(msg).alias("message")))

    none = F.lit(None)
    row(CHECKS["exists"], F.lit("pass"), none, F.lit(table_name), none)
    row(CHECKS["rows"], F.lit("pass"), none, F.col("n"), none)
    if source_count is not None:
        ok = F.col("n") == F.lit(source_count)
        row(CHECKS["same_rows"], F.when(ok, "pass").otherwise("fail"), F.lit(source_count), F.col("n"),
            F.when(ok, None).otherwise(SAYS["same_rows"]))
    for c in pk_columns:
        if c not in cols:
            row(f"{CHECKS['key']}:{c}", F.lit("fail"), none, none, F.lit(SAYS["key"]))
            continue
        ok = F.col(f"nulls_{c}") == 0
        row(f"{CHECKS['key_nulls']}:{c}", F.when(ok, "pass").otherwise("fail"), none, F.col(f"nulls_{c}"),
            F.when(ok, None).otherwise(SAYS["key_nulls"]))
    if "dups" in stats.columns:
        ok = F.col("dups") == 0
        row(CHECKS["key_repeats"], F.when(ok, "pass").otherwise("fail"), none, F.col("dups"),
            F.when(ok, None).otherwise(SAYS["key_repeats"]))
    if watermark:
        if watermark not in cols:
            row(f"{CHECKS['marker']}:{watermark}", F.lit("fail"), none, none, F.lit(SAYS["marker"]))
        else:
            row(f"{CHECKS['marker']}:{watermark}", F.lit("pass"), none, F.lit(watermark), none)
            for which in ("min", "max"):
                v = F.col(f"wm_{which}")
                row(f"{CHECKS['marker_end']}_{which}", F.when(v.isNull(), "warning").otherwise("pass"), none, v,
                    F.when(v.isNull(), SAYS[which]))
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validation_rollup(checks: DataFrame, group: list[str] | None = None) -> DataFrame:
    """fail if no checks or any fail; warning if any warning; else pass (per group)."""
    g = group or []
    agg = checks.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"),
                                 F.bool_or(F.col("status") == "fail").alias("_f"),
                                 F.bool_or(F.col("status") == "warning").alias("_w"))
    return agg.select(*g, F.when((F.col("_n") == 0) | F.col("_f"), "fail").when(F.col("_w"), "warning")
                      .otherwise("pass").alias("validation_status"))


def tolerance(source_count: Column, replicating: Column) -> Column:
    """0 unless replicating; else max(50 rows, int(0.0001 * source))."""
    by_ratio = F.coalesce(F.floor(source_count.cast("double") * TOLERANCE_RATIO).cast("long"), F.lit(0))
    return F.when(replicating, F.greatest(F.lit(TOLERANCE_ROWS).cast("long"), by_ratio)).otherwise(F.lit(0).cast("long"))


def source_verdict(source_count: Column, count_mode: Column, approximate: Column, target_count: Column,
                   tol: Column) -> Column:
    """PENDING without a source count (or exact with no target); MATCH within tolerance; MISMATCH;
    an estimate is ESTIMATE, never MISMATCH."""
    exact = (count_mode == "exact") & ~F.coalesce(approximate, F.lit(False))
    return (F.when(source_count.isNull(), "PENDING")
            .when(exact & target_count.isNull(), "PENDING")
            .when(exact & (F.abs(source_count - target_count) <= F.greatest(tol, F.lit(0))), "MATCH")
            .when(exact, "MISMATCH")
            .otherwise("ESTIMATE"))


def reconcile_status(source_count: Column, target_count: Column) -> Column:
    return (F.when(source_count.isNull() | target_count.isNull(), "PENDING")
            .when(source_count == target_count, "MATCH").otherwise("MISMATCH"))


def reconcile(counts: DataFrame) -> DataFrame:
    """counts(table_name, source_count, target_count) -> + validation_status, missed."""
    return counts.withColumn("validation_status", reconcile_status(F.col("source_count"), F.col("target_count"))) \
        .withColumn("missed", F.col("source_count") - F.col("target_count"))


def verify_counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Exact source vs target count per table in one union of global aggregates."""
    parts = []
    for name, (src, tgt) in pairs.items():
        s = src.select(F.count(F.lit(1))).scalar()
        t = tgt.select(F.count(F.lit(1))).scalar()
        parts.append(src.sparkSession.range(1).select(F.lit(name).alias("table_name"), s.alias("source_count"),
                                                       t.alias("target_count")))
    return reconcile(reduce(DataFrame.unionByName, parts))


def row_hash(cols: list[str]) -> Column:
    """64-bit hash of the columns' values and of which of them are NULL, wide enough to be summed."""
    nulls = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(*[F.col(c) for c in cols], nulls).cast("decimal(38,0)")


def key_digest(df: DataFrame, key: list[str], cols: list[str], prefix: str) -> DataFrame:
    """Per key: row count and an order-insensitive sum of 64-bit row hashes (a multiset digest).

    Aggregating before the join keeps it 1:1 even when the key is not unique (no pairs are emitted
    inside a key), and the partial aggregate combines a hot key map-side.
    """
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{prefix}_n"), F.sum(row_hash(cols)).alias(f"{prefix}_h"))


def compared_keys(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """A row per key of either side with both sides' row counts and digests (s_n, s_h, t_n, t_h)."""
    cols = [c for c in source.columns if c not in key]
    return key_digest(source, key, cols, "s").join(key_digest(target.select(*source.columns), key, cols, "t"),
                                                   on=key, how="full")


def full_reconcile(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Row-level comparison per key: missing in target, extra in target, changed, equal.

    One shuffle of (key, count, digest) per side instead of whole rows.
    """
    j = compared_keys(source, target, key)
    both = F.col("s_n").isNotNull() & F.col("t_n").isNotNull()
    same = (F.col("s_n") == F.col("t_n")) & (F.col("s_h") == F.col("t_h"))
    return j.agg(
        F.count_if(F.col("t_n").isNull()).alias("missing_in_target"),
        F.count_if(F.col("s_n").isNull()).alias("extra_in_target"),
        F.count_if(both & ~same).alias("changed"),
        F.count_if(both & same).alias("equal"),
    )


@dataclass(frozen=True)
class Level:
    """One level of a checksum tree: its buckets on either side, those that differ, and the rows (of the larger side)
    that lie in the differing ones."""

    buckets: int
    seen: int
    differing: int
    rows_differing: int


def bucket_sums(df: DataFrame, key: list[str], buckets: int, prefix: str) -> DataFrame:
    """Per bucket of the key's hash: row count and order-free checksum. At most ``buckets`` rows leave a task."""
    return df.groupBy(key_bucket(key, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias(f"{prefix}_n"), F.sum(row_hash(df.columns)).alias(f"{prefix}_h"))


def key_bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets).cast("long"))


def checksum_tree(source: DataFrame, target: DataFrame, key: list[str], fanout: int = 256, leaf_rows: int = 10_000, levels: int = 4,
                  most_open: int = 100_000) -> tuple[DataFrame, DataFrame, list[Level], int]:
    """Level by level, order-free checksums of hash buckets on both sides; only buckets that differ are opened, into
    ``fanout`` times as many. Returns the rows of either side that lie in differing leaves, the levels, and the source
    rows that agree.

    A level shuffles a count and a sum for each bucket and task, not rows; a table that agrees is done after the
    first. Opening ends when differing buckets hold ``leaf_rows`` on average, when more than half of the buckets of a
    level differ (opening them all spares nothing), or beyond ``most_open`` of them: they are broadcast, eight bytes
    each, to pick their rows in the next scan. Rows whose key holds a NULL are in no bucket and are always opened.
    """
    target, lost = target.select(*source.columns), reduce(or_, [F.col(k).isNull() for k in key])
    sides, told = [source.filter(~lost), target.filter(~lost)], []
    total, opened, buckets = None, 0, 1
    for _ in range(levels):
        buckets *= fanout
        sums = [bucket_sums(df, key, buckets, p) for df, p in zip(sides, "st")]
        met = sums[0].join(sums[1], "bucket", "full").select(
            "bucket", F.coalesce("s_n", F.lit(0)).alias("s_n"), F.coalesce("t_n", F.lit(0)).alias("t_n"), (F.col("s_n").eqNullSafe(F.col("t_n")) & F.col("s_h").eqNullSafe(F.col("t_h"))).alias("same"))
        met = staged(met, "checksums")
        apart = lambda n: F.coalesce(F.sum(F.when(~F.col("same"), n)), F.lit(0))
        seen, differing, rows, source_rows, n = met.agg(
            F.count("*"), F.count_if(~F.col("same")), apart(F.greatest("s_n", "t_n")), apart(F.col("s_n")), F.coalesce(F.sum("s_n"), F.lit(0))).first()
        if total is None:
            total = opened = n
        told.append(Level(buckets, seen, differing, rows))
        if differing > most_open:  # the level above has been opened
            break
        open_ = F.broadcast(met.filter(~F.col("same")).select(F.col("bucket").alias("_open")))
        sides = [df.join(open_, key_bucket(key, buckets) == F.col("_open"), "left_semi") for df in sides]
        opened = source_rows
        if differing * leaf_rows >= rows or differing * 2 > seen:
            break
    return sides[0].unionByName(source.filter(lost)), sides[1].unionByName(target.filter(lost)), told, (total or 0) - opened


def checksum_reconcile(source: DataFrame, target: DataFrame, key: list[str], **how) -> DataFrame:
    """:func:`full_reconcile` by a checksum tree: the same four numbers, with only rows of differing buckets compared key
    by key. ``equal`` counts the rows of agreeing buckets, which are as many keys if the source's key is unique."""
    s, t, _, agree = checksum_tree(source, target, key, **how)
    found = full_reconcile(s, t, key)
    return found.withColumn("equal", F.col("equal") + F.lit(agree).cast("long"))


def differing_keys(source: DataFrame, target: DataFrame, key: list[str], **how) -> DataFrame:
    """(key, verdict) of every key that is missing, extra or changed, found by a checksum tree."""
    s, t, _, _ = checksum_tree(source, target, key, **how)
    same = (F.col("s_n") == F.col("t_n")) & (F.col("s_h") == F.col("t_h"))
    verdict = F.when(F.col("t_n").isNull(), "missing").when(F.col("s_n").isNull(), "extra").when(~same, "changed")
    return compared_keys(s, t, key).select(*key, verdict.alias("verdict")).filter("verdict IS NOT NULL")


def missing_keys(tables: dict[str, DataFrame], declared: list[tuple[str, str]]) -> DataFrame:
    """(table_name, column_name, there, rows, rows_without) of declared key columns that a table lacks or that rows of it
    leave empty; one aggregate a table, of its key columns alone."""
    parts = []
    for t, df in tables.items():
        cols = [c for name, c in declared if name == t]
        empty = lambda c, df=df: F.count_if(F.col(c).isNull()) if c in df.columns else F.count(F.lit(1))
        each = [F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("there"), F.count(F.lit(1)).alias("rows"),
                         empty(c).alias("rows_without")) for c in cols]
        parts.append(df.agg(F.array(*each).alias("keys")).select(F.inline("keys")).filter("rows_without > 0"))
    return reduce(DataFrame.unionByName, parts)


def keep_last_good(attempts: DataFrame, table_col: str, at_col: str, count_col: str, ok_col: str) -> DataFrame:
    """Per table: last good count (from successful attempts) and ``stale`` when the newest attempt failed."""
    good = F.when(F.col(ok_col), F.struct(F.col(at_col).alias("a"), F.col(count_col).alias("c")))
    return attempts.groupBy(table_col).agg(
        F.max(good).alias("_g"), F.max(F.struct(F.col(at_col).alias("a"), F.col(ok_col).alias("ok"))).alias("_l"),
    ).select(table_col, F.col("_g.c").alias("last_good_count"), F.col("_g.a").alias("last_good_at"),
             (~F.col("_l.ok")).alias("stale"))
