"""Join operators: fan-out guard, anti-joins, outer series joins, existence, skew-split 1:N joins.

Spark's own size statistics and AQE choose between broadcast and sort-merge. The only explicit broadcast
is the hot-key list of ``skew_split_join``, which can hold at most 1/fraction keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def fanout_keys(df: DataFrame, key: str) -> DataFrame:
    """Non-null key values occurring more than once (empty = the key is safe as an N:1 target).

    A partial/final hash aggregate: a hot key is combined map-side before the shuffle.
    """
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def is_fanout(df: DataFrame, key: str) -> bool:
    return not fanout_keys(df, key).isEmpty()


def missing_rows(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key is absent from the target (``left_anti``); only the keys of the target are read."""
    return source.join(target.select(*keys).distinct(), on=keys, how="left_anti")


def orphan_fk(fact: DataFrame, fk: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Fact rows whose non-null FK has no dimension row."""
    d = dim.select(F.col(dim_key).alias("_kestrel_dk"))
    return fact.filter(F.col(fk).isNotNull()).join(d, F.col(fk) == F.col("_kestrel_dk"), "left_anti")


def outer_by_field(a: DataFrame, b: DataFrame, key: str, diff_name: str, a_val: str, b_val: str) -> DataFrame:
    """Full outer join of two aggregated series on ``key``, then ``a - b`` (NULL when a side is missing)."""
    j = a.join(b, on=key, how="full")
    return j.withColumn(diff_name, F.round(F.col(a_val).cast("decimal(38,4)") - F.col(b_val).cast("decimal(38,4)"),
                                           2).cast("double"))


def existence(expected: DataFrame, name_col: str, actual_counts: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Per expected table: exists?, rows, active model defined? (left joins from the expected list)."""
    out = expected.join(actual_counts, on=name_col, how="left").withColumn("exists", F.col("row_count").isNotNull())
    if models is not None:
        out = out.join(models, on=name_col, how="left").withColumn("has_model", F.coalesce(F.col("has_model"), F.lit(False)))
    return out


def union_first_wins(primary: DataFrame, extra: DataFrame, name_col: str) -> DataFrame:
    """Primary rows plus the extra rows whose name (case-insensitive) is not already present."""
    keys = primary.select(F.upper(F.col(name_col)).alias("_kestrel_u")).distinct()
    new = extra.join(keys, F.upper(extra[name_col]) == keys["_kestrel_u"], "left_anti")
    return primary.unionByName(new)


def distinct_keep_order(df: DataFrame, value_col: str, pos_col: str) -> DataFrame:
    """First occurrence of each value by position: min(pos) per value, in position order."""
    return df.groupBy(value_col).agg(F.min(pos_col).alias(pos_col)).orderBy(pos_col)


# When a right-side key counts as hot, and how many ways its rows are split.
HOT_KEY_FRACTION = 0.001
HOT_KEY_MIN_ROWS = 100_000
SALT_BUCKETS = 32


def hot_keys(right: DataFrame, key: str, fraction: float = HOT_KEY_FRACTION, min_rows: int = HOT_KEY_MIN_ROWS
             ) -> DataFrame:
    """Keys holding at least max(min_rows, fraction x rows) right-side rows.

    A grouped count (combined map-side) with a threshold taken from a scalar-subquery total; at most
    1/fraction keys can pass it, so the result has a proven size bound and may be broadcast.
    """
    total = right.select(F.count(F.lit(1))).scalar()
    threshold = F.greatest(F.lit(min_rows), F.floor(total * F.lit(fraction)))
    return (right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= threshold).select(F.col(key).alias("_kestrel_hot")))


def skew_split_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left",
                    fraction: float = HOT_KEY_FRACTION, min_rows: int = HOT_KEY_MIN_ROWS,
                    buckets: int = SALT_BUCKETS) -> DataFrame:
    """A 1:N join that stays balanced when a few right-side keys hold a large share of the rows.

    Rows of hot keys are spread over ``buckets`` salts on the right and the matching left rows are
    replicated once per salt, so a key with a third of the rows is joined by ``buckets`` tasks instead
    of one. Every left row of a hot key has a match, so that part is an inner join and no row is
    padded or repeated; all other rows take the ordinary join of type ``how`` (left or inner).
    """
    hot = hot_keys(right, right_key, fraction, min_rows)
    hot_list = hot.collect()  # bounded by 1 / fraction keys
    if not hot_list:
        return left.join(right, left[left_key] == right[right_key], how)
    hot_b = F.broadcast(left.sparkSession.createDataFrame(hot_list, hot.schema))
    is_hot_l = F.col(left_key) == F.col("_kestrel_hot")
    is_hot_r = F.col(right_key) == F.col("_kestrel_hot")
    left_hot = left.join(hot_b, is_hot_l, "left_semi")
    left_cold = left.join(hot_b, is_hot_l, "left_anti")
    right_hot = right.join(hot_b, is_hot_r, "left_semi")
    right_cold = right.join(hot_b, is_hot_r, "left_anti")
    # by row, not by value: the rows of a hot key may agree in every column that is left
    salted_r = right_hot.withColumn("_kestrel_salt", F.pmod(F.monotonically_increasing_id(), F.lit(buckets)))
    salted_l = left_hot.withColumn("_kestrel_salt", F.explode(F.sequence(F.lit(0).cast("long"),
                                                                         F.lit(buckets - 1).cast("long"))))
    hot_part = salted_l.join(salted_r, (salted_l[left_key] == salted_r[right_key]) &
                             (salted_l["_kestrel_salt"] == salted_r["_kestrel_salt"]), "inner")
    hot_part = hot_part.select(*[salted_l[c] for c in left.columns], *[salted_r[c] for c in right.columns])
    cold_part = left_cold.join(right_cold, left_cold[left_key] == right_cold[right_key], how)
    return cold_part.unionByName(hot_part)
