"""Curated reports: purchase-order summary and the accounting dashboard panels.

Facts are aggregated to the join key *before* joining (lines and invoices per order), so the joins
are N:1 and never fan out; the aggregate output is hash-partitioned by the order key, which the
following join on that key reuses.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.primitives import by_age, intervals
from kestrel.functions.scalars import days_between, exact_parts, joined_parts, money_sum, month_bucket, rounded, total


# ------------------------------------------------------------------ procurement summary
class Fact(NamedTuple):
    """What one document table adds to its order: a distinct count, sums, an optional count of open rows."""

    key: str
    count: tuple[str, str]
    sums: dict[str, str]
    open_rows: tuple[str, str, str] | None
    touched: str


LINES = Fact("po_no", ("line_count", "po_line_id"), {"total_ordered_quantity": "quantity_ordered", "total_received_quantity": "quantity_received"},
             ("open_line_count", "line_status", "open"), "lines_updated_at")
INVOICES = Fact("po_no", ("invoice_count", "invoice_no"), {"total_invoice_amount": "gross_amount", "total_open_invoice_amount": "open_amount"},
                None, "invoices_updated_at")
# Columns of the header that the summary shows; one that a header doesn't have is null.
HEADER_COLUMNS = {"buyer_code": "string", "buyer_name": "string", "company_code": "string", "branch_plant": "string", "currency": "string"}


def per_order(rows: DataFrame, fact: Fact) -> DataFrame:
    """One row per order that has any; sums of no value are 0, and no sum is rounded."""
    name, of = fact.count
    aggs = [F.count_distinct(of).alias(name)]
    aggs += [F.coalesce(total(col), F.lit(0.0)).alias(out) for out, col in fact.sums.items()]
    if fact.open_rows:
        out, col, value = fact.open_rows
        aggs.append(F.count_if(F.col(col) == value).alias(out))
    return rows.groupBy(fact.key).agg(*aggs, F.max("updated_at").alias(fact.touched))


def line_summary(lines: DataFrame) -> DataFrame:
    return per_order(lines, LINES)


def invoice_summary(invoices: DataFrame) -> DataFrame:
    return per_order(invoices.filter("po_no IS NOT NULL"), INVOICES)


def payment_status(invoices: Column, still_open: Column) -> Column:
    """By the exact open amount: the smallest one keeps an order open."""
    by_amount = F.when(still_open > 0, "open").when(still_open == 0, "paid").otherwise("unknown")
    return F.when(invoices == 0, "no_invoice").otherwise(by_amount)


def po_summary(headers: DataFrame, suppliers: DataFrame, lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row per header with its supplier's name and what its lines and invoices add up to (0 without any)."""
    named = suppliers.select("supplier_code", "supplier_name", F.col("updated_at").alias("supplier_updated_at"))
    joined = headers.join(named, "supplier_code", "left")
    facts = []
    for rows, fact in ((line_summary(lines), LINES), (invoice_summary(invoices), INVOICES)):
        joined = joined.join(rows, fact.key, "left")
        zeros = {fact.count[0]: 0, **dict.fromkeys(fact.sums, 0.0), **({fact.open_rows[0]: 0} if fact.open_rows else {})}
        joined = joined.fillna(zeros)
        facts += zeros
    shown = [F.col(n) if n in headers.columns else F.lit(None).cast(t).alias(n) for n, t in HEADER_COLUMNS.items()]
    last = F.greatest("updated_at", *[F.coalesce(c, "updated_at") for c in ("supplier_updated_at", LINES.touched, INVOICES.touched)])
    return joined.select("po_no", "supplier_code", "supplier_name", *shown, "order_date", "po_status", "total_amount", *facts,
                         payment_status(F.col("invoice_count"), F.col("total_open_invoice_amount")).alias("payment_status_summary"),
                         last.alias("updated_at"))


# ------------------------------------------------------------------ accounting panels
def kpi(invoices: DataFrame, bills: DataFrame) -> DataFrame:
    """Revenue, cost, profit and margin (profit / revenue, a ratio) of two separately summed facts."""
    summed = lambda df: df.select(joined_parts(*exact_parts("amount"))).scalar()
    rev, cost = summed(invoices), summed(bills)
    one = invoices.sparkSession.range(1)
    return one.select(
        F.round(rev, 2).cast("double").alias("revenue"),
        F.round(cost, 2).cast("double").alias("cost"),
        F.round(rev - cost, 2).cast("double").alias("gross_profit"),
        F.round(F.try_divide((rev - cost).cast("double"), rev.cast("double")), 4).alias("margin"),
    )


def monthly(df: DataFrame, date_col: str, amount_col: str, out: str) -> DataFrame:
    return df.groupBy(month_bucket(date_col).alias("month")).agg(money_sum(amount_col).alias(out))


def series_diff(a: DataFrame, b: DataFrame, a_col: str, b_col: str, out: str) -> DataFrame:
    """Two monthly series full-outer-joined on month; difference NULL when one side is missing."""
    j = a.join(b, on="month", how="full")
    return j.withColumn(out, F.round(F.col(a_col).cast("decimal(38,2)") - F.col(b_col).cast("decimal(38,2)"), 2)
                        .cast("double"))


def sum_by(df: DataFrame, group: list[str], amount_col: str, out: str = "amount") -> DataFrame:
    return df.groupBy(*group).agg(money_sum(amount_col).alias(out))


def _per_key(fact: DataFrame, key: str, amount_col: str, doc_col: str | None = None) -> DataFrame:
    """Partial sums (and document counts) of a fact per join key: aggregated before any join."""
    exact, rest = exact_parts(amount_col)
    aggs = [exact.alias("_exact"), rest.alias("_rest"), F.sum(F.col(amount_col).cast("double")).alias("_plain")]
    if doc_col:
        aggs.append(F.count(F.col(doc_col)).alias("_docs"))
    return fact.groupBy(key).agg(*aggs)


def sum_by_dim(fact: DataFrame, key: str, dim: DataFrame, group: list[str], amount_col: str,
               out: str = "amount") -> DataFrame:
    """SUM(fact.amount) grouped by dimension attributes, aggregating the fact to its join key first.

    The fact is combined map-side and shuffled once as (key, partial sum); the N:1 join then sees one
    row per key instead of every fact row. Both parts of the sum stay apart until the final rounding, so
    the result equals joining first.
    """
    j = _per_key(fact, key, amount_col).join(dim.select(key, *group), on=key, how="left")
    both = joined_parts(F.try_sum("_exact"), F.sum("_rest"))
    return j.groupBy(*group).agg(rounded(both, F.sum("_plain")).alias(out))


def top_parties(fact: DataFrame, key: str, dim: DataFrame, name_col: str, amount_col: str, doc_col: str,
                value_name: str, count_name: str, k: int = 10) -> DataFrame:
    """Top-k parties by amount with their document count; names joined after aggregating per key."""
    j = _per_key(fact, key, amount_col, doc_col).join(dim.select(key, name_col), on=key, how="left")
    amount = rounded(joined_parts(F.col("_exact"), F.col("_rest")), F.col("_plain"))
    g = j.select(key, name_col, amount.alias(value_name), F.col("_docs").alias(count_name))
    return g.orderBy(F.col(value_name).desc_nulls_last(), F.col(key).asc(), F.col(name_col).asc()).limit(k)


def unpaid_aging(df: DataFrame, due_col: str, amount_col: str, status_col: str, as_of: str,
                 buckets: str = "30,60,90") -> DataFrame:
    """Unpaid, past-due documents by age bucket; the last label is '<last>+' (dashboard form)."""
    steps = intervals(buckets)
    ref = F.lit(as_of).cast("date")
    past = df.filter((F.col(status_col) != "paid") & (ref >= F.col(due_col).cast("date")))
    return by_age(past, days_between(ref, due_col), steps, amount_col, "amount", f"{steps[-2].high}+")


def trial_balance(journal: DataFrame, type_col: str = "account_type") -> DataFrame:
    """Sum of debits less sum of credits per account type, rounded once."""
    both = [joined_parts(*exact_parts(c)) for c in ("debit", "credit")]
    return journal.groupBy(type_col).agg(rounded(both[0] - both[1], F.sum(F.col("debit") - F.col("credit")).cast("double")).alias("balance"))
