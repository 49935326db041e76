"""Declarative data models: projection of source columns plus N:1 lookup joins.

A model is a frozen spec compiled to a lazy DataFrame. Catalyst does the physical work (pushdown,
pruning, broadcast vs sort-merge under AQE); the builder only fixes the join order needed for the
fold to be well-formed, applies newest-row-per-key dedup below the joins, and removes LEFT joins
whose columns are not used (Spark keeps them; PostgreSQL removes them).
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.joins import skew_split_join
from kestrel.operators.windows import latest_per_key
from kestrel.sources.tables import TableRegistry


class ModelError(ValueError):
    def __init__(self, issues: list[dict]):
        super().__init__("; ".join(i["message"] for i in issues))
        self.issues = issues


@dataclass(frozen=True)
class Attribute:
    name: str
    source_table: str
    source_column: str
    data_type: str | None = None  # platform type; None = taken from the source column
    is_pk: bool = False
    required: bool = False


@dataclass(frozen=True)
class JoinSpec:
    left_table: str
    left_column: str
    right_table: str
    right_column: str
    how: str = "left"  # left | inner
    allow_fanout: bool = False


@dataclass(frozen=True)
class LatestConfig:
    """Reduce every model table to its newest row per key before joining.

    The base table is keyed by the PK column, each joined table by its join key. ``recency`` must
    exist in every table unless overridden per table; ``tiebreak`` (per table) breaks recency ties.
    """

    recency: str = "updated_at"
    recency_by_table: dict = field(default_factory=dict)
    tiebreak_by_table: dict = field(default_factory=dict)

    def recency_for(self, table: str) -> str:
        return self.recency_by_table.get(table, self.recency)

    def __hash__(self):  # dict fields: hash the canonical json
        return hash(json.dumps(asdict(self), sort_keys=True))


@dataclass(frozen=True)
class ModelSpec:
    name: str
    attributes: tuple
    joins: tuple = ()
    latest: LatestConfig | None = None
    model_type: str = "B"

    @property
    def pk(self) -> Attribute | None:
        pks = [a for a in self.attributes if a.is_pk]
        return pks[0] if pks else None

    @property
    def base_table(self) -> str:
        return (self.pk or self.attributes[0]).source_table

    @property
    def tables(self) -> list[str]:
        seen: list[str] = []
        for t in [self.base_table, *[a.source_table for a in self.attributes],
                  *[j.right_table for j in self.joins], *[j.left_table for j in self.joins]]:
            if t not in seen:
                seen.append(t)
        return seen

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:16]


def plan_joins(spec: ModelSpec) -> tuple[list[JoinSpec], list[dict]]:
    """Order joins so each left side is already present, starting at the base table.

    Returns (ordered joins, warnings). An identical second edge to an already-joined table is dropped
    with a warning; a different edge to it, or a table that cannot be reached, is an error.
    """
    present = {spec.base_table}
    pending = list(spec.joins)
    ordered: list[JoinSpec] = []
    warnings: list[dict] = []
    errors: list[dict] = []
    edge_to: dict[str, JoinSpec] = {}
    for j in spec.joins:
        if j.how not in ("left", "inner"):
            errors.append({"code": "join_type", "message": f"join type '{j.how}' not allowed (left|inner)"})
    progress = True
    while pending and progress:
        progress = False
        for j in list(pending):
            if j.left_table not in present:
                continue
            pending.remove(j)
            progress = True
            if j.right_table in present:
                prev = edge_to.get(j.right_table)
                if prev == j:
                    warnings.append({"code": "duplicate_join", "message": f"duplicate join to {j.right_table} ignored"})
                else:
                    errors.append({"code": "join_conflict",
                                   "message": f"conflicting second join to {j.right_table}"})
                continue
            present.add(j.right_table)
            edge_to[j.right_table] = j
            ordered.append(j)
    for j in pending:
        errors.append({"code": "unreachable", "message": f"table {j.left_table} is not reachable from {spec.base_table}"})
    for a in spec.attributes:
        if a.source_table not in present and not any(e["code"] == "unreachable" for e in errors):
            errors.append({"code": "unreachable", "message": f"table {a.source_table} of '{a.name}' is not joined"})
    if errors:
        raise ModelError(errors)
    return ordered, warnings


def prune_joins(spec: ModelSpec, ordered: list[JoinSpec], needed: list[str]) -> list[JoinSpec]:
    """Drop LEFT joins that contribute no needed column and carry no later join.

    Valid because a registered model's LEFT join without ``allow_fanout`` has a right key proven
    unique (fan-out guard) or made unique by dedup, so removing it changes neither rows nor values.
    INNER joins (which filter) and fan-out joins (which multiply) are always kept.
    """
    used_tables = {a.source_table for a in spec.attributes if a.name in needed}
    kept = list(ordered)
    changed = True
    while changed:
        changed = False
        for j in reversed(kept):
            hangs = any(k.left_table == j.right_table for k in kept if k is not j)
            if j.how == "left" and not j.allow_fanout and j.right_table not in used_tables and not hangs:
                kept.remove(j)
                changed = True
                break
    return kept


def _prefixed(table: str, column: str) -> str:
    return f"{table}__{column}"


def build_model(reg: TableRegistry, spec: ModelSpec, needed: list[str] | None = None,
                prune: bool = True, skew_split: bool = True, skew_options: dict | None = None) -> DataFrame:
    """Compile a model spec to a lazy DataFrame with one column per (needed) attribute, in order.

    N:1 lookups are plain joins (a hot key sits on the left side, where AQE can split it). A 1:N
    ``allow_fanout`` join goes through ``skew_split_join`` when ``skew_split``: right-side keys
    holding a large share of the rows are salted so no single task joins them all (``skew_options``:
    ``fraction``, ``min_rows``, ``buckets`` of ``skew_split_join``).
    """
    ordered, _ = plan_joins(spec)
    attrs = [a for a in spec.attributes if needed is None or a.name in needed]
    names = [a.name for a in attrs]
    joins = prune_joins(spec, ordered, names) if prune else ordered

    cols: dict[str, list[str]] = {}

    def need(t: str, c: str) -> None:
        cols.setdefault(t, [])
        if c not in cols[t]:
            cols[t].append(c)

    base_attrs = [a for a in spec.attributes if a.source_table == spec.base_table]
    base_key = spec.pk.source_column if spec.pk else base_attrs[0].source_column
    need(spec.base_table, base_key)
    for a in attrs:
        need(a.source_table, a.source_column)
    for j in joins:
        need(j.left_table, j.left_column)
        need(j.right_table, j.right_column)

    def relation(t: str, key: str) -> DataFrame:
        df = reg.table(t)
        if spec.latest is not None:
            rec = spec.latest.recency_for(t)
            tb = spec.latest.tiebreak_by_table.get(t)
            if tb is None and "id" in df.columns and "id" not in (key, rec):
                tb = "id"
            df = latest_per_key(df, key, rec, tb)
        return df.select(*[F.col(c).alias(_prefixed(t, c)) for c in cols[t]])

    cur = relation(spec.base_table, base_key)
    for j in joins:
        right = relation(j.right_table, j.right_column)
        lk, rk = _prefixed(j.left_table, j.left_column), _prefixed(j.right_table, j.right_column)
        if j.allow_fanout and skew_split:
            cur = skew_split_join(cur, right, lk, rk, j.how, **(skew_options or {}))
        else:
            cur = cur.join(right, cur[lk] == right[rk], j.how)
    return cur.select(*[F.col(_prefixed(a.source_table, a.source_column)).alias(a.name) for a in attrs])


def attr(name: str, table: str, column: str | None = None, **kw) -> Attribute:
    return Attribute(name=name, source_table=table, source_column=column or name, **kw)
