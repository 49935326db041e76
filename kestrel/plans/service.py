"""Model service: register a model once (checks run then), read it many times (no probes on reads).

    svc = ModelService(spark, registry(spark, root), SnapshotStore(spark, work))
    svc.register(AR_MODEL)                         # schema checks + data probes; errors refuse it
    svc.records("ar_360", {"o_orderstatus": "O"}, limit=50)
    svc.function("ar_360", "aggregate", {"agg": "sum", "measure": "o_totalprice", "group_by": "r_name"})
    svc.lookup("ar_360", "42")

A function only asks the model for the columns it uses, so unused lookup joins are removed from the
plan; when a snapshot of the model is enabled and built, reads come from it instead of the live join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.primitives import REGISTRY, FunctionError, run_function, used_columns
from kestrel.operators import filters as FL
from kestrel.plans.check import model_check
from kestrel.plans.model import ModelError, ModelSpec
from kestrel.sources import matview as MV
from kestrel.sources.snapshots import SnapshotStore
from kestrel.sources.tables import TableRegistry


@dataclass(frozen=True)
class RouteLimits:
    """Largest results of a caller that wants them bounded; a request beyond them is refused, never cut."""

    page: int = 500
    groups: int = 1000


class ModelService:
    def __init__(self, spark: SparkSession, reg: TableRegistry, store: SnapshotStore | None = None, limits: RouteLimits | None = None):
        self.spark, self.reg, self.store, self.limits = spark, reg, store, limits
        self.models: dict[str, ModelSpec] = {}
        self.materialised: set[str] = set()

    def register(self, spec: ModelSpec, materialise: bool = False) -> DataFrame:
        """Check the model (schema + data probes, one job); refuse it on any error."""
        issues = model_check(self.spark, self.reg, spec)
        errors = [r for r in issues.filter(F.col("level") == "error").collect()]
        if errors:
            raise ModelError([{"code": r.code, "message": r.message} for r in errors])
        self.models[spec.name] = spec
        if materialise and self.store is not None:
            MV.build(self.store, self.reg, spec)
            self.materialised.add(spec.name)
        return issues

    def _frame(self, name: str, needed: list[str] | None = None) -> DataFrame:
        spec = self.models.get(name)
        if spec is None:
            raise KeyError(f"model not registered: {name}")
        return MV.read_or_live(self.store, self.reg, spec, enabled=name in self.materialised, needed=needed)

    def records(self, name: str, filters: dict[str, str] | None = None, limit: int | None = None,
                offset: int = 0) -> DataFrame:
        spec = self.models[name]
        if self.limits and (limit is None or limit > self.limits.page):
            raise FunctionError(f"limit must be given and at most {self.limits.page}")
        df = FL.filter_equals(self._frame(name), filters or {})
        key = (spec.pk or spec.attributes[0]).name
        return FL.page_by_key(df, key, limit, offset)

    def function(self, name: str, function: str, params: dict) -> DataFrame:
        if function not in REGISTRY:
            raise FunctionError(f"unknown function '{function}'; allowed: {sorted(REGISTRY)}")
        if self.limits and int(params.get("limit") or 0) > self.limits.groups:
            raise FunctionError(f"limit must be at most {self.limits.groups}")
        needed = used_columns(params)
        known = {a.name for a in self.models[name].attributes}
        bad = [c for c in needed if c not in known]
        if bad:
            raise FunctionError(f"'{bad[0]}' is not an exposed column of this model", 422)
        return run_function(self._frame(name, needed), function, params)

    def lookup(self, name: str, key_value: str) -> Row:
        spec = self.models[name]
        if spec.pk is None:
            raise KeyError(f"model {name} has no primary key")
        rows = FL.lookup_by_key(self._frame(name), spec.pk.name, key_value, spec.model_type).collect()
        return FL.require_single(rows)
