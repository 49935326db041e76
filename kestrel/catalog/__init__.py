"""All registered queries. Importing the submodules fills ``CATALOG``."""

from kestrel.catalog.base import CATALOG  # noqa: F401
from kestrel.catalog import (  # noqa: F401,E402
    aggregations, backfill, growing, incremental, joins, loads, projections, reconcile, reports, scalars, status_oracles)


def queries():
    return {k: e.fn for k, e in CATALOG.entries.items()}


def oracle_sql():
    return {k: e.oracle for k, e in CATALOG.entries.items() if e.oracle}
