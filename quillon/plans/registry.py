"""Registry of the queries that the driver runs."""

from __future__ import annotations

from quillon.plans import hosts, ledgers, listings  # noqa: F401 - they register their queries
from quillon.plans.queries import ORACLE_SQL, QUERIES, Query

FLAGSHIP = "timeline_in_slices"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
