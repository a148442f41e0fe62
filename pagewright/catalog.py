"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import more_queries, scan_queries  # noqa: F401  they register their queries
from .plans.queries import QUERIES, SQL, flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
