"""The queries of the engine and their SQL."""

from __future__ import annotations

from .plans.oracle import SQL
from .plans.queries import queries


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["oracle_sql", "queries"]
