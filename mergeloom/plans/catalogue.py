"""All queries of the library outside the llm subpackage, and the SQL they are checked against."""

from __future__ import annotations

from mergeloom.plans import cleaning, extraction, general, linking, matches, networks, reporting, streams, structure, upkeep  # noqa: F401  (the modules fill the registry)
from mergeloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
