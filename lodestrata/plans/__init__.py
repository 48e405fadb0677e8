"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from lodestrata.plans import composed, dialogue, ingest, knowledge, retrieval  # noqa: F401
from lodestrata.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
