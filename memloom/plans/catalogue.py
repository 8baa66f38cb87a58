"""The registered queries of the memory engine and the SQL they are held against."""

from __future__ import annotations

from . import graph, memory, proofs, retention, streams  # noqa: F401  each module registers its queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
