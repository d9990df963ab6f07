"""All queries and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = ["chain_queries", "junction_queries", "end_queries", "model_queries", "evidence_queries", "region_queries", "review_queries"]


def _all() -> dict:
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"strandloom.plans.{name}").QUERIES
    return found


def queries() -> dict:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
