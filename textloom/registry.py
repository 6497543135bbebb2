"""All queries on the engine's own operators, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["textloom.plans.text_queries", "textloom.plans.relationship_queries", "textloom.plans.score_queries"]


def _gather(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(name), kind)()
        if twice := found.keys() & part.keys():
            raise ValueError(f"{name}: {sorted(twice)} exist already")
        found |= part
    return found


def queries() -> dict:
    return _gather("queries")


def oracle_sql() -> dict[str, str]:
    return _gather("oracle_sql")
