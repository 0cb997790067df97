"""The queries over the test tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from . import catalogue, diffs, evolution, extended, mining, relational, retrieval
from .registry import Query, Registry

MODULES = (catalogue, diffs, relational, retrieval, evolution, mining, extended)


def _registries() -> list[Registry]:
    return [m.registry for m in MODULES]


def all_queries() -> dict[str, Query]:
    return {k: q for r in _registries() for k, q in r.queries.items()}


def all_sql() -> dict[str, str]:
    return {k: s for r in _registries() for k, s in r.sql.items()}
