"""The queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("text", "tables", "scan", "redact", "layout", "document")


def _groups():
    return [import_module(f"quire.plans.{g}").query for g in GROUPS]


def queries() -> dict:
    return {k: q for g in _groups() for k, q in g.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for g in _groups() for k, s in g.sql.items()}
