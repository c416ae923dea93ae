"""All registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from checks import catalogue, closed_forms, learning, sources, tables

PARTS = (catalogue, tables, sources, learning, closed_forms)


def queries() -> dict:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
