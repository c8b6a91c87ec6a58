"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from lexloom.plans import queries as registered


def queries() -> dict:
    return dict(registered.QUERIES)


def oracle_sql() -> dict:
    return dict(registered.SQL)
