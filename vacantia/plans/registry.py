"""All queries of the core library."""

from __future__ import annotations

from vacantia.plans import dates, keyed, messages, pages, searching, sourcing, state, texts

MODULES = [dates, searching, texts, keyed, sourcing, messages, pages, state]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
