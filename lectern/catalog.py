"""Every query of the engine's own operators, with its oracle SQL."""

from __future__ import annotations

from lectern.plans import drawings, linked, phrases, relational, scopes, search, sheets


def queries() -> dict:
    return {**search.QUERIES, **relational.QUERIES, **scopes.QUERIES, **phrases.QUERIES, **linked.QUERIES, **sheets.QUERIES, **drawings.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**search.SQL, **relational.SQL, **scopes.SQL, **phrases.SQL, **linked.SQL, **sheets.SQL, **drawings.SQL}
