"""Registered queries, one for each operator, and their SQL."""

from __future__ import annotations

from rowloom.plans import element_queries, group_queries, order_queries

_ALL = (group_queries, order_queries, element_queries)


def queries() -> dict:
    return {name: q for m in _ALL for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _ALL for name, s in m.SQL.items()}
