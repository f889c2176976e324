"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  ``queries`` and ``oracle_sql`` come from
:mod:`rowloom.llm.registry`.
"""

from rowloom.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
