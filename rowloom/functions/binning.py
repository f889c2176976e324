"""Bins of sorted edges.  The edges are literals of a plan, so the search stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.nulls import invalid


def _edges(edges: list[float]) -> Column:
    return F.array(*[F.lit(e) for e in edges])


def searchsorted(x: Column, edges: list[float], right: bool = False) -> Column:
    """How many edges are below ``x`` (``right``: or equal); invalid values come after all."""
    n = F.size(F.filter(_edges(edges), (lambda e: e <= x) if right else (lambda e: e < x)))
    return F.when(invalid(x), F.lit(len(edges))).otherwise(n)


def cut(x: Column, edges: list[float]) -> Column:
    """The bin j with edge[j-1] < x <= edge[j]; the first edge is in bin 1; 0 outside or invalid."""
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1])) & ~invalid(x)
    return F.when(~F.coalesce(inside, F.lit(False)), F.lit(0)).otherwise(F.greatest(F.lit(1), searchsorted(x, edges)))


def qcut_labels(x: Column, edges: list[float]) -> Column:
    """Labels that leave 0 for NaN and infinities and 1 for values outside: bins count from 2."""
    odd = invalid(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(odd, F.lit(0)).otherwise(cut(x, edges) + 1)


def cut_strings(x: Column, edges: list[str]) -> Column:
    """The same cut over text in byte order; NULL and the empty string are in bin 0."""
    n = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < x))
    inside = (x != "") & (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    return F.when(~F.coalesce(inside, F.lit(False)), F.lit(0)).otherwise(F.greatest(F.lit(1), n))
