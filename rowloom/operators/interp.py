"""Piecewise linear interpolation over a table of knots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.nulls import invalid


def interpolate(x: Column, xs: list[float], ys: list[float], clip: bool = False) -> Column:
    """The line through the two knots around ``x``; outside, the end's line goes on or the end value holds."""
    if len(xs) != len(ys) or len(xs) < 2:
        raise ValueError("two knots at least, with a value each")
    slope = [(y1 - y0) / (x1 - x0) for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False)]
    line = lambda j: F.lit(ys[j]) + (x - F.lit(xs[j])) * F.lit(slope[j])
    made = F.when(invalid(x), F.lit(None))
    if clip:
        made = made.when(x <= F.lit(xs[0]), F.lit(ys[0])).when(x >= F.lit(xs[-1]), F.lit(ys[-1]))
    for j in range(len(xs) - 2):
        made = made.when(x <= F.lit(xs[j + 1]), line(j))
    return made.otherwise(line(len(xs) - 2))


def interpolate_rows(x: Column, xs: Column, ys: Column, clip: bool = False) -> Column:
    """The same with a table of its own in each row: ``xs`` ascending, ``ys`` as long.

    NULL where a table is missing, has fewer than two knots, or differs in length.
    """
    n = F.size(xs)
    # The segment ends at the first inner knot that isn't below x; of none it is the last one.
    at = F.size(F.filter(F.slice(xs, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda knot: knot < x)) + 1
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    line = y0 + (x - x0) * ((y1 - y0) / F.when(x1 != x0, x1 - x0))
    made = F.when(invalid(x) | xs.isNull() | ys.isNull() | (n < 2) | (n != F.size(ys)), F.lit(None))
    if clip:
        made = made.when(x <= F.get(xs, F.lit(0)), F.get(ys, F.lit(0))).when(x >= F.get(xs, n - 1), F.get(ys, n - 1))
    return made.otherwise(line)
