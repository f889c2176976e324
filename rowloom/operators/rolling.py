"""Rolling windows of rows: grouped by keys, or over the whole table in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rowloom.functions.nulls import clean, invalid
from rowloom.operators.ordered import windowed


def _frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling(kind: str, x: Column, w: WindowSpec, n: int, q: float = 0.5) -> Column:
    """The current row and the n - 1 before; partial windows at the start count.

    sum, mean: NULL while an invalid row is in the window; nansum, nanmean, var, quantile skip it;
    diff and shift: n rows back, ahead if negative; count: rows before, counted from the end if n < 0.
    """
    v = clean(x)
    if kind == "diff":
        return x - F.lag(x, n).over(w) if n >= 0 else x - F.lead(x, -n).over(w)
    if kind == "shift":
        return F.lag(x, n).over(w) if n >= 0 else F.lead(x, -n).over(w)
    if kind == "count":
        return F.row_number().over(w) - 1
    if n <= 0:
        raise ValueError("a rolling window needs at least one row")
    f = _frame(w, n)
    whole = F.count(v).over(f) == F.count(F.lit(1)).over(f)
    if kind == "sum":
        return F.when(whole, F.sum(v).over(f))
    if kind == "mean":
        return F.when(whole, F.avg(v).over(f))
    if kind == "nansum":
        return F.coalesce(F.sum(v).over(f), F.lit(0))
    if kind == "nanmean":
        return F.avg(v).over(f)
    if kind in ("var", "std"):
        # Sample variance while the window fills, population variance once it is full.
        full = F.row_number().over(w) > n
        var = F.when(full, F.var_pop(v).over(f)).otherwise(F.var_samp(v).over(f))
        return var if kind == "var" else F.sqrt(var)
    if kind == "quantile":
        held = F.array_sort(F.collect_list(v).over(f))
        at = (F.size(held) - 1) * F.lit(q)
        pick = lambda i: F.get(held, F.greatest(i.cast("int"), F.lit(0)))
        return (pick(F.floor(at)) + pick(F.ceil(at))) / 2
    raise ValueError(kind)


def grouped(df: DataFrame, keys: list[str], order_by: list[str], made: dict[str, tuple]) -> DataFrame:
    """``made`` maps names to (kind, column, n[, q])."""
    out = {}
    for name, (kind, x, n, *q) in made.items():
        order = [F.col(o).desc() for o in order_by] if kind == "count" and n < 0 else order_by
        out[name] = rolling(kind, F.col(x), Window.partitionBy(*keys).orderBy(*order), n, *q)
    return df.withColumns(out)


def ungrouped(df: DataFrame, order_by: list[str], made: dict[str, tuple]) -> DataFrame:
    """The same over the whole table, in blocks of positions."""
    reach = max(abs(spec[2]) for spec in made.values())

    def columns(w):
        return {name: rolling(spec[0], F.col(spec[1]), w, *spec[2:]) for name, spec in made.items() if spec[0] != "count"}

    if any(spec[0] in ("var", "std", "count") for spec in made.values()):
        raise ValueError("var, std and count depend on the position in the whole table: use ungrouped_spread")
    return windowed(df, order_by, reach, columns, reach)


def ungrouped_spread(df: DataFrame, order_by: list[str], x: str, n: int) -> DataFrame:
    """Rolling var and std over the whole table; the switch to the population form goes by global position."""
    from rowloom.operators.ordered import with_position

    rows = with_position(df, order_by, "__global")

    def columns(w):
        v, f = clean(F.col(x)), _frame(w, n)
        var = F.when(F.col("__global") >= n, F.var_pop(v).over(f)).otherwise(F.var_samp(v).over(f))
        return {"var": var, "std": F.sqrt(var)}

    return windowed(rows, order_by, n, columns).drop("__global")


def shift_rows(df: DataFrame, order_by: list[str], names: list[str], n: int) -> DataFrame:
    """Every named column moved n rows up (down if negative); vacated rows are NULL."""
    return windowed(df, order_by, max(-n, 0), lambda w: {c: (F.lead(c, n) if n >= 0 else F.lag(c, -n)).over(w) for c in names}, max(n, 0))


def is_sorted(df: DataFrame, order_by: list[str], x: str) -> DataFrame:
    """One row: whether ``x`` ascends in the row order, NaN and NULL being allowed at the end only."""
    bad = invalid(F.col(x), df.schema[x].dataType.simpleString() in ("double", "float"))
    rows = windowed(df.withColumn("__bad", bad), order_by, 1, lambda w: {"__before": F.lag(x).over(w), "__worse": F.lag("__bad").over(w)})
    fine = F.when(F.col("__worse").isNull() | F.col("__bad"), True).when(F.col("__worse"), False).otherwise(F.col(x) >= F.col("__before"))
    return rows.agg(F.coalesce(F.bool_and(fine), F.lit(True)).alias("is_sorted"))
