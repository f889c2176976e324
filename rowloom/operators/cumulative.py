"""Running aggregates per group, with an include mask and a reset mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.nulls import clean, invalid


def running(
    df: DataFrame, keys: list[str], order_by: list[str], made: dict[str, tuple[str, str]],
    include: Column | None = None, reset: Column | None = None,
) -> DataFrame:
    """``made`` maps names to (kind, column).

    A reset starts a new segment; with both masks it counts only on an included row.  Rows outside the
    mask repeat the running value.  cumsum, cumprod; cummin, cummax (an invalid value stays until the
    segment ends); cumnanmin, cumnanmax (skipping); findnth (the number of the included row, else 0).
    """
    m = F.lit(True) if include is None else F.coalesce(include, F.lit(False))
    parts = list(keys)
    if reset is not None:
        r = (F.coalesce(reset, F.lit(False)) & m).cast("int")
        df = df.withColumn("__seg", F.sum(r).over(Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)))
        parts.append("__seg")
    run = Window.partitionBy(*parts).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for name, (kind, x) in made.items():
        c = F.col(x)
        v = F.when(m, clean(c))
        stuck = F.max(F.when(m, invalid(c)).cast("int")).over(run) == 1
        if kind == "cumsum":
            out[name] = F.coalesce(F.sum(v).over(run), F.lit(0.0))
        elif kind == "cumprod":
            out[name] = F.coalesce(F.product(v).over(run), F.lit(1.0))
        elif kind == "cumnanmin":
            out[name] = F.min(v).over(run)
        elif kind == "cumnanmax":
            out[name] = F.max(v).over(run)
        elif kind == "cummin":
            out[name] = F.when(~stuck, F.min(v).over(run))
        elif kind == "cummax":
            out[name] = F.when(~stuck, F.max(v).over(run))
        elif kind == "findnth":
            out[name] = F.when(m, F.sum(m.cast("int")).over(run)).otherwise(F.lit(0))
        else:
            raise ValueError(kind)
    return df.withColumns(out).drop("__seg")
