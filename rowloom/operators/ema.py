"""Exponential moving averages per group.

Without masks they have a closed form over a running sum, which stays in the JVM.  It holds while
``rate * (time since the group's first row)`` fits an exponent; groups that go beyond are cut into
segments of at most ``SPAN`` and the carry from segment to segment is itself a short running sum.
With masks the recurrence runs in ``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Exponent that a segment may reach.
SPAN = 300.0


def _weights(df: DataFrame, keys: list[str], order_by: list[str], time: str, rate: float):
    w = Window.partitionBy(*keys).orderBy(*order_by)
    elapsed = (F.col(time) - F.first(time).over(w.rowsBetween(Window.unboundedPreceding, 0))) * F.lit(rate)
    df = df.withColumn("__e", elapsed.cast("double")).withColumn("__seg", F.floor(F.col("__e") / SPAN))
    return df.withColumn("__local", F.col("__e") - F.col("__seg") * SPAN), w


def _accumulate(df: DataFrame, keys: list[str], order_by: list[str], term: Column, name: str) -> DataFrame:
    """exp(-e) * running sum of term * exp(e), over segments: only neighbours of a segment matter, since
    what lies two spans back has decayed by exp(-SPAN) or more."""
    run = Window.partitionBy(*keys, "__seg").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__inner", F.sum(term * F.exp("__local")).over(run))
    # The end of the segment before, seen from this one's start.
    whole = Window.partitionBy(*keys).orderBy("__seg").rangeBetween(-1, -1)
    df = df.withColumn("__carry", F.max(F.when(F.lit(True), F.struct(F.col("__local"), *order_by, F.col("__inner")))).over(whole))
    carried = F.coalesce(F.col("__carry.__inner") * F.exp(F.lit(-SPAN)), F.lit(0.0))
    return df.withColumn(name, F.exp(-F.col("__local")) * (F.col("__inner") + carried)).drop("__inner", "__carry", "__seg", "__local", "__e")


def ema_decay(df: DataFrame, keys: list[str], order_by: list[str], x: str, time: str, rate: float, include: Column | None = None, name: str = "ema") -> DataFrame:
    """e = x + e * exp(-rate * dt); rows outside the mask add nothing but decay.  Time must not go back within a group."""
    df, _ = _weights(df, keys, order_by, time, rate)
    term = F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    if include is not None:
        term = F.when(F.coalesce(include, F.lit(False)), term).otherwise(0.0)
    return _accumulate(df, keys, order_by, term, name)


def ema_normal(df: DataFrame, keys: list[str], order_by: list[str], x: str, time: str, rate: float, name: str = "ema") -> DataFrame:
    """e = x * (1 - w) + e * w with w = exp(-rate * dt); the first e is x.

    Where time goes back, w is zero: e starts again from x there.
    """
    order = Window.partitionBy(*keys).orderBy(*order_by)
    back = F.coalesce((F.col(time) < F.lag(time).over(order)).cast("long"), F.lit(0).cast("long"))
    df = df.withColumn("__back", back).withColumn("__run", F.sum("__back").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [*keys, "__run"]
    df, w = _weights(df, keys, order_by, time, rate)
    step = F.exp(-(F.col("__e") - F.lag("__e").over(w)))
    df = df.withColumn("__term", F.when(F.row_number().over(w) == 1, F.col(x).cast("double")).otherwise(F.col(x) * (1 - step)))
    return _accumulate(df, keys, order_by, F.col("__term"), name).drop("__term", "__run", "__back")


def ema_weighted(df: DataFrame, keys: list[str], order_by: list[str], x: str, weight: float, name: str = "ema") -> DataFrame:
    """e = x * (1 - weight) + e * weight by row; the first e is x.  The row number is the time."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    df = df.withColumn("__t", F.row_number().over(w).cast("double"))
    return ema_normal(df, keys, order_by, x, "__t", -float(np.log(weight)), name).drop("__t")


def ema_masked(df: DataFrame, keys: list[str], order_by: list[str], x: str, time: str, rate: float, include: str | None, reset: str | None, kind: str = "normal", name: str = "ema") -> DataFrame:
    """The recurrence with masks, one group at a time.

    normal: excluded rows repeat the average (0 before the first included row); a reset on an included
    row starts again from 0.  decay: excluded rows add nothing but decay.
    """
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(rows):
        rows = rows.sort_values(order_by, kind="stable")
        n = len(rows)
        v, t = rows[x].to_numpy(float), rows[time].to_numpy(float)
        m = np.ones(n, bool) if include is None else rows[include].fillna(False).to_numpy(bool)
        r = np.zeros(n, bool) if reset is None else rows[reset].fillna(False).to_numpy(bool) & m
        out, e, last, fresh = np.zeros(n), 0.0, t[0] if n else 0.0, reset is None
        for i in range(n):
            if r[i]:
                e, last, fresh = 0.0, 0.0, False
            if kind == "decay":
                e = e * np.exp(-rate * (t[i] - last)) + (v[i] if m[i] else 0.0)
                last = t[i]
            elif m[i]:
                w = np.exp(-rate * (t[i] - last)) if t[i] >= last else 0.0
                e = v[i] if fresh and i == 0 else v[i] * (1 - w) + e * w
                last = t[i]
            out[i] = e
        return rows.assign(**{name: out})

    return df.groupBy(*keys).applyInPandas(run, schema)
