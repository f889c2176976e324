"""Sums and products over the rows of the last ``delta`` time units before each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def time_window(df: DataFrame, keys: list[str], time: str, row: str, x: str, delta: int, kind: str = "sum", name: str = "window") -> DataFrame:
    """Over the row itself and all earlier rows at most ``delta`` back; ties in time count by row order.

    ``time`` and ``delta`` are whole numbers.  The window is made of two frames, the rows of earlier times and those of the same time
    up to the row, so nothing is subtracted: later rows of the same time don't enter, and a product of whole numbers is exact up to 2^53.
    """
    before = Window.partitionBy(*keys).orderBy(time).rangeBetween(-delta, -1)
    tied = Window.partitionBy(*keys, time).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    made = (F.sum if kind == "sum" else F.product)(F.col(x))
    first, second = made.over(before), made.over(tied)
    both = first + second if kind == "sum" else first * second
    return df.withColumn(name, F.when(first.isNull(), second).when(second.isNull(), first).otherwise(both))
