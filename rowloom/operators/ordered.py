"""Global order without a single partition.

A window without PARTITION BY sends all rows to one task.  Here rows are range-partitioned by the order
columns, numbered inside their partition, and shifted by the totals of the partitions before; windows
over the global order then run in blocks of positions, each with a copy of the rows that its first
windows reach back to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.lineage import cut

#: Positions in a block of an ungrouped window.
BLOCK = 100_000
_LOCAL = (1 << 33) - 1


def with_position(df: DataFrame, order_by: list, name: str = "position") -> DataFrame:
    """``df`` with the 0-based position in the global order, which must be total to be repeatable."""
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = cut(ranged.withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(_LOCAL))
    # One row per partition; the partition count is set by the plan.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    offsets = F.broadcast(sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")))
    return placed.join(offsets, "__part").withColumn(name, F.col("__offset") + F.col("__at")).drop("__id", "__part", "__at", "__rows", "__offset")


def windowed(df: DataFrame, order_by: list, reach: int, make: Callable[[Window], dict[str, Column]], ahead: int = 0) -> DataFrame:
    """Columns over an ungrouped window that reaches ``reach`` rows back and ``ahead`` rows forward.

    ``make`` gets the window (ordered, partitioned by block) and returns the new columns.
    """
    size = max(BLOCK, reach + ahead + 1)
    rows = with_position(df, order_by, "__pos").withColumn("__own", F.floor(F.col("__pos") / size))
    inside = F.col("__pos") % size
    blocks = F.array_compact(F.array(
        F.col("__own"),
        F.when(inside >= size - reach, F.col("__own") + 1) if reach else F.lit(None).cast("long"),
        F.when((inside < ahead) & (F.col("__own") > 0), F.col("__own") - 1) if ahead else F.lit(None).cast("long"),
    ))
    rows = rows.withColumn("__block", F.explode(blocks))
    made = rows.withColumns(make(Window.partitionBy("__block").orderBy("__pos")))
    return made.filter(F.col("__block") == F.col("__own")).drop("__pos", "__own", "__block")
