"""Group ids in order of first occurrence, unique rows, neighbours and counts of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.ordered import BLOCK, with_position


def group_ids(
    df: DataFrame, keys: list[str], row: str, keep: Column | None = None, name: str = "group_id", start: int = 1, parts: list[str] | None = None
) -> DataFrame:
    """``df`` with the id of each row's group, counted from ``start`` by first occurrence; filtered rows get 0.

    Ids are made on the distinct keys, through range partitions of the first rows, and joined back.  With
    ``parts`` each part of the table is grouped on its own: ids and first rows start again in each.
    """
    keys = [*(parts or []), *keys]
    kept = df if keep is None else df.filter(keep)
    firsts = kept.groupBy(*keys).agg(F.min(row).alias("first_row"))
    if parts:
        placed = firsts.withColumn("__n", F.row_number().over(Window.partitionBy(*parts).orderBy("first_row")).cast("long") - 1)
    else:
        placed = with_position(firsts, ["first_row"], "__n")
    numbered = placed.select(*[F.col(k).alias(f"__{k}") for k in keys], "first_row", (F.col("__n") + start).alias(name))
    met = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = df.join(numbered, met, "left").drop(*[f"__{k}" for k in keys])
    return joined.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def rolling_state(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """What a rolling grouping knows at each row: ``bin`` (from 0, by first occurrence), ``running`` rows of the key so
    far, this one counted, and ``uniques`` so far.

    Uniques are a running maximum of the bins: inside blocks of ``BLOCK`` rows, then over the maxima of the blocks before.
    """
    rows = with_position(group_ids(df, keys, row, name="bin", start=0), [row], "__pos").withColumn("__block", F.floor(F.col("__pos") / BLOCK))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row per BLOCK rows
    earlier = rows.groupBy("__block").agg(F.max("bin").alias("__top")).select("__block", F.max("__top").over(before).alias("__before"))
    inside = Window.partitionBy("__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__inside", F.max("bin").over(inside)).join(earlier, "__block")
    rows = rows.withColumn("uniques", F.greatest("__before", "__inside") + 1)
    rows = rows.withColumn("running", F.row_number().over(Window.partitionBy(*keys).orderBy(row)).cast("long"))
    return rows.drop("__pos", "__block", "__before", "__inside")


def sorted_group_ids(df: DataFrame, keys: list[str], name: str = "group_id", keep: Column | None = None, start: int = 1) -> DataFrame:
    """Ids in the order of the keys, counted from ``start``; filtered rows get 0."""
    kept = df if keep is None else df.filter(keep)
    distinct = with_position(kept.select(*keys).distinct(), keys, "__n")
    numbered = distinct.select(*[F.col(k).alias(f"__{k}") for k in keys], (F.col("__n") + start).alias(name))
    met = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = df.join(numbered, met, "left").drop(*[f"__{k}" for k in keys])
    return joined.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def unique_rows(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The first row of each key."""
    return df.groupBy(*keys).agg(F.min(row).alias("first_row"))


def neighbours(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """``df`` with the next and the previous row of the same group."""
    w = Window.partitionBy(*keys).orderBy(row)
    return df.withColumns({"next_row": F.lead(row).over(w), "prev_row": F.lag(row).over(w)})


def bin_count(df: DataFrame, key: str, bins: int) -> DataFrame:
    """Rows in each of the bins 0 to ``bins``, empty ones too, and where each starts when packed.

    Starts are running sums inside blocks of ``BLOCK`` bins, shifted by the totals of the blocks before.
    """
    counts = df.groupBy(F.col(key).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins + 1).withColumnRenamed("id", "bin")
    filled = every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    filled = filled.withColumn("__block", F.floor(F.col("bin") / BLOCK))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    blocks = filled.groupBy("__block").agg(F.sum("n").alias("n"))  # one row per 100,000 bins
    offsets = blocks.select("__block", before(Window.orderBy("__block")).alias("__offset"))
    inside = filled.withColumn("__inside", before(Window.partitionBy("__block").orderBy("bin")))
    return inside.join(offsets, "__block").select("bin", "n", (F.col("__inside") + F.col("__offset")).alias("first"))


def pack(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows clustered by group: the place of each row in its group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(row)) - 1)


def first_last_rows(df: DataFrame, key: str, row: str, keep: Column) -> DataFrame:
    """First and last kept row of each bin; bin 0 is left out."""
    return df.filter(keep & (F.col(key) != 0)).groupBy(key).agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"))


def combine_bins(a: Column, b: Column, multiplier: int, highest: int, keep: Column) -> Column:
    """Bin of two categories: b * multiplier + a, 0 where filtered, out of range or either is 0."""
    made = b * multiplier + a
    ok = keep & (a > 0) & (b > 0) & (made <= highest)
    return F.when(F.coalesce(ok, F.lit(False)), made).otherwise(F.lit(0))


def remap(df: DataFrame, key: str, mapping: DataFrame, name: str) -> DataFrame:
    """``df`` with the key's entry in ``mapping`` (columns code, new); 0 where there is none."""
    return df.join(mapping, F.col(key) == F.col("code"), "left").drop("code").withColumn(name, F.coalesce("new", F.lit(0))).drop("new")


def combine_filter(df: DataFrame, bin_col: str, row: str, keep: Column, name: str = "bin") -> tuple[DataFrame, DataFrame]:
    """The rows with new numbers for the bins that survive a filter, and the new bins' first rows and counts.

    Bins are numbered from 1 by their first row that is kept; rows that the filter or bin 0 leaves out get 0.
    """
    alive = F.coalesce(keep & (F.col(bin_col) > 0), F.lit(False))
    numbered = group_ids(df, [bin_col], row, alive, "__new").drop("first_row")
    numbered = numbered.withColumn(name, F.when(alive, F.col("__new")).otherwise(F.lit(0).cast("long"))).drop("__new")
    bins = numbered.filter(F.col(name) > 0).groupBy(name).agg(F.min(row).alias("first_row"), F.count(F.lit(1)).alias("count"))
    return numbered, bins


def merge_codes(df: DataFrame, categories: DataFrame, part: str, code: str, label: str, name: str = "merged") -> DataFrame:
    """The category codes of stacked parts (files) as codes of one common list.

    ``categories`` has the (part, code, label) of every part.  Labels are numbered from 1 by their first
    occurrence in the order of parts and codes; a code that its part doesn't list becomes 0.
    """
    listed = categories.select(part, code, label).withColumn("__at", F.struct(part, code))
    numbered = group_ids(listed, [label], "__at", name="__new").select(F.col(part).alias("__part"), F.col(code).alias("__code"), "__new")
    joined = df.join(numbered, (F.col(part) == F.col("__part")) & (F.col(code) == F.col("__code")), "left")
    return joined.withColumn(name, F.coalesce("__new", F.lit(0).cast("long"))).drop("__part", "__code", "__new")
