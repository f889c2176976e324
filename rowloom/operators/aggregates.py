"""Grouped and whole-table aggregates with explicit treatment of invalid values."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.nulls import clean, invalid, strict
from rowloom.operators.lineage import cut

_PLAIN = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "var": F.var_samp, "std": F.stddev_samp}


def aggregate(kind: str, x: Column, skip: bool = False, floating: bool = True) -> Column:
    """sum, mean, min, max, var or std (ddof 1); strict unless ``skip``.

    The skipping sum of no valid value is 0; all other aggregates of none are NULL.
    """
    made = _PLAIN[kind](clean(x, floating))
    if not skip:
        return strict(made, x, floating)
    return F.coalesce(made, F.lit(0)) if kind == "sum" else made


def group_aggregate(df: DataFrame, keys: list[str], made: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in made.items()])


def first(x: Column, order: Column) -> Column:
    """The value of the first row, invalid or not."""
    return F.min_by(F.struct(x.alias("v")), order)["v"]


def last(x: Column, order: Column) -> Column:
    return F.max_by(F.struct(x.alias("v")), order)["v"]


def nth(df: DataFrame, keys: list[str], x: str, order_by: list, n: int, name: str = "nth") -> DataFrame:
    """The n-th row's value of each group (0-based; negative from the end), NULL where there is none."""
    forward = n >= 0
    order = [F.col(o) if forward else F.col(o).desc() for o in order_by]
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    wanted = (n if forward else -n - 1) + 1
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("__rn") == wanted, F.col(x))).alias(name))


def median(x: Column) -> Column:
    return F.median(clean(x))


def mode(x: Column, floating: bool = True) -> Column:
    """The most frequent valid value, the smallest of equals; ``floating=False`` for text and other types without NaN."""
    return F.mode(clean(x, floating), True)


def quantile_midpoint(x: Column, q: float) -> Column:
    """The mean of the two values around (n - 1) q, not an interpolation between them.

    It gathers the values of a group in one list, so it is for groups of bounded size inside other
    aggregates; :func:`quantile_midpoint_distributed` has no such bound.
    """
    n = F.count(clean(x))
    at = (n - 1) * F.lit(q)
    ordered = F.array_sort(F.collect_list(clean(x)))
    low, high = F.floor(at).cast("int") + 1, F.ceil(at).cast("int") + 1
    return F.when(n > 0, (F.element_at(ordered, F.greatest(low, F.lit(1))) + F.element_at(ordered, F.greatest(high, F.lit(1)))) / 2)


def mode_distributed(df: DataFrame, keys: list[str], x: str, name: str = "mode", floating: bool = True) -> DataFrame:
    """The same from pre-aggregated value counts, so a group's values never meet in one buffer; NULL for a group without any."""
    counts = df.select(*keys, clean(F.col(x), floating).alias(x)).groupBy(*keys, x).agg(F.count(x).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(x, F.when(F.col(x).isNotNull(), F.struct(-F.col("__n"), x))).alias(name))


def median_distributed(df: DataFrame, keys: list[str], x: str, name: str = "median") -> DataFrame:
    """The median by rank over pre-aggregated value counts."""
    return quantile_midpoint_distributed(df, keys, x, 0.5, name)


def _value_counts(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """__n for each valid value of a group; invalid rows are one NULL with none, so every group is there."""
    valid = df.select(*keys, clean(F.col(x)).alias(x))
    return valid.groupBy(*keys, x).agg(F.count(x).alias("__n"))


def _ranked_counts(df: DataFrame, keys: list[str], x: str, more: dict[str, Column] | None = None) -> DataFrame:
    """The value counts with ``__to``, the rows of the group up to the value, and ``__all``, those of the group.

    Values are dealt by ranges of (keys, value), so that the values of one group are shared among tasks: running sums stay inside a
    range and are shifted by the group's totals in the ranges before.  ``more`` are columns made of ``__all``, once per group and range.
    """
    counts = _value_counts(df, keys, x)
    placed = cut(counts.repartitionByRange(*keys, x).withColumn("__part", F.spark_partition_id()))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__part", *keys).agg(F.sum("__n").alias("__rows"))  # one row per group, and per range that one is cut by
    parts = parts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).withColumn("__all", F.sum("__rows").over(whole))
    named = {k: f"__key{i}" for i, k in enumerate(keys)}
    shifts = parts.withColumns(more or {}).select(
        F.col("__part").alias("__of"), *[F.col(k).alias(n) for k, n in named.items()], "__before", "__all", *(more or {}))
    met = F.col("__part") == F.col("__of")
    for k, n in named.items():
        met = met & F.col(k).eqNullSafe(F.col(n))
    inside = F.sum("__n").over(Window.partitionBy("__part", *keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("__inside", inside).join(shifts, met)
    return ranked.withColumn("__to", F.col("__before") + F.col("__inside")).drop("__part", "__of", *named.values(), "__before", "__inside")


def quantile_midpoint_distributed(df: DataFrame, keys: list[str], x: str, q: float, name: str = "quantile") -> DataFrame:
    """The same by rank instead of by list: pre-aggregated value counts, so a huge group never meets in one array.

    A group without a valid value gets NULL.
    """
    ranked = _ranked_counts(df, keys, x)
    at = (F.col("__all") - 1) * F.lit(q)

    def value(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__to") - F.col("__n")) & (rank < F.col("__to")), F.col(x)))

    return ranked.groupBy(*keys).agg(((value(F.floor(at)) + value(F.ceil(at))) / 2).alias(name))


#: Rate and confidence of the trimming rule (fixed values).
TRIM_RATE, TRIM_CONFIDENCE = 1e-4, 0.996


def trim_count(n: int) -> int:
    """Values to trim at each end of ``n``: the smallest k whose Poisson tail meets the confidence."""
    mean, k, total = n * TRIM_RATE, -1, 0.0
    while total < TRIM_CONFIDENCE:
        k += 1
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean else 1.0
    return k


def trim_limits(largest: int) -> list[int]:
    """limits[k] is the largest n that trims k values, up to ``largest``: the rule as a short step table."""
    limits, n = [], 0
    while n < largest:
        k, low, high = trim_count(n + 1), n + 1, largest
        while low < high:  # the last n with this k
            middle = (low + high + 1) // 2
            low, high = (middle, high) if trim_count(middle) == k else (low, middle - 1)
        limits += [n] * (k - len(limits)) + [low]
        n = low
    return limits


def _trim_counts(n: Column) -> Column:
    """:func:`trim_count` of a column; a step table of it grows with the largest group, and so would the work of each row that reads it."""

    @F.pandas_udf("long")
    def run(counts: pd.Series) -> pd.Series:
        count = functools.lru_cache(100_000)(trim_count)
        return pd.Series([count(int(v)) for v in counts], dtype="int64")

    return run(n)


def trimmed_mean(df: DataFrame, keys: list[str], x: str, name: str = "trimmed") -> DataFrame:
    """Mean of the values between the k-th smallest and the k-th largest; NULL where n <= 2 k."""
    ranked = _ranked_counts(df, keys, x, {"__k": _trim_counts(F.col("__all"))})
    # Ties of the bounds are kept: a value counts if any of its copies lies inside.
    inside = (F.col("__to") > F.col("__k")) & (F.col("__to") - F.col("__n") < F.col("__all") - F.col("__k"))
    kept = F.when(inside & F.col(x).isNotNull() & (F.col("__all") > 2 * F.col("__k")), F.col("__n"))
    mean = F.sum(F.col(x) * kept) / F.sum(kept)
    return ranked.groupBy(*keys).agg(mean.alias(name))


def reduce_all(df: DataFrame, x: str, ddof: int = 1) -> DataFrame:
    """One row with all whole-table reductions of a double column, strict and skipping."""
    c = F.col(x)
    v = clean(c)
    n = F.count(v)
    spread = lambda: F.var_pop(v) * n / (F.when(n > ddof, n - ddof))
    bad = F.bool_or(invalid(c))
    return df.agg(
        F.when(~bad, F.sum(v)).alias("sum"), F.coalesce(F.sum(v), F.lit(0.0)).alias("nansum"),
        F.when(~bad, F.avg(v)).alias("mean"), F.coalesce(F.avg(v), F.lit(0.0)).alias("nanmean"),
        F.when(~bad, spread()).alias("var"), spread().alias("nanvar"),
        F.when(~bad, F.sqrt(spread())).alias("std"), F.sqrt(spread()).alias("nanstd"),
        F.when(~bad, F.min(v)).alias("min"), F.min(v).alias("nanmin"),
        F.when(~bad, F.max(v)).alias("max"), F.max(v).alias("nanmax"),
    )


def arg_extremes(df: DataFrame, x: str, position: str) -> DataFrame:
    """Positions of the first minimum and maximum: invalid rows win in the plain form, are skipped in the other."""
    c = F.col(x)
    bad = invalid(c)
    key = F.when(~bad, c)
    at = F.col(position)
    return df.agg(
        F.min_by(at, F.struct((~bad).alias("a"), key.alias("b"), at.alias("c"))).alias("argmin"),
        F.min_by(at, F.struct((~bad).alias("a"), (-key).alias("b"), at.alias("c"))).alias("argmax"),
        F.min_by(at, F.when(~bad, F.struct(key.alias("b"), at.alias("c")))).alias("nanargmin"),
        F.min_by(at, F.when(~bad, F.struct((-key).alias("b"), at.alias("c")))).alias("nanargmax"),
    )
