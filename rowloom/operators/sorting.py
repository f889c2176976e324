"""Stable multi-key sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.nulls import clean
from rowloom.operators.ordered import with_position


def sort_keys(df: DataFrame, keys: list[str], ascending: list[bool], row: str) -> list[Column]:
    """Sort columns with the last key first; NaN and NULL of doubles come last in both directions; ties by row."""
    out = []
    for k, up in reversed(list(zip(keys, ascending, strict=True))):
        c = clean(F.col(k)) if df.schema[k].dataType.simpleString() in ("double", "float") else F.col(k)
        out.append(c.asc_nulls_last() if up else c.desc_nulls_last())
    return [*out, F.col(row)]


def lexsort(df: DataFrame, keys: list[str], ascending: list[bool], row: str, name: str = "rank") -> DataFrame:
    """``df`` with each row's place in the stable sort; the last key is the primary one."""
    return with_position(df, sort_keys(df, keys, ascending, row), name)


def partition_sort(df: DataFrame, parts: list[str], keys: list[str], ascending: list[bool], row: str, name: str = "rank") -> DataFrame:
    """The place inside each partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(*sort_keys(df, keys, ascending, row))) - 1)


def reverse_permutation(df: DataFrame, index: str, row: str) -> DataFrame:
    """out[in[i]] = i, as (pos, value)."""
    return df.select(F.col(index).alias("pos"), F.col(row).alias("value"))
