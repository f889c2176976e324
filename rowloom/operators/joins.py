"""Membership with match position, lookups and as-of alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.nulls import invalid


def is_member(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], position: str, null_safe: bool = False) -> DataFrame:
    """``left`` with ``found`` and ``position`` of the first match in ``right``.

    The haystack is reduced to one row per key first, so repeated keys multiply nothing.  NaN matches
    nothing; NULL matches NULL only if ``null_safe``.
    """
    names = [f"__r{i}" for i in range(len(right_keys))]
    firsts = right.groupBy(*[F.col(k).alias(n) for k, n in zip(right_keys, names, strict=True)]).agg(F.min(position).alias("__pos"))
    met = F.lit(True)
    for k, n in zip(left_keys, names, strict=True):
        same = F.col(k).eqNullSafe(F.col(n)) if null_safe else F.col(k) == F.col(n)
        if left.schema[k].dataType.simpleString() in ("double", "float"):
            same = same & ~F.isnan(F.col(k))
        met = met & same
    joined = left.join(firsts, met, "left")
    return joined.withColumns({"found": F.col("__pos").isNotNull(), "position": F.col("__pos")}).drop("__pos", *names)


def gather(index: DataFrame, values: DataFrame, i: str, position: str, value: str, n: Column | int, default: Column | None = None, name: str = "value") -> DataFrame:
    """The value at each index; negative indexes count from the end, others outside give the default."""
    place = F.when(F.col(i) < 0, F.col(i) + n).otherwise(F.col(i))
    found = values.select(F.col(position).alias("__pos"), F.col(value).alias("__value"), F.lit(True).alias("__hit"))
    joined = index.withColumn("__at", place).join(found, F.col("__at") == F.col("__pos"), "left")
    miss = default if default is not None else F.lit(None)
    return joined.withColumn(name, F.when(F.col("__hit"), F.col("__value")).otherwise(miss)).drop("__at", "__pos", "__value", "__hit")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, left_id: str, right_id: str, forward: bool = False, exact: bool = True, name: str = "match") -> DataFrame:
    """Per left row the id of the last right row at or before it (forward: the first at or after it).

    Both sides are laid over each other and sorted once by key and value; a running last picks the match.
    Ties take the last right row backward and the first forward.  Invalid left values match nothing,
    invalid right values are left out.
    """
    wrong = lambda df, c: invalid(F.col(c), df.schema[c].dataType.simpleString() in ("double", "float"))
    lhs = left.select(*keys, F.col(left_on).alias("__v"), F.lit(None).cast(right.schema[right_id].dataType).alias("__rid"), F.col(left_id).alias("__lid"), F.lit(1).alias("__left"), wrong(left, left_on).alias("__bad"))
    rhs = right.filter(~wrong(right, right_on)).select(
        *keys, F.col(right_on).alias("__v"), F.col(right_id).alias("__rid"), F.lit(None).cast(left.schema[left_id].dataType).alias("__lid"), F.lit(0).alias("__left"), F.lit(False).alias("__bad"))
    side = F.col("__left") if exact else -F.col("__left")
    v, rid = (F.col("__v").desc(), F.col("__rid").desc()) if forward else (F.col("__v"), F.col("__rid"))
    w = Window.partitionBy(*keys).orderBy(v, side, rid).rowsBetween(Window.unboundedPreceding, 0)
    met = lhs.unionByName(rhs).withColumn(name, F.last("__rid", ignorenulls=True).over(w)).filter("__left = 1")
    return met.select(*keys, F.col("__lid").alias(left_id), F.when(~F.col("__bad"), F.col(name)).alias(name))


def semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def is_member_categorical(left: DataFrame, codes: DataFrame, categories: DataFrame, code: str) -> DataFrame:
    """Membership through dictionaries: ``codes`` (code, label) are the left side's categories, matched once
    against ``categories`` (label, position) and lifted to the rows."""
    matched = codes.join(categories.groupBy("label").agg(F.min("position").alias("position")), "label", "left")
    lifted = left.join(matched.select(F.col("code").alias(code), "position"), code, "left")
    return lifted.withColumn("found", F.col("position").isNotNull())


def set_items(df: DataFrame, position: str, value: str, items: DataFrame, name: str = "value") -> DataFrame:
    """``df`` with the values of ``items`` (position, new) put in at their positions; the last one given wins."""
    last = items.groupBy(F.col(position).alias("__at")).agg(F.max_by(F.struct("new"), "order").alias("__new"))
    joined = df.join(last, F.col(position) == F.col("__at"), "left")
    return joined.withColumn(name, F.when(F.col("__at").isNotNull(), F.col("__new.new")).otherwise(F.col(value))).drop("__at", "__new")


def apply_groups(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """Any function of a group's rows, as pandas; the group must fit one task."""
    return df.groupBy(*keys).applyInPandas(function, schema)
