"""The common type of columns that are stacked or combined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import types as T

_INTEGERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def upcast(a: T.DataType, b: T.DataType) -> T.DataType:
    """The smallest type that holds both: strings over floats over integers over booleans.

    A 32-bit float meets an integer wider than 16 bits as a double.
    """
    if a == b:
        return a
    if T.StringType() in (a, b):
        return T.StringType()
    if isinstance(a, T.BooleanType):
        return b
    if isinstance(b, T.BooleanType):
        return a
    kinds = {type(a), type(b)}
    if T.DoubleType in kinds:
        return T.DoubleType()
    if T.FloatType in kinds:
        return T.DoubleType() if kinds & {T.IntegerType, T.LongType} else T.FloatType()
    if kinds <= set(_INTEGERS):
        return _INTEGERS[max(map(_INTEGERS.index, kinds))]()
    if kinds <= {*_INTEGERS, T.DecimalType}:
        return T.DecimalType(20, 0)
    raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")


def common_type(types: list[T.DataType]) -> T.DataType:
    return reduce(upcast, types)
