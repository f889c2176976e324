"""Element-wise arithmetic, comparison and strings, guarded so that ANSI mode never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF, _NAN = float("inf"), float("nan")


def negative_zero(x: Column) -> Column:
    return (x == 0) & (x.cast("string") == "-0.0")


def divide(x: Column, y: Column) -> Column:
    """IEEE division: x / 0 is an infinity by the signs of both, 0 / 0 is NaN."""
    x, y = x.cast("double"), y.cast("double")
    signed = F.when(negative_zero(y), -x).otherwise(x)
    by_zero = F.when(signed > 0, _INF).when(signed < 0, -_INF).otherwise(_NAN)
    return F.when(y.isNull() | x.isNull(), None).when(y == 0, F.when(F.isnan(x), _NAN).otherwise(by_zero)).otherwise(x / F.when(y != 0, y))


#: Beyond it every double is whole, and Spark's floor, which gives a BIGINT, would saturate in the end.
_WHOLE = float(1 << 53)


def floor(x: Column) -> Column:
    """The floor as a double; NaN, infinities and the sign of a zero stay."""
    x = x.cast("double")
    return F.when((x >= 0) & (x < 1), x * 0.0).when(F.abs(x) < _WHOLE, F.floor(x).cast("double")).otherwise(x)


def ceil(x: Column) -> Column:
    """The ceiling as a double, which is minus zero between -1 and 0."""
    x = x.cast("double")
    return F.when((x > -1) & (x <= 0), x * 0.0).when(F.abs(x) < _WHOLE, F.ceil(x).cast("double")).otherwise(x)


def floor_divide(x: Column, y: Column, floating: bool = False) -> Column:
    """Division towards minus infinity.

    Whole numbers give a BIGINT, zero where the divisor is zero; with ``floating`` it is the floor of the
    IEEE quotient, a double.
    """
    if floating:
        return floor(divide(x, y))
    q = F.when(y != 0, F.floor((x - F.pmod(x, F.abs(F.when(y != 0, y)))) / F.when(y != 0, y)))
    exact = F.floor(x.cast("double") / F.when(y != 0, y))
    return F.when(y == 0, F.lit(0)).when(x.isNull() | y.isNull(), None).otherwise(F.coalesce(F.when(y > 0, q), exact)).cast("long")


def modulo(x: Column, y: Column) -> Column:
    """The remainder with the sign of the dividend; NULL where the divisor is zero."""
    return x % F.when(y != 0, y)


def fmod(x: Column, y: Column) -> Column:
    """The remainder of doubles with the sign of the dividend; NaN where the divisor is zero."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y == 0, F.when(x.isNotNull(), _NAN)).otherwise(x % F.when(y != 0, y))


def remainder(x: Column, y: Column, floating: bool = False) -> Column:
    """x - y * floor(x / y); a divisor of zero gives NULL, and NaN with ``floating``."""
    if floating:
        x, y = x.cast("double"), y.cast("double")
        return F.when((y == 0) & x.isNotNull(), _NAN).otherwise(x - y * floor(divide(x, y)))
    y = F.when(y != 0, y)
    return x - y * F.floor(x / y)


def minimum(x: Column, y: Column) -> Column:
    """The smaller value; NaN on either side passes through."""
    return F.when(F.isnan(x) | F.isnan(y), _NAN).when(x.isNull() | y.isNull(), None).otherwise(F.least(x, y))


def maximum(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), _NAN).when(x.isNull() | y.isNull(), None).otherwise(F.greatest(x, y))


def subtract_times(a: Column, b: Column) -> Column:
    """Difference of two nanosecond times as a double; zero and NULL are invalid times."""
    return F.when((a != 0) & (b != 0), (a - b).cast("double"))


def subtract_dates(a: Column, b: Column) -> Column:
    """Difference in days; zero where a date is missing."""
    return F.coalesce(F.datediff(a, b), F.lit(0))


def equal(x: Column, y: Column) -> Column:
    """IEEE equality: NaN equals nothing."""
    return (x == y) & ~F.isnan(x) & ~F.isnan(y)


def less(x: Column, y: Column) -> Column:
    return (x < y) & ~F.isnan(x) & ~F.isnan(y)


def less_equal(x: Column, y: Column) -> Column:
    return (x <= y) & ~F.isnan(x) & ~F.isnan(y)


def not_equal(x: Column, y: Column) -> Column:
    """True where either side is NaN."""
    return ~equal(x, y)


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up; what rounds to zero keeps its sign."""
    made = F.round(x, digits)
    return F.when(made == 0, x * 0.0).otherwise(made)


def truncate(x: Column) -> Column:
    """Towards zero, as a double; NaN and infinities stay."""
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def log(x: Column, base: str = "e") -> Column:
    """Logarithm by IEEE rules: -inf at zero, NaN below."""
    f = {"e": F.ln, "2": F.log2, "10": F.log10}[base]
    return F.when(x == 0, -_INF).when(x < 0, _NAN).otherwise(f(x))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != _INF)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == _INF


def is_normal(x: Column) -> Column:
    return is_finite(x) & (F.abs(x) >= F.lit(2.2250738585072014e-308))


def sign_bit(x: Column) -> Column:
    return (x < 0) | negative_zero(x)


def strip_right(x: Column) -> Column:
    """Without trailing blanks and NUL characters."""
    return F.regexp_replace(x, r"[ \x00]+$", "")


def crc64(x: Column) -> Column:
    """64-bit ECMA checksum of a binary value, as a signed long."""

    @F.pandas_udf("long")
    def run(values):
        import pandas as pd

        return pd.Series([_crc64(v) for v in values])

    return run(x)


def _crc64_table() -> list[int]:
    """Made from the reflected ECMA-182 polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ 0xC96C5795D7870F42 if i & 1 else i >> 1
        table.append(i)
    return table


_TABLE = _crc64_table()


def _crc64(value: bytes | None) -> int | None:
    if value is None:
        return None
    crc = (1 << 64) - 1
    for b in value:
        crc = _TABLE[(crc ^ b) & 255] ^ (crc >> 8)
    crc ^= (1 << 64) - 1
    return crc - (1 << 64) if crc >> 63 else crc
