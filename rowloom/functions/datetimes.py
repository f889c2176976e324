"""Text to nanoseconds, as BIGINT: Spark's timestamps end at microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_A_DAY = 86_400_000_000_000
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?"
_DATE = r"(\d{4})-?(\d{2})-?(\d{2})"


def _part(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).try_cast("long")


def time_nanos(text: Column) -> Column:
    """``H:MM[:SS[.fraction]]`` to nanoseconds since midnight; 0 if it can't be read or is out of range."""
    hours = F.substring_index(text, ":", 1)
    rest = F.substring(text, F.length(hours) + 2, F.lit(15))  # MM:SS.fraction
    h, m = hours.try_cast("long"), _part(rest, 1, 2)
    s, fraction = F.coalesce(_part(rest, 4, 2), F.lit(0).cast("long")), F.rpad(F.substring(rest, 7, 9), 9, "0").try_cast("long")
    made = ((h * 60 + m) * 60 + s) * 1_000_000_000 + F.coalesce(fraction, F.lit(0))
    return F.coalesce(F.when(text.rlike(f"^{_TIME}\\z") & (h < 24) & (m < 60) & (s < 60), made), F.lit(0).cast("long"))


def date_nanos(text: Column) -> Column:
    """``YYYYMMDD`` or ``YYYY-MM-DD`` to nanoseconds since 1970; 0 outside 1970 to 2099.

    Days up to 31 are taken in any month and run over into the next one.
    """
    digits = F.replace(text, F.lit("-"), F.lit(""))
    y, m, d = _part(digits, 1, 4), _part(digits, 5, 2), _part(digits, 7, 2)
    ok = text.rlike(f"^{_DATE}\\z") & y.between(1970, 2099) & m.between(1, 12) & d.between(1, 31)
    first = F.make_date(F.when(ok, y).cast("int"), F.when(ok, m).cast("int"), F.lit(1))
    return F.coalesce((F.unix_date(first) + d - 1).cast("long") * NANOS_A_DAY, F.lit(0).cast("long"))


def datetime_nanos(text: Column) -> Column:
    """A date, then ``T`` or a space, then a time; a bad time keeps the date."""
    day = F.regexp_extract(text, r"^(\d{4}-?\d{2}-?\d{2})(?:[T ].*)?\z", 1)
    date = date_nanos(day)
    return F.when(date == 0, F.lit(0).cast("long")).otherwise(date + time_nanos(F.substring(text, F.length(day) + 2, F.lit(40))))


#: strptime directives and the Spark patterns that read the same (fixed values).
_DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%j": "DDD",
               "%e": "d", "%h": "MMM", "%I": "hh", "%p": "a", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%D": "MM/dd/yy"}


def strptime_nanos(text: Column, pattern: str) -> Column:
    """Text by a strptime pattern, with an optional fraction of seconds after it; 0 if it fails.

    A directive outside ``_DIRECTIVES`` raises ValueError when the column is made.
    """
    spark, i = "", 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in _DIRECTIVES:
            spark, i = spark + _DIRECTIVES[two], i + 2
        elif two == "%%":
            spark, i = spark + "%", i + 2
        elif two[0] == "%":
            raise ValueError(f"unknown directive {two}")
        else:
            spark, i = spark + (f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]), i + 1
    fraction = F.regexp_extract(text, r"\.(\d{1,9})\z", 1)
    whole = F.regexp_replace(text, r"\.\d{1,9}\z", "")
    # A zone of its own makes the result the same in any session's zone.
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(whole, F.lit(" +0000")), F.lit(spark + " xx")))
    return F.coalesce(seconds * 1_000_000_000 + F.coalesce(F.rpad(fraction, 9, "0").try_cast("long"), F.lit(0)), F.lit(0).cast("long"))


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp's wall clock, whatever the session's time zone."""
    minutes = (F.unix_date(ts.cast("date")).cast("long") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
