"""Missing values: NULL and NaN are both invalid.

Every aggregate comes in two forms.  The skipping form works on ``clean(x)``, in which NaN is NULL; the
strict form gives NULL as soon as one row is invalid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def invalid(x: Column, floating: bool = True) -> Column:
    return (x.isNull() | F.isnan(x)) if floating else x.isNull()


def clean(x: Column, floating: bool = True) -> Column:
    """``x`` with NaN turned into NULL."""
    return F.when(~F.isnan(x), x) if floating else x


def strict(aggregate: Column, x: Column, floating: bool = True) -> Column:
    """NULL if any row of the group is invalid, else the aggregate."""
    return F.when(~F.bool_or(invalid(x, floating)), aggregate)
