"""Null-safe arithmetic: ratios, percent change, half-even rounding.

Spark 4 runs with ANSI mode on, so a plain ``/`` by zero raises.  Every
ratio goes through ``try_divide`` and yields null where the reproduced
system produced NaN or +-Inf (those serialise to null there as well).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column) -> Column:
    """``num / den * 100`` (null when ``den`` is 0 or null)."""
    return ratio(num, den) * F.lit(100.0)


def pct_of(num: Column, den: Column) -> Column:
    """``100 * num / den`` (multiplication first; differs from :func:`pct`
    in the last bit, and the reproduced reports use both orders)."""
    return ratio(F.lit(100.0) * num.cast("double"), den)


def pct_change(start: Column, end: Column) -> Column:
    """``100 * (end - start) / start``."""
    return pct_of(end - start, start)


def round_even(x: Column, dp: int = 1) -> Column:
    """Round half to even at ``dp`` decimals (numpy's rounding)."""
    if dp == 0:
        return F.rint(x)
    scale = float(10 ** dp)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def clip0(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))
