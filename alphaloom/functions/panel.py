"""The functions of a row and of a date's symbols as columns over a dense panel (date, t: number of the date, symbol, fields), null being the missing value.

Division by zero and other results that aren't finite are null. Functions over a symbol's dates are in rolling.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

def by_date():
    return Window.partitionBy("date")


TINY = 1e-8


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.abs(x) < float("inf"), x)  # NaN is larger than any number


def rounded(x: Column, places: int = 6) -> Column:
    """Half away from zero by binary arithmetic, which other engines repeat to the bit."""
    unit = 10.0**places
    return (F.when(x >= 0, F.floor(x * unit + 0.5)).otherwise(-F.floor(-x * unit + 0.5)) / unit).cast("double")


def rank(x: Column) -> Column:
    """Average rank from low to high among the date's values, as a share of their number."""
    order = by_date().orderBy(x.asc_nulls_last())
    ties = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / 2) / F.count(x).over(by_date()))


def zscore(x: Column) -> Column:
    sd = F.stddev_samp(x).over(by_date())
    return (x - F.avg(x).over(by_date())) / F.when(sd == 0, TINY).otherwise(sd)


def scale(x: Column, a: float) -> Column:
    total = F.sum(F.abs(x)).over(by_date())
    return x / F.when(total == 0, TINY).otherwise(total) * a


def _both(x: Column, y: Column, value: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), value)


ROW: dict[str, Callable[..., Column]] = {
    "sign": lambda x: F.signum(x),
    "log": lambda x: F.when(x > 0, F.ln(x)),
    "abs": lambda x: F.abs(x),
    "power": lambda x, a: finite(F.pow(x, F.lit(a))),
    "signed_power": lambda x, a: finite(F.signum(x) * F.pow(F.abs(x), F.lit(a))),
    "min": lambda x, y: _both(x, y, F.least(x, y)),
    "max": lambda x, y: _both(x, y, F.greatest(x, y)),
    "clip": lambda x, low, high: F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x))),
    "neg": lambda x: -x,
    "+": lambda x, y: x + y,
    "-": lambda x, y: x - y,
    "*": lambda x, y: x * y,
    "/": lambda x, y: F.try_divide(x, y),
    "**": lambda x, y: finite(F.pow(x, y)),
}
CROSS_SECTION: dict[str, Callable[..., Column]] = {"rank": rank, "zscore": zscore, "scale": scale}
