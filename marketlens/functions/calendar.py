"""Calendar helpers (fixed English names, F29)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month and ISO weekday names.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December")
MONTH_ABBR = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep",
              "Oct", "Nov", "Dec")
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
             "Saturday", "Sunday")


def _pick(names, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), idx.cast("int"))


def month_name(month: Column) -> Column:
    return _pick(MONTH_NAMES, month)


def month_abbr(month: Column) -> Column:
    return _pick(MONTH_ABBR, month)


def iso_dow(d: Column) -> Column:
    """ISO day of week, Monday = 1."""
    return F.weekday(d) + 1


def day_name(d: Column) -> Column:
    return _pick(DAY_NAMES, iso_dow(d))


def date_key(d: Column) -> Column:
    """yyyymmdd integer key."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def month_label(year: Column, month: Column) -> Column:
    """'Mon YYYY' label, e.g. 'Mar 1997'."""
    return F.concat(month_abbr(month), F.lit(" "), year.cast("string"))


def ym(year: Column, month: Column) -> Column:
    """yyyymm integer."""
    return (year * 100 + month).cast("int")
