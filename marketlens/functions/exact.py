"""Exact decimal arithmetic helpers.

Money stays DECIMAL(18,2) and every rounded ratio is computed with integer
arithmetic (``div``), rounding half away from zero, so results do not depend
on floating point or on the engine's decimal division precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c) -> Column:
    return F.col(c).cast(MONEY) if isinstance(c, str) else c.cast(MONEY)


def _as_int(c: Column, shift: int) -> Column:
    return (c * F.lit(10 ** shift)).cast("decimal(38,0)")


def round_div(num: Column, den: Column, scale: int, shift: int = 4) -> Column:
    """round(num / den, scale), half away from zero; null when den is 0 or null.

    ``num`` and ``den`` are exact numbers (integers or decimals with at most
    ``shift`` fraction digits); both are scaled by 10**shift to integers.
    """
    n = _as_int(num, shift)
    d = _as_int(den, shift)
    d = F.when(d != 0, d)
    an, ad = F.abs(n), F.abs(d)
    q = F.call_function("div", an * F.lit(2 * 10 ** scale) + ad, ad * F.lit(2))
    signed = F.when((n < 0) != (d < 0), -q).otherwise(q)
    return (signed.cast("decimal(18,0)") * F.lit(10 ** -scale if scale else 1)
            .cast(f"decimal({scale + 1},{scale})")).cast(f"decimal(18,{scale})")


def ratio(num: Column, den: Column) -> Column:
    """Unrounded ratio as DOUBLE: double(num) / double(den), null when den is 0."""
    d = den.cast("double")
    return num.cast("double") / F.when(d != 0, d)


def mean(c: Column) -> Column:
    """Average as double(sum) / count: exact sum, one IEEE division."""
    return ratio(F.sum(c), F.count(c))


def pct(num: Column, den: Column, scale: int = 2) -> Column:
    """round(num / den * 100, scale) exactly."""
    return round_div(num * F.lit(100), den, scale)
