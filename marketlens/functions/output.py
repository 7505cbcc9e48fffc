"""Result typing: BIGINT / DOUBLE / STRING / DATE / BOOLEAN only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finalize(df: DataFrame) -> DataFrame:
    """Cast decimals and floats to DOUBLE and narrow integers to BIGINT.

    Decimals are exact up to here; the cast happens once, on the result.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def attach(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Add the columns of one-row results (global aggregates) to every row of ``df``.

    Each column becomes a scalar subquery: computed once, merged with the other
    subqueries over the same plan, and read as a constant; no join, no pairs.
    Use as ``df.transform(attach, totals)``.
    """
    cols = [r.select(F.col(f"`{c}`")).scalar().alias(c) for r in one_row for c in r.columns]
    return df.select("*", *cols)
