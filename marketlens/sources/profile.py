"""Profiles of tables: rows, nulls, ranges, sums and rule violations per column.

The same aggregates are either observed while a table is written (no read of its own) or computed by one pass over a
table. A profile has one row per column:

table_name, column_name, position, rows, nulls, lowest, highest, total, nonpositive (numeric columns only),
violations (rows that break the column's rule, where it has one).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = "decimal(38,2)"
SCHEMA = ("table_name string, column_name string, position int, rows long, nulls long, "
          f"lowest {NUMBER}, highest {NUMBER}, total {NUMBER}, nonpositive long, violations long")


def differs(a: Column, b: Column) -> Column:
    """Amounts more than a cent apart."""
    return F.abs(a - b) > F.lit("0.01").cast("decimal(3,2)")


def subtotal_bad() -> Column:
    return differs(F.col("subtotal"), F.round(F.col("quantity") * F.col("unit_price"), 2))


# Rules by (table, column): a condition over the table's columns. A sale carries the sum of its lines as ``lines_total``
# while it is profiled.
RULES = {("sale_item", "subtotal"): subtotal_bad, ("sale", "total"): lambda: differs(F.col("total"), F.col("lines_total"))}
# Columns that a rule needs beside the table's own.
EXTRA = {"sale": ("lines_total",)}


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.DecimalType))


def measures(table: str, df: DataFrame) -> list[Column]:
    """Aggregates of a table, named by column position."""
    out = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema):
        x = F.col(f"`{f.name}`")
        out.append(F.count(F.when(x.isNull(), 1)).alias(f"nulls{i}"))
        if _is_number(f.dataType):
            out += [F.min(x).cast(NUMBER).alias(f"lowest{i}"), F.max(x).cast(NUMBER).alias(f"highest{i}"),
                    F.sum(x).cast(NUMBER).alias(f"total{i}"), F.count(F.when(x <= 0, 1)).alias(f"nonpositive{i}")]
        if (table, f.name) in RULES:
            out.append(F.count(F.when(RULES[table, f.name](), 1)).alias(f"violations{i}"))
    return out


_PARTS = ("nulls", "lowest", "highest", "total", "nonpositive", "violations")


def columns_of(table: str, df: DataFrame) -> list[tuple[int, str]]:
    return [(i, c) for i, c in enumerate(df.columns) if c not in EXTRA.get(table, ())]


def rows_of(table: str, df: DataFrame, values: dict) -> list[tuple]:
    """Profile rows from observed ``measures``."""
    return [(table, c, i, values["rows"], *[values.get(f"{p}{i}") for p in _PARTS]) for i, c in columns_of(table, df)]


def profile_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def profile_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Profile of tables as they are: one aggregate pass a table."""
    parts = []
    for t, df in tables.items():
        if t == "sale" and "lines_total" not in df.columns and "sale_item" in tables:
            df = with_lines_total(df, tables["sale_item"])
        row = df.agg(*measures(t, df))
        have = set(row.columns)
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                                   *[(F.col(f"{p}{i}") if f"{p}{i}" in have else F.lit(None)).cast(
                                       NUMBER if p in ("lowest", "highest", "total") else "long").alias(p) for p in _PARTS])
                          for i, c in columns_of(t, df)])
        parts.append(row.select(F.lit(t).alias("table_name"), "rows", F.inline(cells))
                     .select("table_name", "column_name", "position", "rows", *_PARTS))
    return reduce(DataFrame.unionByName, parts)


def with_lines_total(sale: DataFrame, sale_item: DataFrame) -> DataFrame:
    return sale.join(sale_item.groupBy("sale_id").agg(F.sum("subtotal").alias("lines_total")), "sale_id", "left") \
        .select(*sale.columns, "lines_total")
