"""Repairs (R): column rewrites as DataFrame expressions; customers are never deleted.

A repair returns the corrected table; nothing is updated in place. The order
matters only for R03, which sums the subtotals already corrected by R02.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import MONEY
from ..sources.profile import differs, subtotal_bad
from .quality import repaired_prices


def repair_price(product: DataFrame, central_product: DataFrame, target_margin: str = "0.40",
                 product_ids=None) -> DataFrame:
    """Price := round(cost / (1 - margin), 2) for the listed products."""
    fixed = repaired_prices(product, central_product, target_margin, product_ids)
    return product.join(fixed.select("product_id", "new_price"), "product_id", "left").select(
        *[F.coalesce(F.col("new_price"), F.col("price")).cast(MONEY).alias("price") if c == "price"
          else F.col(c) for c in product.columns])


def repair_line_subtotal(sale_item: DataFrame) -> DataFrame:
    """Subtotal := round(quantity * unit_price, 2) where it differs by more than 0.01."""
    fixed = F.round(F.col("quantity") * F.col("unit_price"), 2).cast(MONEY)
    return sale_item.select(*[F.when(subtotal_bad(), fixed).otherwise(F.col("subtotal")).alias("subtotal")
                              if c == "subtotal" else F.col(c) for c in sale_item.columns])


def repair_order_total(sale: DataFrame, repaired_items: DataFrame) -> DataFrame:
    """Total := round(sum of repaired subtotals, 2) where it differs by more than 0.01."""
    sums = repaired_items.groupBy("sale_id").agg(F.round(F.sum("subtotal"), 2).cast(MONEY).alias("_sum"))
    j = sale.join(sums, "sale_id", "left")
    bad = F.col("_sum").isNotNull() & (F.abs(F.col("total") - F.col("_sum")) > F.lit("0.01").cast("decimal(3,2)"))
    return j.select(*[F.when(bad, F.col("_sum")).otherwise(F.col("total")).cast(MONEY).alias("total")
                      if c == "total" else F.col(c) for c in sale.columns])


def repaired_tables(tables: dict[str, DataFrame], target_margin: str = "0.40", product_ids=None) -> dict:
    out = dict(tables)
    out["product"] = repair_price(tables["product"], tables["central_product"], target_margin, product_ids)
    out["sale_item"] = repair_line_subtotal(tables["sale_item"])
    out["sale"] = repair_order_total(tables["sale"], out["sale_item"])
    return out


def repair_snapshot(tables: dict[str, DataFrame], target_margin: str = "0.40", product_ids=None) -> DataFrame:
    """The rows the repairs will change, with before and after values."""
    t = tables
    p = repaired_prices(t["product"], t["central_product"], target_margin, product_ids) \
        .filter(F.col("price_changed")).select(
        F.lit("product").alias("table_name"), F.col("product_id").alias("row_id"),
        F.lit("price").alias("column_name"), F.col("old_price").alias("before_value"),
        F.col("new_price").alias("after_value"))
    li = t["sale_item"].filter(subtotal_bad()).select(
        F.lit("sale_item").alias("table_name"), F.col("sale_item_id").alias("row_id"),
        F.lit("subtotal").alias("column_name"), F.col("subtotal").alias("before_value"),
        F.round(F.col("quantity") * F.col("unit_price"), 2).cast(MONEY).alias("after_value"))
    fixed_items = repair_line_subtotal(t["sale_item"])
    sums = fixed_items.groupBy("sale_id").agg(F.round(F.sum("subtotal"), 2).cast(MONEY).alias("_sum"))
    o = t["sale"].join(sums, "sale_id", "inner").filter(
        F.abs(F.col("total") - F.col("_sum")) > F.lit("0.01").cast("decimal(3,2)")).select(
        F.lit("sale").alias("table_name"), F.col("sale_id").alias("row_id"),
        F.lit("total").alias("column_name"), F.col("total").alias("before_value"),
        F.col("_sum").alias("after_value"))
    return p.unionByName(li).unionByName(o)


def repair_log(tables: dict[str, DataFrame], target_margin: str = "0.40", product_ids=None) -> DataFrame:
    """Per rule, rows changed and bad rows remaining after the repair.

    Lines are read once: per order they give the counts of R02 and both sums that R03 compares with the total.
    """
    t = tables
    p = repaired_prices(t["product"], t["central_product"], target_margin, product_ids)
    price = p.join(t["central_product"].select("product_id", "unit_cost"), "product_id").agg(
        F.count(F.when(F.col("price_changed"), 1)).alias("rows_changed"),
        F.count(F.when(F.col("new_price") < F.col("unit_cost"), 1)).alias("remaining"))
    fixed = F.round(F.col("quantity") * F.col("unit_price"), 2).cast(MONEY)
    kept = F.when(subtotal_bad(), fixed).otherwise(F.col("subtotal"))
    per_order = t["sale_item"].groupBy("sale_id").agg(
        F.count(F.when(subtotal_bad(), 1)).alias("line_changed"),
        F.count(F.when(differs(kept, F.round(F.col("quantity") * F.col("unit_price"), 2)), 1)).alias("line_left"),
        F.round(F.sum(kept), 2).cast(MONEY).alias("_sum"))
    orders = t["sale"].join(per_order, "sale_id", "full")
    bad = F.coalesce(differs(F.col("total"), F.col("_sum")), F.lit(False))
    total_after = F.when(bad, F.col("_sum")).otherwise(F.col("total"))
    s = orders.agg(F.coalesce(F.sum("line_changed"), F.lit(0)).alias("line_changed"), F.coalesce(F.sum("line_left"), F.lit(0)).alias("line_left"),
                   F.count(F.when(bad, 1)).alias("total_changed"), F.count(F.when(differs(total_after, F.col("_sum")), 1)).alias("total_left"))
    rows = [price.select(F.lit("R01 price from cost and target margin").alias("rule"), F.lit("product").alias("table_name"),
                         F.lit("price").alias("column_name"), "rows_changed", F.col("remaining").alias("remaining_bad_rows")),
            s.select(F.inline(F.array(
                F.struct(F.lit("R02 subtotal = round(quantity * unit_price, 2)").alias("rule"), F.lit("sale_item").alias("table_name"),
                         F.lit("subtotal").alias("column_name"), F.col("line_changed").alias("rows_changed"),
                         F.col("line_left").alias("remaining_bad_rows")),
                F.struct(F.lit("R03 total = round(sum of subtotals, 2)").alias("rule"), F.lit("sale").alias("table_name"),
                         F.lit("total").alias("column_name"), F.col("total_changed").alias("rows_changed"),
                         F.col("total_left").alias("remaining_bad_rows")))))]
    return rows[0].unionByName(rows[1])
