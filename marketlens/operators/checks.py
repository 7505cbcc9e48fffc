"""Warehouse checks (V): a declarative list of (id, description, value, expected, kind).

Each check yields a one-row DataFrame; the report unions them, so the whole
battery is one Spark job of small aggregates. A failed check does not stop
the pipeline (the caller decides).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.output import attach
from ..sources.binding import Sources
from .warehouse import Warehouse


@dataclass
class Check:
    id: str
    description: str
    value: DataFrame        # one row, column "value"
    expected: float
    kind: str               # eq | zero | gt | lt


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("double").alias("value"))


def staging_checks(stage, expected: dict | None = None) -> list[Check]:
    """Rows in the staged files equal the expected counts (default: the rows observed on their way there, F27)."""
    out = []
    for i, t in enumerate(("sale", "sale_item", "customer", "product"), start=1):
        exp = (expected or {}).get(t)
        value = _count(getattr(stage, t))
        if exp is None:
            seen = stage.profile.where(F.col("table_name") == t).agg(F.max("rows").cast("double").alias("_exp"))
            value = value.transform(attach, seen)
            exp = 0.0
        out.append(Check(f"V{i:02d}", f"staged {t} rows equal the expected count", value, float(exp), "eq"))
    return out


FACT_KEYS = (("V13", "customer_sk", "dim_customer"), ("V14", "product_sk", "dim_product"), ("V15", "store_sk", "dim_store"),
             ("V16", "date_sk", "dim_date"))


def _fact_orphans(w: Warehouse) -> DataFrame:
    """Sale lines without a member of each dimension, one row: the fact is read once, unpivoted to distinct (key, value) counts."""
    own = [F.struct(F.lit(k).alias("dim"), F.col(c).cast("long").alias("value")) for k, c, _ in FACT_KEYS]
    keys = w.fact_sales.select(F.inline(F.array(*own))).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    known = reduce(DataFrame.unionByName, [getattr(w, d).select(F.lit(k).alias("dim"), F.col(c).cast("long").alias("value"))
                                           for k, c, d in FACT_KEYS])
    lost = keys.join(known, ["dim", "value"], "left_anti")
    return lost.agg(*[F.coalesce(F.sum(F.when(F.col("dim") == k, F.col("n"))), F.lit(0)).cast("double").alias(k) for k, _, _ in FACT_KEYS])


def warehouse_checks(w: Warehouse, src: Sources) -> list[Check]:
    """V05-V21. Single-table conditions share one aggregate per table, kept as its one
    row, so the fact table is scanned once for all of them."""
    s = src
    f = w.fact_sales
    fs = f.agg(F.count(F.lit(1)).cast("double").alias("rows"),
               F.count(F.when(F.col("quantity") <= 0, 1)).cast("double").alias("qty_nonpos"),
               F.count(F.when(F.col("gross_amount") < 0, 1)).cast("double").alias("gross_neg"),
               F.count(F.when(F.col("net_amount") > F.col("gross_amount") + F.lit("0.01").cast("decimal(3,2)"), 1))
               .cast("double").alias("net_gt_gross"),
               F.sum("gross_amount").alias("gross_sum")).persist()

    # One row each, kept: every check that reads a column of it shares one computation.
    orphans = _fact_orphans(w).persist()

    def stat(c):
        return fs.select(F.col(c).alias("value"))

    def ref_count(df, plus=0):
        return df.agg((F.count(F.lit(1)) + plus).cast("double").alias("_exp"))

    checks = [
        Check("V05", "dim_customer = customers + 1 unknown",
              _count(w.dim_customer).transform(attach, ref_count(s.customer, 1)), 0, "eq"),
        Check("V06", "dim_product = products + 1 unknown",
              _count(w.dim_product).transform(attach, ref_count(s.product, 1)), 0, "eq"),
        Check("V07", "dim_store = stores + 1 unknown",
              _count(w.dim_store).transform(attach, ref_count(s.store, 1)), 0, "eq"),
        Check("V08", "every sale date is in dim_date",
              s.sale.select(F.col("sale_date").alias("date")).distinct()
              .join(w.dim_date.select("date"), "date", "left_anti").transform(_count), 0, "zero"),
        Check("V09", "exactly one no-offer member", _count(w.dim_offer.filter("is_no_offer")), 1, "eq"),
        Check("V10", "exactly one unknown return reason", _count(w.dim_return_reason.filter("is_unknown")), 1, "eq"),
        Check("V11", "fact_sales rows = sale lines", stat("rows").transform(attach, ref_count(s.sale_item)), 0, "eq"),
        Check("V12", "fact_returns has rows", _count(w.fact_returns), 0, "gt"),
        *[Check(k, f"no orphan {c} in fact_sales", orphans.select(F.col(k).alias("value")), 0, "zero") for k, c, _ in FACT_KEYS],
        Check("V17", "no quantity <= 0", stat("qty_nonpos"), 0, "zero"),
        Check("V18", "no negative gross amount", stat("gross_neg"), 0, "zero"),
        Check("V19", "net never above gross + 0.01", stat("net_gt_gross"), 0, "zero"),
        Check("V20", "no negative product margin (known products)",
              _count(w.dim_product.filter((F.col("margin_pct") < 0) & ~F.col("is_unknown"))), 0, "zero"),
        Check("V21", "fact gross total reconciles with staged subtotals (abs diff < 1)",
              fs.select("gross_sum").transform(attach, s.sale_item.agg(F.sum("subtotal").alias("b")))
              .select(F.abs(F.col("gross_sum") - F.col("b")).cast("double").alias("value")), 1, "lt"),
    ]
    return checks


def _row(c: Check) -> DataFrame:
    v = c.value
    exp = F.col("_exp") if "_exp" in v.columns else F.lit(float(c.expected))
    val = F.col("value")
    ok = {"eq": val == exp, "zero": val == 0, "gt": val > exp, "lt": val < exp}[c.kind]
    return v.select(F.lit(c.id).alias("check_id"), F.lit(c.description).alias("description"),
                    val.alias("value"), exp.cast("double").alias("expected"), F.lit(c.kind).alias("kind"),
                    F.coalesce(ok, F.lit(False)).alias("ok"))


def check_rows(checks: list[Check]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [_row(c) for c in checks])


def check_report(checks: list[Check]) -> DataFrame:
    """Every check with its verdict plus run totals."""
    rows = check_rows(checks).persist()     # one row per check: the totals read it, not the tables
    tot = rows.agg(F.count(F.lit(1)).alias("total"),
                   F.count(F.when(F.col("ok"), 1)).alias("passed"),
                   F.count(F.when(~F.col("ok"), 1)).alias("failed"))
    return rows.transform(attach, tot)


GROUPS = {
    "check_staging_counts": ("V01", "V02", "V03", "V04"),
    "check_dim_counts": ("V05", "V06", "V07"),
    "check_date_coverage": ("V08",),
    "check_special_members": ("V09", "V10"),
    "check_fact_counts": ("V11", "V12"),
    "check_fact_orphans": ("V13", "V14", "V15", "V16"),
    "check_positive_qty": ("V17",),
    "check_gross_nonneg": ("V18",),
    "check_net_le_gross": ("V19",),
    "check_product_margin": ("V20",),
    "check_total_reconciles": ("V21",),
}


def all_checks(w: Warehouse, stage, expected: dict | None = None) -> list[Check]:
    return staging_checks(stage, expected) + warehouse_checks(w, stage)
