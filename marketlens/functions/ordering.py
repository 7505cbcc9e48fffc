"""Global order positions and running sums without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task. Here
the total order is cut into range buckets whose edges come from one KLL sketch of
the values (a bounded list on the driver). Rows are bucketed by a balanced
comparison tree (log2(buckets) comparisons, stays in codegen); a value that is
itself an edge gets its own "point" bucket. Buckets of one value (or of nulls) that
are still too large are cut again by sketches of their tie-break keys, all of them from
one grouped aggregate. Bucket sizes and sums are prefixed over the few bucket rows,
broadcast, and added to a per-bucket ``row_number`` / running ``sum``. The edges are
fixed literals in the plan, so a recomputed task lands every row in the same bucket
again. A table of one bucket takes the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import sketch_grid

ROWS_PER_BUCKET = 250_000
# Quantiles read from a sketch, and so the most buckets a cut can have; beyond, buckets grow (their windows spill).
GRID = 1024
SKETCH_K = 4096


def _locate(v: Column, edges: list[float]) -> Column:
    """Number of edges strictly below v, via a balanced comparison tree."""
    def build(lo: int, hi: int) -> Column:
        # answer lies in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2          # compare with edges[mid]
        return F.when(v > F.lit(edges[mid]), build(mid + 1, hi)).otherwise(build(lo, mid))
    return build(0, len(edges))


def _bucket_expr(v: Column, edges: list[float]) -> Column:
    """Range bucket id: -1 for null, 2*i for the open range below edges[i], 2*i+1 for v == edges[i]."""
    inside = F.lit(0)
    if edges:
        i = _locate(v, edges)
        is_point = (i < len(edges)) & (F.element_at(F.array(*[F.lit(e) for e in edges]), (i + 1).cast("int")) == v)
        inside = i * 2 + F.when(is_point, 1).otherwise(0)
    return F.when(v.isNull(), F.lit(-1)).otherwise(inside).cast("long")


def _edges(grid: list[float] | None, rows: int, rows_per_bucket: int) -> list[float]:
    """Distinct sketch quantiles that cut ``rows`` into buckets of about ``rows_per_bucket``."""
    n = min(GRID, math.ceil(rows / max(1, rows_per_bucket)))
    return sorted({grid[round(i * GRID / n)] for i in range(1, n)}) if grid else []


def global_order(df: DataFrame, value: str, tiebreak: str, *, descending: bool = False,
                 pos_col: str = "pos", running_col: str | None = None,
                 running_of: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add a 1-based ``pos_col`` in (value, tiebreak) order and optionally the
    running sum of ``running_of`` in that order.

    ``value`` and ``tiebreak`` are numeric columns; (value, tiebreak) must be
    unique for positions to be deterministic. Nulls in ``value`` come first in both
    directions, ties in ascending ``tiebreak``.
    """
    src = df.withColumn("__v", (-F.col(value) if descending else F.col(value)).cast("double"))
    size = src.agg(F.count(F.lit(1)).alias("n"), F.count("__v").alias("valued"), sketch_grid(F.col("__v"), SKETCH_K, GRID).alias("grid")).first()
    edges = _edges(size["grid"], size["n"], rows_per_bucket)
    src = src.withColumn("__b", _bucket_expr(F.col("__v"), edges))

    # Buckets of one value (and of the nulls) that hold many rows are cut by their tie-break keys, all from one aggregate.
    tie = F.col(tiebreak).cast("double")
    heavy = src.groupBy("__b").agg(F.count(F.lit(1)).alias("n"), F.min(value).eqNullSafe(F.max(value)).alias("one"), sketch_grid(tie, SKETCH_K, GRID).alias("grid")) \
        .where((F.col("n") > 2 * rows_per_bucket) & F.col("one"))
    sub = F.lit(0)
    # Without an edge all values share one bucket, and it is not too large unless it is that of the nulls.
    for r in heavy.collect() if edges or not size["valued"] else []:
        sub = F.when(F.col("__b") == r["__b"], _locate(tie, _edges(r["grid"], r["n"], rows_per_bucket))).otherwise(sub)
    src = src.withColumn("__s", sub.cast("long"))

    aggs = [F.count(F.lit(1)).alias("__n")]
    if running_of:
        aggs.append(F.sum(running_of).alias("__sum"))
    per = src.groupBy("__b", "__s").agg(*aggs)
    # One row per bucket, a few thousand at most: a single-task window here is bounded.
    w = Window.orderBy("__b", "__s").rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off")]
    if running_of:
        offs.append(F.sum("__sum").over(w).alias("__sumoff"))
    per = per.select("__b", "__s", *offs)

    vcol = F.col(value).desc_nulls_first() if descending else F.col(value).asc_nulls_first()
    inb = Window.partitionBy("__b", "__s").orderBy(vcol, F.col(tiebreak).asc())
    out = src.join(F.broadcast(per), ["__b", "__s"], "inner")
    out = out.withColumn(pos_col, F.col("__off") + F.row_number().over(inb))
    if running_of:
        run = F.sum(running_of).over(inb.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(running_col or f"running_{running_of}",
                             F.coalesce(F.col("__sumoff"), F.lit(0)) + run)
        out = out.drop("__sumoff")
    return out.drop("__v", "__b", "__s", "__off")


def dense_keys(df: DataFrame, natural_key: str, sk_col: str, first: int = 2,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Surrogate key: ``first`` + 0-based position of the unique natural key."""
    out = global_order(df, natural_key, natural_key, pos_col="__pos",
                       rows_per_bucket=rows_per_bucket)
    return out.withColumn(sk_col, (F.col("__pos") + (first - 1)).cast("long")).drop("__pos")
