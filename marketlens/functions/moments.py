"""Exact first and second moments of several columns, from one aggregate.

Sums and sums of products are decimals; variances and covariances are formed as integers, n * Q - S * S, before any cast,
so equal values give exactly 0 and close ones lose no digits to cancellation. Columns are integers or decimals, counted in
units of their scale; a product of two beyond 38 digits is an error, not a wrong sum. A null in one of its columns leaves a
row out of a pair (each pair has its own n and sums).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Per pair (i, j), i <= j: n, sum of x_i, sum of x_j, sums of x_i^2, x_j^2 and x_i * x_j over rows where both are known."""

    pairs: dict[tuple[int, int], tuple[Fraction, ...]]
    size: int

    def mean(self, i: int) -> float | None:
        n, s, *_ = self.pairs[i, i]
        return float(s / n) if n else None

    def std(self, i: int) -> float:
        """Population standard deviation; 0 for a constant column and for none."""
        n, s, _, q, _, _ = self.pairs[i, i]
        return math.sqrt(n * q - s * s) / float(n) if n else 0.0

    def correlation(self, i: int, j: int) -> float | None:
        """Pearson; null where one of the columns is constant."""
        n, si, sj, qi, qj, p = self.pairs[min(i, j), max(i, j)]
        spread = (n * qi - si * si) * (n * qj - sj * sj)
        if not spread:
            return None
        return float(n * p - si * sj) / math.sqrt(spread)


def moments(df: DataFrame, cols) -> Moments:
    """Moments of ``cols``: one pass, one row of sums."""
    scales = [getattr(df.schema[c].dataType, "scale", 0) for c in cols]
    whole = [(F.col(c) * F.lit(10 ** s)).cast("decimal(38,0)") for c, s in zip(cols, scales, strict=True)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs = []
    for i, j in pairs:
        both = whole[i].isNotNull() & whole[j].isNotNull()
        x, y = F.when(both, whole[i]), F.when(both, whole[j])
        for v in (x, y, x * x, y * y, x * y):
            aggs.append(F.coalesce(F.sum(v.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))
    counts = [F.count(F.when(whole[i].isNotNull() & whole[j].isNotNull(), 1)) for i, j in pairs]
    row = df.agg(F.array(*aggs).alias("sums"), F.array(*counts).alias("n")).first()
    out = {}
    for k, (i, j) in enumerate(pairs):
        si, sj, qi, qj, p = (int(x) for x in row["sums"][5 * k:5 * k + 5])
        a, b = Fraction(1, 10 ** scales[i]), Fraction(1, 10 ** scales[j])
        out[i, j] = (Fraction(row["n"][k]), si * a, sj * b, qi * a * a, qj * b * b, p * a * b)
    return Moments(out, len(cols))


def correlations(m: Moments) -> list[list[float | None]]:
    return [[m.correlation(i, j) for j in range(m.size)] for i in range(m.size)]
