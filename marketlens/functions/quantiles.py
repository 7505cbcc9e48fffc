"""Exact quantiles by selection: no task and no buffer ever holds more than a bounded number of values.

``percentile`` keeps every distinct value of a group in one buffer. Here a KLL sketch of the values (a few tens of
kilobytes, merged map-side) gives for every wanted rank two values of the table that should enclose it. The next
pass counts exactly what lies below, on and between them, and sketches what lies strictly between. The counts decide:
the rank falls on a bracket's end (heavy ties end here) or into a smaller open interval, and a sketch that
missed costs a pass, never the result. An interval of at most ``GATHER`` values is read and sorted. Each pass
divides the candidates by about 200, so a thousand million values take four passes.

All wanted ranks, columns and groups share the passes. The driver keeps one row of bracket ends per group and rank:
``by`` is for groups of a bounded number, such as bands or metrics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 4096
GRID = 512
# Rank error of a sketch of that k (99 % of the time well below it), as steps of the grid.
MARGIN = 2
GATHER = 4096


@dataclass
class _Wanted:
    """The value of 0-based rank ``k``: strictly between ``low`` and ``high`` (None: unbounded), ``below`` values being at or under ``low``."""

    k: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    value: float | None = None
    guess: tuple[float, float] | None = None

    def guess_from(self, grid: list[float] | None) -> None:
        self.guess = None
        if grid and self.value is None:
            at = (self.k - self.below) / max(1, self.inside - 1) * GRID
            self.guess = (grid[max(0, math.floor(at) - MARGIN)], grid[min(GRID, math.ceil(at) + MARGIN)])

    def narrow(self, under: int, on_low: int, between: int, on_high: int) -> None:
        """Counts of the open interval's values under, on, between and on the ends of the guess."""
        a, b = self.guess
        k = self.k - self.below
        if k < under:
            self.high, self.inside = a, under
        elif k < under + on_low:
            self.value = a
        elif k < under + on_low + between:
            self.low, self.high, self.inside = a, b, between
            self.below += under + on_low
        elif k < under + on_low + between + on_high:
            self.value = b
        else:
            gone = under + on_low + between + on_high
            self.low, self.inside = b, self.inside - gone
            self.below += gone


def _column(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def sketch_grid(x: Column, k: int = SKETCH_K, grid: int = GRID) -> Column:
    """Aggregate: the values at ``grid`` + 1 evenly spaced ranks of a KLL sketch of ``x``; null where ``x`` has no value."""
    ranks = F.from_json(F.lit(str([i / grid for i in range(grid + 1)])), "array<double>")  # one constant, not an expression a rank
    return F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x, k), ranks))


def _inside(x: Column, w: _Wanted) -> Column:
    above = F.lit(True) if w.low is None else x > F.lit(w.low)
    return above if w.high is None else above & (x < F.lit(w.high))


def _of_group(key: tuple, by: list[str]) -> Column:
    cond = F.lit(True)
    for c, v in zip(by, key, strict=True):
        cond = cond & F.col(c).eqNullSafe(F.lit(v))
    return cond


def _select(rows: DataFrame, by: list[str], probs: list[float]) -> dict[tuple, tuple[int, dict[int, float]]]:
    """(number of values, value per rank next to ``probs``) of every group of ``rows`` (by..., x)."""
    x = F.col("x")
    state: dict[tuple, dict[int, _Wanted]] = {}
    size: dict[tuple, int] = {}
    for r in rows.groupBy(*by).agg(F.count(x).alias("n"), sketch_grid(x).alias("grid")).collect():
        key, n = tuple(r[c] for c in by), r["n"]
        size[key] = n
        state[key] = {k: _Wanted(k, inside=n) for p in probs for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))} if n else {}
        for w in state[key].values():
            w.guess_from(r["grid"])
    while open_ := [(g, w) for g, ws in state.items() for w in ws.values() if w.value is None]:
        few = [(g, w) for g, w in open_ if w.inside <= GATHER]
        many = [(g, w) for g, w in open_ if w.inside > GATHER]
        aggs = []
        for i, (g, w) in enumerate(few):
            aggs.append(F.sort_array(F.collect_list(F.when(_of_group(g, by) & _inside(x, w), x))).alias(f"few{i}"))
        for i, (g, w) in enumerate(many):
            mine = _of_group(g, by) & _inside(x, w)
            a, b = w.guess
            between = mine & (x > F.lit(a)) & (x < F.lit(b))
            aggs += [F.count(F.when(mine & (x < F.lit(a)), 1)).alias(f"under{i}"), F.count(F.when(mine & (x == F.lit(a)), 1)).alias(f"low{i}"),
                     F.count(F.when(between, 1)).alias(f"between{i}"),
                     F.count(F.when(mine & (x == F.lit(b)) & F.lit(a != b), 1)).alias(f"high{i}"),
                     sketch_grid(F.when(between, x)).alias(f"grid{i}")]
        r = rows.agg(*aggs).first()
        for i, (_, w) in enumerate(few):
            w.value = r[f"few{i}"][w.k - w.below]
        for i, (_, w) in enumerate(many):
            guess = w.guess
            w.narrow(*(r[f"{c}{i}"] for c in ("under", "low", "between", "high")))
            w.guess_from(r[f"grid{i}"] if (w.low, w.high) == guess else None)
        missed = [(g, w) for g, w in many if w.value is None and w.guess is None and w.inside > GATHER]
        if missed:  # a sketch was further off than the margin: sketch the interval that is left
            r = rows.agg(*[sketch_grid(F.when(_of_group(g, by) & _inside(x, w), x)).alias(f"g{i}") for i, (g, w) in enumerate(missed)]).first()
            for i, (_, w) in enumerate(missed):
                w.guess_from(r[f"g{i}"])
    return {g: (size[g], {k: w.value for k, w in ws.items()}) for g, ws in state.items()}


def _interpolated(n: int, p: float, values: dict[int, float]) -> float | None:
    if not n:
        return None
    at = p * (n - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return values[lo] if lo == hi else (hi - at) * values[lo] + (at - lo) * values[hi]


def quantiles_by(df: DataFrame, value: Column | str, probs: list[float], by: list[str]) -> dict[tuple, list[float | None]]:
    """Exact quantiles of ``value`` for every group of ``by``: linear interpolation, nulls and NaN ignored, None without values."""
    rows = df.select(*by, _column(value).alias("x")).where("x is not null and not isnan(x)")
    return {g: [_interpolated(n, p, v) for p in probs] for g, (n, v) in _select(rows, by, probs).items()}


def quantiles(df: DataFrame, value: Column | str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of ``value`` over all rows."""
    return quantiles_by(df, value, probs, []).get((), [None] * len(probs))


def quantiles_of(df: DataFrame, values: dict[str, Column | str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, in common passes over one row per value."""
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), _column(c).alias("x")) for name, c in values.items()])
    found = quantiles_by(df.select(F.inline(pairs)), "x", probs, ["name"])
    return {name: found.get((name,), [None] * len(probs)) for name in values}


def constant(value: float | None) -> Column:
    return F.lit(value).cast("double")
