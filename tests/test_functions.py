"""Exact rounding and global ordering helpers."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.functions.exact import round_div
from marketlens.functions.ordering import dense_keys, global_order


def _ref(n, d, scale):
    q = Decimal(n) / Decimal(d)
    return q.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(-5000, 5000).filter(lambda x: x != 0)),
                min_size=1, max_size=40), st.sampled_from([0, 1, 2, 4]))
def test_round_div_matches_decimal_half_away(spark, pairs, scale):
    df = spark.createDataFrame([(Decimal(a).scaleb(-2), b) for a, b in pairs], "n decimal(18,2), d long")
    got = [r[0] for r in df.select(round_div(F.col("n"), F.col("d"), scale)).collect()]
    for (a, b), g in zip(pairs, got):
        exact = Decimal(a).scaleb(-2) / Decimal(b)
        want = abs(exact).quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP) * (1 if exact >= 0 else -1)
        assert g == want, (a, b, scale, g, want)


def test_round_div_ties_and_zero(spark):
    df = spark.createDataFrame([(Decimal("10.05"), 2), (Decimal("-10.05"), 2), (Decimal("1.00"), 0)],
                               "n decimal(18,2), d long")
    got = [r[0] for r in df.select(round_div(F.col("n"), F.col("d"), 2)).collect()]
    assert got == [Decimal("5.03"), Decimal("-5.03"), None]


def _check_order(spark, values, rows_per_bucket, descending=False):
    rows = [(i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, v double")
    out = global_order(df, "v", "k", descending=descending, pos_col="pos", running_col="cum",
                       running_of="v", rows_per_bucket=rows_per_bucket).toPandas()
    order = sorted(rows, key=lambda r: ((-r[1]) if descending else r[1], r[0]))
    want_pos = {k: i + 1 for i, (k, _) in enumerate(order)}
    cum = np.cumsum([v for _, v in order])
    want_cum = {k: cum[i] for i, (k, _) in enumerate(order)}
    assert len(out) == len(values)
    for r in out.itertuples():
        assert r.pos == want_pos[r.k]
        assert abs(r.cum - want_cum[r.k]) < 1e-6 * max(1.0, abs(want_cum[r.k]))


def test_global_order_lognormal_buckets(spark):
    rng = np.random.default_rng(1)
    _check_order(spark, np.round(rng.lognormal(3, 1.5, 3000), 2), rows_per_bucket=200)


def test_global_order_heavy_ties_split_by_key(spark):
    rng = np.random.default_rng(2)
    vals = np.where(rng.random(3000) < 0.8, 0.0, np.round(rng.normal(0, 50, 3000), 2))
    _check_order(spark, vals, rows_per_bucket=100)
    _check_order(spark, vals, rows_per_bucket=100, descending=True)


def test_global_order_small_and_constant(spark):
    _check_order(spark, [5.0], rows_per_bucket=10)
    _check_order(spark, [3.0] * 50, rows_per_bucket=7)


def test_dense_keys(spark):
    df = spark.createDataFrame([(k,) for k in [40, 7, 13, 1000, 2]], "nk long")
    out = {r.nk: r.sk for r in dense_keys(df, "nk", "sk", rows_per_bucket=2).collect()}
    assert out == {2: 2, 7: 3, 13: 4, 40: 5, 1000: 6}


@pytest.mark.parametrize("descending", [False, True])
def test_global_order_nulls_first_and_90_percent_ties(spark, descending):
    rows = [(k, None if k % 7 == 0 else 5.0 if k % 10 else float(k % 13)) for k in range(4000)]
    df = spark.createDataFrame(rows, "k long, v double")
    for per_bucket in (50, 10_000):
        out = {r.k: r.pos for r in global_order(df, "v", "k", descending=descending, rows_per_bucket=per_bucket).collect()}
        order = sorted(rows, key=lambda r: (r[1] is not None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0]))
        assert out == {k: i for i, (k, _) in enumerate(order, 1)}
    nothing = spark.createDataFrame([(k, None) for k in range(300)], "k long, v double")
    assert {r.k: r.pos for r in global_order(nothing, "v", "k", rows_per_bucket=20).collect()} == {k: k + 1 for k in range(300)}
    assert global_order(df.limit(0), "v", "k").count() == 0


@pytest.mark.parametrize("kind", ["distinct", "ties", "small", "skewed", "edges"])
def test_exact_quantiles(spark, kind):
    from marketlens.functions.quantiles import quantiles
    n = {"distinct": 1_000_000, "small": 7}.get(kind, 60_000)
    i = F.col("id")
    x = {"distinct": (i * 7919 % n).cast("double") / 3, "ties": F.when(i % 10 == 0, i * 1.0).otherwise(12_345.0), "small": i * 1.5,
         "skewed": F.exp((i * 7919 % n) / 3000.0) * F.when(i % 2 == 0, -1).otherwise(1),
         "edges": F.when(i < n / 4, float("-inf")).when(i % 100 == 0, None).otherwise(i % 5)}[kind]
    df = spark.range(n).select(x.cast("double").alias("v"))
    probs = [0.0, 0.05, 1 / 3, 0.5, 0.9, 0.95, 1.0]
    got = quantiles(df, "v", probs)
    want = df.agg(F.percentile("v", F.array(*map(F.lit, probs)))).first()[0]
    assert [g == w or abs(g - w) <= 1e-9 * abs(w) for g, w in zip(got, want, strict=True)] == [True] * len(probs)


def test_quantiles_by_group_and_of_nothing(spark):
    from marketlens.functions.quantiles import quantiles, quantiles_by, quantiles_of
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3).alias("g"),
                                    F.when(F.col("id") % 3 == 2, None).otherwise(F.col("id") * F.col("id") % 10_007).alias("v"))
    got = quantiles_by(df, "v", [0.25, 0.5], ["g"])
    want = {(r.g,): r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("q")).collect()}
    assert got[(None,)] == want[(None,)] and got[(1,)] == want[(1,)]
    assert got.get((2,), [None, None]) == [None, None]
    assert quantiles(df.limit(0), "v", [0.5]) == [None]
    assert quantiles_of(df, {"v": "v", "none": F.lit(None)}, [0.5])["none"] == [None]
