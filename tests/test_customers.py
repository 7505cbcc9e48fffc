"""Customer analytics: invariants and rulings on inline marts."""

from decimal import Decimal as D

import numpy as np
from pyspark.sql import functions as F

from marketlens.operators import customers as C
from marketlens.operators import quality as Q

MART = ("customer_sk long, cltv decimal(18,2), num_orders long, tenure_days int, recency_days int, "
        "monthly_frequency decimal(18,4), aov decimal(18,2), return_rate decimal(18,2), units_bought long, "
        "units_returned long, gross_revenue decimal(18,2), net_revenue decimal(18,2), name string")


def _mart(spark, cltvs, **over):
    rows = []
    for i, c in enumerate(cltvs):
        rows.append((i + 2, D(str(c)), 1 + i % 4, (i * 97) % 1500, (i * 31) % 400, D(str(round(0.5 + i % 7 * 0.25, 4))),
                     D("50.00"), D(str(i % 60)), 10, i % 3, D("100.00"), D("90.00"), f"Customer {i:09d}"))
    return spark.createDataFrame(rows, MART)


def test_gini_and_lorenz_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.lognormal(4, 1.2, 400), 2)
    m = _mart(spark, vals)
    g = float(C.gini(m).first().gini)
    v = np.sort(vals)
    n = len(v)
    want = 2 * np.sum(np.arange(1, n + 1) * v) / (n * v.sum()) - (n + 1) / n
    assert abs(g - round(want, 3)) < 1e-9 and 0 <= g <= 1
    lz = C.lorenz_curve(m).toPandas().sort_values("pos")
    assert abs(lz.cltv_pct.iloc[-1] - 100) < 1e-9 and abs(lz.population_pct.iloc[-1] - 100) < 1e-9


def test_pareto_first_crossing_with_negatives(spark):
    vals = [100, 50, -30, 20, 0, 10]
    m = _mart(spark, vals)
    r = C.pareto_80(m).first()
    desc = sorted(vals, reverse=True)
    cum = np.cumsum(desc)
    first = int(np.argmax(cum * 100 >= sum(vals) * 80)) + 1       # F24
    assert r.customers_needed == first


def test_tercile_rule(spark):
    for n in (1, 2, 3, 5, 8, 10):
        m = _mart(spark, list(range(n, 0, -1)))
        lab = {r.customer_sk: r.cluster_id for r in C.tercile_labels(m).collect()}
        for r in range(1, n + 1):
            want = 0 if 3 * (r - 1) <= n - 1 else (1 if 3 * (r - 1) <= 2 * (n - 1) else 2)
            assert lab[r + 1] == want, (n, r)


def test_top_share_and_percentile(spark):
    vals = [10, 10, 5, 1, 0, 0, 0, 0, 0, 74]
    m = _mart(spark, vals)
    r = C.cltv_top_share(m).first()
    assert r.top10_share_pct == D("74.0") and r.top20_share_pct == D("84.0")
    p = {x.customer_sk: x.pct_below for x in C.customer_percentile(m).collect()}
    assert p[2] == D("70.0") and p[6] == D("0.0")                  # ties share the lowest rank


def test_orders_band_keeps_empty_bands(spark):
    out = C.orders_band(_mart(spark, [1, 2, 3])).toPandas().set_index("band")
    assert list(out.sort_values("band_order").index) == [b[0] for b in C.ORDER_BANDS]
    assert out.customers.sum() == 3


def test_stock_nonpositive_inline(spark):
    inv = spark.createDataFrame([(1, 1, 1, 5), (2, 1, 2, 0), (3, 2, 1, -3)],
                                "inventory_id long, store_id long, product_id long, stock long")
    assert sorted(r.inventory_id for r in Q.stock_nonpositive(inv).collect()) == [2, 3]


def test_exact_duplicates_and_logical(spark):
    t = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (3, "b", None)],
                              "id long, first_name string, last_name string")
    d = Q.exact_duplicates({"t": t}).first()
    assert (d.total, d.distinct_rows, d.duplicates) == (4, 3, 1)
    lg = Q.logical_duplicates(t).collect()
    assert len(lg) == 1 and lg[0].occurrences == 3 and lg[0].affected_rows == 3


def test_open_bands_keep_every_customer(spark):
    m = _mart(spark, [1, 2, 3]).withColumn("num_orders", F.lit(20_000).cast("long")).withColumn("tenure_days", F.lit(120_000))
    bands = {r.band: r.customers for r in C.orders_band(m).collect()}
    assert bands["more than 10"] == 3
    assert [(r.band, r.customers) for r in C.cltv_by_tenure(m).collect()] == [("3+ years", 3)]
