"""Hand-worked cases for the customer mart and the rulings of SURVEY 2C."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from marketlens.operators import mart as M
from marketlens.operators import warehouse as W

FACT = ("date_sk int, customer_sk long, product_sk long, store_sk long, zone_sk long, offer_sk long, "
        "sale_id long, sale_item_id long, quantity long, unit_price decimal(18,2), gross_amount decimal(18,2), "
        "cost_amount decimal(18,2), gross_margin decimal(18,2), margin_pct decimal(18,2), is_returned boolean, "
        "returned_qty long, net_amount decimal(18,2)")


def _fact(spark, rows):
    return spark.createDataFrame(rows, FACT)


def _dates(spark, days):
    return spark.createDataFrame([(int(d.strftime("%Y%m%d")), d) for d in days], "date_sk int, date date")


def _cust(spark, ids):
    return spark.createDataFrame([(i + 1, i, "Customer", str(i), False) for i in ids] +
                                 [(1, -1, "Unknown", "", True)],
                                 "customer_sk long, customer_nk long, first_name string, last_name string, is_unknown boolean")


def test_customer_360_formulas(spark):
    d1, d2 = dt.date(2020, 1, 1), dt.date(2020, 3, 1)          # 60 days apart
    rows = [
        # customer 2: two orders; 10 units, 3 returned
        (20200101, 2, 2, 2, 2, 1, 100, 100001, 4, D("10.00"), D("40.00"), D("24.00"), D("16.00"), D("40.00"), True, 3, D("10.00")),
        (20200301, 2, 2, 2, 2, 1, 101, 101001, 6, D("10.00"), D("60.00"), D("36.00"), D("24.00"), D("40.00"), False, 0, D("60.00")),
        # customer 3: one order, returned more than bought (raw rate 150 %), negative net
        (20200101, 3, 2, 2, 2, 1, 102, 102001, 2, D("10.00"), D("20.00"), D("12.00"), D("8.00"), D("40.00"), True, 3, D("-10.00")),
        # unknown customer is excluded (F1)
        (20200101, 1, 2, 2, 2, 1, 103, 103001, 1, D("10.00"), D("10.00"), D("6.00"), D("4.00"), D("40.00"), False, 0, D("10.00")),
    ]
    out = {r.customer_sk: r for r in M.customer_360(_fact(spark, rows), _dates(spark, [d1, d2]),
                                                     _cust(spark, [1, 2])).collect()}
    assert set(out) == {2, 3}
    a = out[2]
    assert (a.num_orders, a.num_lines, a.tenure_days, a.recency_days) == (2, 2, 60, 0)
    assert a.net_revenue == D("70.00") and a.gross_margin == D("40.00")
    assert a.margin_pct == D("40.00")                           # 40 / 100
    assert a.aov == D("35.00")
    assert a.monthly_frequency == D("1.0000")                   # 2 orders / (60 / 30)
    assert a.return_rate == D("30.00")
    assert a.cltv == D("28.00")                                 # 70 * 40 %
    b = out[3]
    assert b.tenure_days == 0 and b.monthly_frequency == D("2.0000") / 2
    assert b.return_rate_raw == D("150.00") and b.return_rate == D("100.00")   # F11
    assert b.cltv == D("-4.00")                                 # negative net keeps its sign


def test_zero_gross_gives_zero_margin(spark):
    rows = [(20200101, 2, 2, 2, 2, 1, 1, 1001, 1, D("0.00"), D("0.00"), D("0.00"), D("0.00"), None, False, 0, D("0.00"))]
    r = M.customer_360(_fact(spark, rows), _dates(spark, [dt.date(2020, 1, 1)]), _cust(spark, [1])).first()
    assert r.margin_pct == D("0.00") and r.cltv == D("0.00")


def test_returns_by_line_keeps_order_key(spark):
    ri = spark.createDataFrame([(1, 11, 2), (1, 11, 1), (2, 21, 5)], "sale_id long, sale_item_id long, quantity long")
    got = {(r.sale_id, r.sale_item_id): r.returned_qty for r in W.returns_by_line(ri).collect()}
    assert got == {(1, 11): 3, (2, 21): 5}


def test_dim_date_iso_fields(spark):
    sale = spark.createDataFrame([(dt.date(2024, 12, 28),), (dt.date(2024, 12, 30),)], "sale_date date")
    rows = {r.date: r for r in W.dim_date(sale).collect()}
    assert len(rows) == 3
    r = rows[dt.date(2024, 12, 30)]
    assert (r.week, r.day_of_week, r.day_name, r.is_weekend, r.date_sk) == (1, 1, "Monday", False, 20241230)  # K30
    assert rows[dt.date(2024, 12, 28)].is_weekend and rows[dt.date(2024, 12, 28)].month_name == "December"


def test_returns_of_a_long_order_keep_their_own_line(spark):
    # Order 7 has 1,500 lines: its line 1,001 shares the id 8,001 with line 1 of order 8.
    from marketlens.operators import quality as Q
    day = dt.date(2024, 5, 1)
    fact = [(7, 7000 + k, 70) for k in range(1, 1501)] + [(8, 8001, 80)]
    f = spark.createDataFrame([(s, i, c, c, 1, D("2.00")) for s, i, c in fact], "sale_id long, sale_item_id long, "
                              "customer_sk long, product_sk long, store_sk long, unit_price decimal(18,2)")
    ri = spark.createDataFrame([(1, 7, 8001, day, 1, 1), (2, 8, 8001, day, 1, 1)], "return_id long, sale_id long, "
                               "sale_item_id long, return_date date, quantity long, reason_id long")
    product = spark.createDataFrame([(70, D("1.00")), (80, D("1.00"))], "product_sk long, unit_cost decimal(18,2)")
    reason = spark.createDataFrame([(2, 1, False)], "reason_sk long, reason_nk long, is_unknown boolean")
    got = W.fact_returns(ri, f, product, reason, _dates(spark, [day])).collect()
    assert sorted((r.return_id, r.customer_sk) for r in got) == [(1, 70), (2, 80)]
    sale = spark.createDataFrame([(7, day), (8, day + dt.timedelta(days=1))], "sale_id long, sale_date date")
    assert Q.returns_before_sale(ri, f.select("sale_item_id", "sale_id"), sale).first().cases == 1
