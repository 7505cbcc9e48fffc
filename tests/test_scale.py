"""What keeps work and moved bytes in line with the input: plans, shared rows and roles staged when read."""

import os
import re
import tempfile
from decimal import Decimal as D
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from marketlens.operators import checks as V
from marketlens.operators import customers as C
from marketlens.operators import reports as B
from marketlens.operators.warehouse import Warehouse
from marketlens.plans.context import Context
from marketlens.plans.pipeline import report_bundle
from marketlens.plans.registry import REGISTRY, queries
from marketlens.session import own_session
from marketlens.sources.binding import ROLES, Sources
from marketlens.sources.profile import profile_of
from marketlens.sources.staging import StagedAsUsed
from marketlens.sources.tables import Tables

from .conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """A session in which no table is small enough for a broadcast."""
    s = own_session(spark)
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return s


def _staged(s):
    return StagedAsUsed(Sources(Tables(s, SF001)), tempfile.mkdtemp(prefix="marketlens-test-stg-"))


def test_fact_stays_with_its_orders_when_products_are_not_broadcast(large):
    src = _staged(large)
    fact = Warehouse(src).fact_sales
    # Lines never travel by product: only their distinct (order, product) pairs meet the products.
    assert not re.search(r"Join \[product_id#\d+L?\], \[product_id#\d+L?\], LeftOuter", _plan(fact)), _plan(fact)
    assert fact.count() == src.sale_item.count()


def test_roles_are_staged_when_read(spark):
    src = _staged(own_session(spark))
    alone = {r.sale_id: (r.store_id, r.total) for r in src.sale.collect()}
    assert [r for r in ROLES if os.path.exists(os.path.join(src.path, r))] == ["sale"]
    bound = Sources(Tables(spark, SF001))
    assert alone == {r.sale_id: (r.store_id, r.total) for r in bound.sale.collect()}
    key = ("table_name", "position")
    want = profile_of({r: getattr(bound, r) for r in ROLES}).orderBy(*key).collect()
    assert src.profile.orderBy(*key).collect() == want


def test_store_order_totals_leaves_the_lines_unwritten(spark):
    c = Context(own_session(spark), SF001, persist=True)
    assert B.store_order_totals(c.src.store, c.src.sale).count() > 0
    assert not os.path.exists(os.path.join(c.src.path, "sale_item"))


def test_product_rows_are_joined_once(large):
    plan = _plan(Warehouse(_staged(large)).dim_product)
    assert "LeftOuter" not in plan, plan


def _star(spark):
    products = spark.createDataFrame(
        [(1, "Unknown", None, None), (2, "a", "x", "b1"), (3, "a", "x", "b1"), (4, "a", "y", "b1"), (5, None, "x", "b2"), (6, None, "x", "b2")],
        "product_sk long, name string, category string, brand string")
    # Order 10 holds both products of one name, category and brand: it counts once.
    lines = [(20200105, 2, 10, "1.00", 1, "10.00"), (20200105, 3, 10, "2.00", 1, "20.00"), (20200205, 2, 11, "4.00", 2, None),
             (20190105, 4, 12, "8.00", 1, "30.00"), (20190105, 5, 12, "16.00", 1, "40.00"), (20200305, 6, 13, "32.00", 1, "50.00")]
    fact = spark.createDataFrame([(d, p, s, D(n), q, D(m) if m else None) for d, p, s, n, q, m in lines],
                                 "date_sk int, product_sk long, sale_id long, net_amount decimal(18,2), quantity long, margin_pct decimal(18,2)")
    returns = spark.createDataFrame([(2, D("3.00")), (6, D("5.00"))], "product_sk long, returned_amount decimal(18,2)")
    return SimpleNamespace(fact_sales=fact, fact_returns=returns, dim_product=products)


def test_product_totals_send_groups_instead_of_names(large):
    totals = B.product_totals(_star(large))
    assert not re.search(r"hashpartitioning\(product#\d+, category#\d+, brand#\d+, sale_id", _plan(totals))
    got = {(r["product"], r.category): (r.net_revenue, r.units, r.avg_margin_pct, r.num_orders) for r in totals.collect()}
    assert got == {("a", "x"): (D("7.00"), 4, D("15.00"), 2), ("a", "y"): (D("8.00"), 1, D("30.00"), 1),
                   (None, "x"): (D("48.00"), 2, D("45.00"), 2)}


def test_group_totals_and_details(large):
    w = _star(large)
    got = {r.brand: (r.net_revenue, r.num_orders, r.num_products) for r in B.brands(w).collect()}
    assert got == {"b1": (D("15.00"), 3, 3), "b2": (D("48.00"), 2, 2)}
    assert not re.search(r"hashpartitioning\(brand#\d+, (year#\d+, month#\d+, )?sale_id", _plan(B.brands(w)))
    detail = {(r.brand, r.year, r.month): (r.net_revenue, r.num_orders, r.brand_returns) for r in B.brand_detail(w).collect()}
    assert detail[("b1", 2020, 1)] == (D("3.00"), 1, 1) and detail[("b2", 2019, 1)] == (D("16.00"), 1, 1)
    season = {r["product"]: (r.m01, r.m02, r.m03) for r in B.product_seasonality(w).collect()}
    assert season == {"a": (D("11.00"), D("4.00"), D("0.00"))}
    growth = {(r["product"], r.side): (r.prev_net, r.last_net) for r in B.product_growth(w).collect()}
    assert growth[("a", "best")] == (D("8.00"), D("7.00")) and growth[(None, "worst")] == (D("16.00"), D("32.00"))


def test_growth_joins_the_last_two_years_only(large):
    # The filter on the year stands below the join with the products.
    lines = _plan(B.product_growth(_star(large))).splitlines()
    join = next(i for i, x in enumerate(lines) if "Join" in x and "product_sk" in x)
    assert any("Filter" in x and "subquery" in x.lower() for x in lines[join:]), "\n".join(lines)


def test_checks_share_one_row_of_the_fact(spark):
    s = own_session(spark)
    src = _staged(s)
    checks = V.warehouse_checks(Warehouse(src), src)
    for c in checks:
        if c.id in ("V13", "V16", "V17", "V21"):
            assert "InMemoryTableScan" in _plan(c.value), c.id


def test_zone_groupings_share_one_aggregate(spark):
    mart = spark.createDataFrame([(2, D("1.00")), (3, D("2.00")), (4, None), (5, D("6.00"))], "customer_sk long, cltv decimal(18,2)")
    zones = spark.createDataFrame([(2, "A", "North"), (3, "A", "South")], "customer_sk long, area_type string, orientation string")
    out = C.cltv_by_zone(mart, zones)
    assert "InMemoryTableScan" in _plan(out)
    got = {(r.grouping, r.area_type, r.orientation): (r.customers, r.mean_cltv) for r in out.collect()}
    assert got[("area", "A", None)] == (2, 1.5) and got[("area", None, None)] == (1, 6.0)
    assert got[("orientation", None, "South")] == (1, 2.0) and got[("area_x_orientation", "A", "North")] == (1, 1.0)


def test_the_mart_alone_does_not_keep_the_fact(spark):
    c = Context(own_session(spark), SF001, persist=True)
    rows = C.return_rate_anomalies(c.mart).count()
    assert "fact_sales" not in c.wh.__dict__
    both = Context(own_session(spark), SF001, persist=True).with_fact()
    assert both.wh.fact_sales.storageLevel.useMemory
    assert C.return_rate_anomalies(both.mart).count() == rows
    assert both.mart.exceptAll(c.mart).count() == c.mart.exceptAll(both.mart).count() == 0


def test_bundle_sections_leave_no_shuffle_files(spark, tmp_path):
    s = own_session(spark)
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return sum(f.startswith("shuffle_") and f.endswith(".data") for d in dirs for _, _, names in os.walk(d) for f in names)

    def section(k):
        return lambda ctx: ctx.spark.range(0, 2000, 1, 4).groupBy((F.col("id") % k).alias("g")).count()

    before = files()
    out = report_bundle(SimpleNamespace(spark=s), str(tmp_path / "bundle"), {f"s{k}": section(k) for k in range(2, 8)})
    assert out.groupBy("section").count().count() == 6 and out.count() == sum(range(2, 8))
    assert files() - before <= 8  # of the two reads above; a job of all sections left those of six


def test_lines_of_a_kept_fact_do_not_travel_to_their_products(large):
    queries()
    kept = Context(large, SF001, persist=True)
    plain = Context(large, SF001)
    for report in (B.top_products, B.product_growth, B.category_by_year, B.brand_detail, B.store_top_products):
        got = report(kept.wh)
        assert sorted(map(str, got.collect())) == sorted(map(str, report(plain.wh).collect())), report
        # Lines meet the few groups of products; only returns meet products.
        assert "Join [product_group#" in _plan(got) and (report is B.brand_detail or "Join [product_sk#" not in _plan(got)), report
    assert "product_group" in kept.wh.fact_sales.columns and "product_group" not in REGISTRY["fact_sales"](kept).columns


def test_store_of_an_order_needs_no_window_over_its_lines(spark):
    lines = Sources(Tables(spark, SF001))._lines
    assert _plan(lines).count("Window [") == 1
