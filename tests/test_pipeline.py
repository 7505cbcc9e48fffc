"""End to end on sf0.001: the W13 pipeline, its checks, reports on the written warehouse."""

import json
import os
import tempfile

import pytest

from marketlens.operators import reports as B
from marketlens.plans.pipeline import BuiltContext, build_warehouse, bundle_values, report_bundle

from .conftest import SF001


@pytest.fixture(scope="module")
def built(spark):
    out = tempfile.mkdtemp(prefix="marketlens-test-wh-")
    return build_warehouse(spark, SF001, os.path.join(out, "wh"), n_init=2, rows_per_bucket=50)


def test_pipeline_checks_and_tables(spark, built):
    assert built["checks"]["total"] == 21
    ctx = BuiltContext(spark, built["out_dir"])
    f = ctx.wh.fact_sales
    assert f.count() == spark.read.parquet(f"{SF001}/lineitem.parquet").count()     # every line kept
    mart = ctx.mart
    assert mart.filter("cluster_label IS NULL").count() == 0
    assert {r.cluster_label for r in mart.select("cluster_label").distinct().collect()} <= {"Champions", "Base", "Churned"}


def test_net_equals_gross_minus_returned_value(spark, built):
    from pyspark.sql import functions as F
    f = BuiltContext(spark, built["out_dir"]).wh.fact_sales
    r = f.agg(F.sum("net_amount").alias("n"), F.sum("gross_amount").alias("g"),
              F.sum(F.round(F.col("returned_qty") * F.col("unit_price"), 2)).alias("r")).first()
    assert abs(r.n - (r.g - r.r)) <= 0.01 * f.count()


def test_report_bundle_writes_every_section_and_its_values(spark, built):
    ctx = BuiltContext(spark, built["out_dir"])
    out = tempfile.mkdtemp(prefix="marketlens-test-json-")
    sections = {"kpis": lambda c: B.global_kpis(c.wh, c.mart), "monthly": lambda c: B.monthly_evolution(c.wh),
                "nothing": lambda c: B.monthly_evolution(c.wh).limit(0)}
    rows = report_bundle(ctx, os.path.join(out, "bundle"), sections)
    got = {}
    for r in rows.collect():
        got.setdefault(r.section, []).append(json.loads(r.row))
    assert set(got) == {"kpis", "monthly"} and len(got["kpis"]) == 1
    want = B.global_kpis(ctx.wh, ctx.mart).first()
    assert got["kpis"][0]["num_orders"] == want.num_orders and abs(got["kpis"][0]["net_revenue"] - float(want.net_revenue)) < 0.005
    per = {(r.section, r.column_name): r for r in bundle_values(rows).collect()}
    monthly = B.monthly_evolution(ctx.wh).collect()
    assert per["monthly", "year"].n_values == len(monthly) and per["monthly", "label"].chars == sum(len(r.label) for r in monthly)
    assert abs(per["monthly", "net_revenue"].total - float(sum(r.net_revenue for r in monthly))) < 0.01


def test_segment_sections_use_the_labels_of_the_mart(spark):
    from marketlens.plans.context import Context
    from marketlens.plans.queries_all import SEGMENT_SECTIONS
    c = Context.shared(spark, SF001)
    own = {r.customer_sk: r.cluster_label for r in c.segmentation[0].collect()}
    for name in ("cltv_scatter", "cluster_scatter", "top_customers"):
        rows = SEGMENT_SECTIONS[name](c).collect()
        assert rows and all(r.cluster_label == own[r.customer_sk] for r in rows)
    sizes = {r.cluster_label: r.customers for r in SEGMENT_SECTIONS["cluster_distribution"](c).collect()}
    assert sizes == {k: list(own.values()).count(k) for k in set(own.values())}


def test_a_run_that_fails_leaves_the_published_one(spark, built, monkeypatch):
    from marketlens.plans import pipeline as P
    base = os.path.dirname(built["out_dir"])
    before = BuiltContext.latest(spark, base).wh.fact_sales.count()

    def fail(*_, **__):
        raise RuntimeError("half-way")

    monkeypatch.setattr(P.M, "assign_clusters", fail)
    with pytest.raises(RuntimeError, match="half-way"):
        build_warehouse(spark, SF001, base, n_init=1)
    latest = BuiltContext.latest(spark, base)
    assert latest.out_dir == built["out_dir"] and latest.wh.fact_sales.count() == before


def test_lines_are_read_without_an_exchange(spark, built):
    from marketlens.operators import warehouse as W
    ctx = BuiltContext(spark, built["out_dir"])
    w, stg = ctx.wh, ctx.src
    plans = {"fact_returns": W.fact_returns(stg.return_item, w.fact_sales, w.dim_product, w.dim_return_reason, w.dim_date),
             "store_kpis": B.store_kpis(w), "global_kpis": w.fact_sales.groupBy("sale_id").count(), "sales_by_store": B.sales_by_store(w)}
    for name, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(sale_id" not in plan and ", sale_id" not in "".join(
            x for x in plan.splitlines() if "Exchange hashpartitioning" in x), name


def test_staging_observes_what_a_profile_would_count(spark, built):
    from marketlens.sources.binding import bind, roles
    from marketlens.sources.profile import profile_of
    ctx = BuiltContext(spark, built["out_dir"])
    key = lambda r: (r.table_name, r.position)
    assert sorted(map(tuple, ctx.profile.collect())) == sorted(map(tuple, ctx.profile.collect()))
    seen, counted = sorted(ctx.profile.collect(), key=key), sorted(profile_of(roles(bind(spark, SF001))).collect(), key=key)
    assert [tuple(r) for r in seen] == [tuple(r) for r in counted] and len(seen) == 70


def test_registry_has_oracle_or_is_declared_rows_only():
    from marketlens.plans.registry import queries
    from oracles.all import ORACLES
    q, o = queries(), ORACLES
    rows_only = {"cltv_scatter", "kmeans", "cluster_labels", "silhouette_sweep",
                 "assign_clusters", "pca_sample"}
    assert set(o) <= set(q)
    assert set(q) - set(o) == rows_only


def test_warehouse_summary_counts_written_tables(spark, built):
    from marketlens.plans.pipeline import warehouse_summary
    got = {(r.layer, r.table_name): r.row_count for r in warehouse_summary(spark, built["out_dir"]).collect()}
    assert len(got) == 23
    assert got[("dwh", "fact_sales")] == got[("stg", "sale_item")]
    assert got[("dwh", "dim_customer")] == got[("stg", "customer")] + 1


def test_window_reports_prune_year_partitions(spark, built):
    from marketlens.plans.context import Context
    wh = BuiltContext(spark, built["out_dir"]).wh
    assert "year" in wh.fact_sales.columns
    plan = B.trailing_12_months(wh)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    got = sorted(tuple(r) for r in B.trailing_12_months(wh).collect())
    ref = sorted(tuple(r) for r in B.trailing_12_months(Context(spark, SF001).wh).collect())
    assert got == ref
