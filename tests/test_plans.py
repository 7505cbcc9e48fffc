"""Physical plan shape: no pair-producing joins, one-row totals as scalar subqueries."""

import pytest

import __spark_entry__ as E

from .conftest import SF001

PAIR_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(spark, name):
    df = E.queries()[name](spark, SF001)
    spark.conf.set("spark.sql.maxPlanStringLength", str(2**31 - 16))   # inspect the whole plan
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", "100000")


@pytest.mark.parametrize("name", [
    "trailing_12_months", "top_customers", "global_kpis", "rfm_matrix", "customer_360",
    "standardize", "cltv_log_histogram", "metric_histogram", "store_monthly", "product_growth",
    "quality_score", "certification", "check_report", "executive_summary", "findings"])
def test_no_pair_joins(spark, name):
    plan = _plan(spark, name)
    assert not [k for k in PAIR_JOINS if k in plan], plan


def test_totals_are_scalar_subqueries(spark):
    plan = _plan(spark, "top_customers")
    assert "Subquery" in plan and "TakeOrderedAndProject" in plan
