"""Customer mart (M): one row per known customer with sales.

Distinct orders are counted without an Expand: lines are first summed per
(customer, sale) — the fact is already hash-partitioned by sale, so that step
needs no shuffle — and the per-order rows are then summed per customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import MONEY, round_div
from ..functions.output import attach
from .warehouse import UNKNOWN_SK

CLTV_COLUMNS = ["customer_sk", "customer_nk", "name", "num_orders", "num_lines",
                "first_purchase", "last_purchase", "tenure_days", "recency_days",
                "gross_revenue", "net_revenue", "total_cost", "gross_margin", "margin_pct",
                "aov", "monthly_frequency", "units_bought", "units_returned",
                "return_rate", "return_rate_raw", "cltv"]


def _sale_date(d_date: DataFrame) -> DataFrame:
    return d_date.select("date_sk", "date")


def customer_360(f_sales: DataFrame, d_date: DataFrame, d_customer: DataFrame,
                 as_of=None) -> DataFrame:
    """M01. ``as_of`` (a date string) fixes recency; default = last sale date."""
    f = (f_sales.filter(F.col("customer_sk") != UNKNOWN_SK)
         .join(_sale_date(d_date), "date_sk", "inner"))
    per_order = f.groupBy("customer_sk", "sale_id").agg(
        F.count(F.lit(1)).alias("l"), F.min("date").alias("d0"), F.max("date").alias("d1"),
        F.sum("quantity").alias("u"), F.sum("gross_amount").alias("g"),
        F.sum("net_amount").alias("n"), F.sum("cost_amount").alias("c"),
        F.sum("gross_margin").alias("m"), F.sum("returned_qty").alias("r"))
    v = per_order.groupBy("customer_sk").agg(
        F.count(F.lit(1)).alias("num_orders"), F.sum("l").alias("num_lines"),
        F.min("d0").alias("first_purchase"), F.max("d1").alias("last_purchase"),
        F.sum("u").cast("long").alias("units_bought"),
        F.sum("g").cast(MONEY).alias("gross_revenue"),
        F.sum("n").cast(MONEY).alias("net_revenue"),
        F.sum("c").cast(MONEY).alias("total_cost"),
        F.sum("m").cast(MONEY).alias("gross_margin"),
        F.sum("r").cast("long").alias("units_returned"))
    if as_of is None:
        ref = d_date.agg(F.max("date").alias("_as_of"))
    else:
        ref = f_sales.sparkSession.range(1).select(F.lit(as_of).cast("date").alias("_as_of"))
    dc = d_customer.select("customer_sk", F.col("customer_nk"),
                           F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("name"))
    m = v.join(dc, "customer_sk", "inner").transform(attach, ref)
    tenure = F.datediff("last_purchase", "first_purchase")
    gross, net, orders = F.col("gross_revenue"), F.col("net_revenue"), F.col("num_orders")
    units, returned = F.col("units_bought"), F.col("units_returned")
    margin_pct = F.when(gross > 0, round_div(F.col("gross_margin") * 100, gross, 2)) \
        .otherwise(F.lit(0).cast("decimal(18,2)"))
    rr_raw = F.when(units > 0, round_div(returned * 100, units, 2)) \
        .otherwise(F.lit(0).cast("decimal(18,2)"))
    freq = F.when(tenure > 30, round_div(orders * 30, tenure, 4)) \
        .otherwise(orders.cast("decimal(18,4)"))
    out = m.select(
        "customer_sk", "customer_nk", "name", "num_orders", "num_lines",
        "first_purchase", "last_purchase", tenure.alias("tenure_days"),
        F.datediff("_as_of", "last_purchase").alias("recency_days"),
        "gross_revenue", "net_revenue", "total_cost", "gross_margin",
        margin_pct.alias("margin_pct"),
        round_div(net, orders, 2).alias("aov"),
        freq.alias("monthly_frequency"),
        "units_bought", "units_returned",
        F.least(rr_raw, F.lit(100).cast("decimal(18,2)")).alias("return_rate"),
        rr_raw.alias("return_rate_raw"),
        F.round(net * margin_pct * F.lit("0.01").cast("decimal(3,2)"), 2).cast(MONEY).alias("cltv"))
    return out


def assign_clusters(mart: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach cluster id and label by key (a join, not per-row updates)."""
    lab = labels.select("customer_sk", "cluster_id", "cluster_label")
    return mart.drop("cluster_id", "cluster_label").join(lab, "customer_sk", "left")


def customer_zone(f_sales: DataFrame, d_zone: DataFrame) -> DataFrame:
    """Per customer, the zone with most lines (ties: lowest zone key, F21)."""
    f = f_sales.filter(F.col("customer_sk") != UNKNOWN_SK)
    per = f.groupBy("customer_sk", "zone_sk").agg(F.count(F.lit(1)).alias("lines"))
    w = Window.partitionBy("customer_sk").orderBy(F.col("lines").desc(), F.col("zone_sk"))
    top = per.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    z = d_zone.select("zone_sk", "area_type", "orientation", "district")
    return top.join(z, "zone_sk", "left").select(
        "customer_sk", "zone_sk", "district", "area_type", "orientation", "lines")
