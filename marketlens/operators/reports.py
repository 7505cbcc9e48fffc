"""Business reports (B): aggregates over the star schema.

Every report reads ``fact_sales`` / ``fact_returns`` plus the dimensions it
needs. Year and month come from the yyyymmdd date key by integer arithmetic,
so no date-dimension join is needed. Top-k reports end in ``orderBy().limit``
(TakeOrderedAndProject: a k-row heap per task, no global sort); ties are
broken by name so results are deterministic (F21). Reports that need two
distinct counts aggregate per order first (the fact is partitioned by order)
instead of letting Catalyst expand every row per distinct column.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import MONTH_NAMES, month_abbr, month_label, month_name
from ..functions.exact import MONEY, ratio, round_div
from ..functions.output import attach
from .warehouse import UNKNOWN_SK, Warehouse

MONTHS = list(range(1, 13))


def _div(c, k):
    return F.call_function("div", c, F.lit(k))


def with_period(f: DataFrame) -> DataFrame:
    return (f.withColumn("year", _div(F.col("date_sk"), 10000).cast("int"))
            .withColumn("month", (_div(F.col("date_sk"), 100) % 100).cast("int")))


def avg_pct(c: str = "margin_pct", scale: int = 2):
    """ROUND(AVG(c), scale) over exact decimals."""
    return round_div(F.sum(c), F.count(c), scale)


def _products(w: Warehouse) -> DataFrame:
    return w.dim_product.select("product_sk", F.col("name").alias("product"), "category", "brand")


def _sales(w: Warehouse) -> tuple[DataFrame, DataFrame, str]:
    """Fact lines, the names of what they sell, and the column that joins both: the kept fact knows the group of products of one
    name, category and brand, of which there are few; other facts join every product."""
    f = w.fact_sales
    return (f, w.product_groups, "product_group") if "product_group" in f.columns else (f, _products(w), "product_sk")


def _grouped_products(w: Warehouse, *keys: str, only=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fact lines with ``group``, (joining column, group) of the products, and (group, keys): products grouped by ``keys``. A group
    is a long, so that lines and orders travel with it instead of names."""
    f, p, link = _sales(w)
    p = p if only is None else p.filter(only)
    groups = p.groupBy(*keys).agg(F.min(link).alias("group"))
    same = reduce(and_, [F.col(f"p.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys])
    products = p.alias("p").join(groups.alias("g"), same).select(f"p.{link}", "g.group")
    return f.join(products, link, "inner"), products, groups


def _order_counts(lines: DataFrame, *keys: str) -> DataFrame:
    """Distinct orders per ``keys``: only the pairs travel."""
    return lines.select(*keys, "sale_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("num_orders"))


def _sales_products(w: Warehouse) -> DataFrame:
    f, products, link = _sales(w)
    return f.join(products, link, "inner")


def _known_stores(w: Warehouse) -> DataFrame:
    return w.dim_store.filter(F.col("store_sk") != UNKNOWN_SK).select("store_sk", F.col("name").alias("store"))


def _nonempty(c: str):
    return F.col(c).isNotNull() & (F.col(c) != "")


def _rank(df: DataFrame, *order) -> DataFrame:
    """1-based rank inside an already-limited (k-row) result."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _from_year(f: DataFrame, first_year) -> DataFrame:
    """Facts from ``first_year`` on, when the table carries its ``year`` partition
    column (the built warehouse): the bound, a scalar subquery, prunes whole year
    folders at run time. Tables without it are returned unchanged (callers filter
    on the date key as well)."""
    return f.filter(F.col("year") >= first_year) if "year" in f.columns else f


def _latest_month(f: DataFrame) -> DataFrame:
    """One row: the latest (year, month) pair with sales (F2) and its neighbours.
    On a year-partitioned table only the last year's folder is read (its number
    comes from the partition listing)."""
    if "year" in f.columns:
        f = f.filter(F.col("year") == f.agg(F.max("year")).scalar())
    p = with_period(f).agg(F.max(F.col("year") * 100 + F.col("month")).alias("ym"))
    first = F.make_date(_div(F.col("ym"), 100), F.col("ym") % 100, F.lit(1))
    return p.select(F.col("ym"), first.alias("d"))


def _ym(d):
    return (F.year(d) * 100 + F.month(d)).cast("int")


# -- B01 ---------------------------------------------------------------------
def global_kpis(w: Warehouse, mart: DataFrame) -> DataFrame:
    f = w.fact_sales
    per_order = f.groupBy("sale_id").agg(
        F.sum("net_amount").alias("n"), F.sum("gross_amount").alias("g"),
        F.sum("unit_price").alias("up"), F.count("unit_price").alias("upc"),
        F.sum("margin_pct").alias("mp"), F.count("margin_pct").alias("mpc"),
        F.sum("returned_qty").alias("r"), F.sum("quantity").alias("q"))
    sales = per_order.agg(
        F.sum("n").cast(MONEY).alias("net_revenue"), F.sum("g").cast(MONEY).alias("gross_revenue"),
        round_div(F.sum("up"), F.sum("upc"), 2).alias("avg_unit_price"),
        round_div(F.sum("mp"), F.sum("mpc"), 2).alias("avg_margin_pct"),
        F.count(F.lit(1)).alias("num_orders"),
        round_div(F.sum("r") * 100, F.sum("q"), 2).alias("return_rate"))
    rets = w.fact_returns.agg(F.count(F.lit(1)).alias("num_returns"),
                              F.sum("returned_amount").cast(MONEY).alias("returned_amount"))
    cust = mart.filter(F.col("cltv").isNotNull()).agg(
        F.count(F.lit(1)).alias("num_customers"),
        round_div(F.sum("recency_days"), F.count("recency_days"), 1).alias("avg_recency_days"))
    return sales.transform(attach, rets, cust)


def pct_change(a, b):
    """round((a - b) / abs(b) * 100, 1); null when b is null or 0."""
    return round_div((a - b) * 100, F.abs(b), 1)


# -- B02 ---------------------------------------------------------------------
def month_comparison(w: Warehouse) -> DataFrame:
    first_ym = _latest_month(w.fact_sales).select(_ym(F.add_months("d", -12)).alias("m")).scalar()
    f = with_period(_from_year(w.fact_sales, _div(first_ym, 100)))
    monthly = (f.groupBy("year", "month", "sale_id").agg(F.sum("net_amount").alias("n"))
               .groupBy("year", "month").agg(F.sum("n").cast(MONEY).alias("net"),
                                             F.count(F.lit(1)).alias("orders"))
               .withColumn("ym", (F.col("year") * 100 + F.col("month")).cast("int")))
    lm = _latest_month(w.fact_sales).select(
        F.col("ym").alias("ym_cur"), _ym(F.add_months("d", -1)).alias("ym_prev"),
        _ym(F.add_months("d", -12)).alias("ym_ly"))

    def pick(alias, key):
        m = monthly.select(F.col("ym").alias(key), F.col("net").alias(f"{alias}_net"),
                           F.col("orders").alias(f"{alias}_orders"))
        return m
    out = (lm.join(pick("cur", "ym_cur"), "ym_cur", "left")
           .join(pick("prev", "ym_prev"), "ym_prev", "left")
           .join(pick("ly", "ym_ly"), "ym_ly", "left"))
    return out.select(
        _div(F.col("ym_cur"), 100).alias("year"), (F.col("ym_cur") % 100).alias("month"),
        F.coalesce("cur_net", F.lit(0).cast(MONEY)).alias("net_revenue"),
        F.coalesce("cur_orders", F.lit(0)).alias("num_orders"),
        F.col("prev_net").alias("prev_month_net"), F.col("ly_net").alias("last_year_net"),
        pct_change(F.coalesce("cur_net", F.lit(0)), F.col("prev_net")).alias("pct_vs_prev_month"),
        pct_change(F.coalesce("cur_net", F.lit(0)), F.col("ly_net")).alias("pct_vs_last_year"),
        pct_change(F.coalesce("cur_orders", F.lit(0)), F.col("prev_orders")).alias("pct_orders_vs_prev"))


# -- B03 ---------------------------------------------------------------------
def trailing_12_months(w: Warehouse) -> DataFrame:
    # First day key (yyyymm00) of the window, a scalar subquery: the facts are
    # filtered on their own date key, no join.
    cut = (_latest_month(w.fact_sales)
           .select((_ym(F.add_months("d", -11)) * 100).alias("cut")).scalar())
    f = with_period(_from_year(w.fact_sales, _div(cut, 10000)).filter(F.col("date_sk") >= cut))
    sales = (f.groupBy("year", "month", "sale_id").agg(F.sum("net_amount").alias("n"))
             .groupBy("year", "month").agg(F.sum("n").cast(MONEY).alias("net_revenue"),
                                           F.count(F.lit(1)).alias("num_orders")))
    r = with_period(w.fact_returns.filter(F.col("date_sk") >= cut))
    rets = r.groupBy("year", "month").agg(F.count(F.lit(1)).alias("num_returns"))
    out = sales.join(rets, ["year", "month"], "left").fillna(0, ["num_returns"])
    return out.select(
        "year", "month", month_label(F.col("year"), F.col("month")).alias("label"),
        "net_revenue", "num_orders", "num_returns",
        round_div(F.col("num_returns") * 100, F.col("num_orders"), 2).alias("return_ratio"))


# -- B04 ---------------------------------------------------------------------
def top_products_latest_month(w: Warehouse, n: int = 3) -> DataFrame:
    lm = _latest_month(w.fact_sales).select(
        _div(F.col("ym"), 100).cast("int").alias("year"), (F.col("ym") % 100).cast("int").alias("month"))
    f, products, link = _sales(w)
    f = with_period(_from_year(f, lm.select("year").scalar())).join(
        F.broadcast(lm), ["year", "month"], "inner")
    agg = (f.join(products, link, "inner").groupBy("product")
           .agg(F.sum("net_amount").cast(MONEY).alias("net_revenue")))
    top = agg.orderBy(F.col("net_revenue").desc(), F.col("product").asc_nulls_last()).limit(n)
    return _rank(top, F.col("net_revenue").desc(), F.col("product").asc_nulls_last())


# -- B05 ---------------------------------------------------------------------
def peak_month(w: Warehouse) -> DataFrame:
    f = with_period(w.fact_sales)
    agg = f.groupBy("month").agg(F.sum("net_amount").cast(MONEY).alias("net_revenue"))
    top = agg.orderBy(F.col("net_revenue").desc(), F.col("month")).limit(1)
    return top.select("month", month_name(F.col("month")).alias("month_name"), "net_revenue")


# -- B07 ---------------------------------------------------------------------
def monthly_evolution(w: Warehouse) -> DataFrame:
    f = with_period(w.fact_sales)
    return f.groupBy("year", "month").agg(
        F.sum("net_amount").cast(MONEY).alias("net_revenue"),
        F.sum("gross_amount").cast(MONEY).alias("gross_revenue")).select(
        "year", "month", month_label(F.col("year"), F.col("month")).alias("label"),
        "net_revenue", "gross_revenue")


# -- B08 ---------------------------------------------------------------------
def product_totals(w: Warehouse) -> DataFrame:
    """Per (name, category, brand): net, units, avg line margin %, distinct orders."""
    f, _, groups = _grouped_products(w, "product", "category", "brand")
    sums = f.groupBy("group").agg(
        F.sum("net_amount").cast(MONEY).alias("net_revenue"), F.sum("quantity").cast("long").alias("units"),
        avg_pct().alias("avg_margin_pct"))
    return groups.join(sums.join(_order_counts(f, "group"), "group"), "group").select(
        "product", "category", "brand", "net_revenue", "units", "avg_margin_pct", "num_orders")


def _top_order():
    return [F.col("net_revenue").desc(), F.col("product").asc_nulls_last(),
            F.col("category").asc_nulls_last(), F.col("brand").asc_nulls_last()]


def top_products(w: Warehouse, n: int = 15) -> DataFrame:
    top = product_totals(w).orderBy(*_top_order()).limit(n)
    return _rank(top, *_top_order())


# -- B09 ---------------------------------------------------------------------
def sales_by_store(w: Warehouse) -> DataFrame:
    f = w.fact_sales.join(_known_stores(w), "store_sk", "inner")
    return (f.groupBy("store", "sale_id").agg(F.sum("net_amount").alias("n"))
            .groupBy("store").agg(F.sum("n").cast(MONEY).alias("net_revenue"),
                                  F.count(F.lit(1)).alias("num_orders")))


# -- B10 ---------------------------------------------------------------------
def seasonality(w: Warehouse) -> DataFrame:
    """Year x month pivot of net revenue, missing months = 0."""
    f = with_period(w.fact_sales)
    p = f.groupBy("year").pivot("month", MONTHS).agg(F.sum("net_amount").cast(MONEY))
    return p.select("year", *[F.coalesce(F.col(str(m)), F.lit(0).cast(MONEY)).alias(f"m{m:02d}")
                              for m in MONTHS])


# -- B11 / B12 / B13 / B14 -----------------------------------------------------
def return_kpis(w: Warehouse) -> DataFrame:
    return w.fact_returns.agg(
        F.count(F.lit(1)).alias("num_returns"),
        F.sum("returned_amount").cast(MONEY).alias("returned_amount"),
        ratio(F.sum("returned_amount"), F.count("returned_amount")).alias("avg_returned_amount"),
        F.sum("returned_qty").cast("long").alias("returned_units"))


def returns_monthly(w: Warehouse) -> DataFrame:
    r = with_period(w.fact_returns)
    return r.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("num_returns"),
        F.sum("returned_amount").cast(MONEY).alias("returned_amount")).select(
        "year", "month", month_label(F.col("year"), F.col("month")).alias("label"),
        "num_returns", "returned_amount")


def returns_by_reason(w: Warehouse) -> DataFrame:
    d = w.dim_return_reason.filter(~F.col("is_unknown")).select("reason_sk", "reason")
    agg = (w.fact_returns.join(d, "reason_sk", "inner").groupBy("reason")
           .agg(F.count(F.lit(1)).alias("num_returns"),
                F.sum("returned_qty").cast("long").alias("returned_units")))
    # The reason list is a bounded code list: ranking it in one task is fine.
    return _rank(agg, F.col("num_returns").desc(), F.col("reason"))


def returns_by_product(w: Warehouse, n: int = 10) -> DataFrame:
    agg = (w.fact_returns.join(_products(w), "product_sk", "inner").groupBy("product")
           .agg(F.count(F.lit(1)).alias("num_returns"),
                F.sum("returned_amount").cast(MONEY).alias("returned_amount"),
                F.sum("returned_qty").cast("long").alias("returned_units")))
    order = [F.col("num_returns").desc(), F.col("product").asc_nulls_last()]
    return _rank(agg.orderBy(*order).limit(n), *order)


# -- B15 ---------------------------------------------------------------------
def product_margin_rank(w: Warehouse, n_high: int = 15, n_low: int = 10) -> DataFrame:
    f = _sales_products(w)

    def agg(keys):
        return (f.groupBy(*keys).agg(avg_pct().alias("avg_margin_pct"),
                                     F.sum("net_amount").cast(MONEY).alias("net_revenue"),
                                     F.sum("quantity").cast("long").alias("units"))
                .filter(F.col("net_revenue") > 0))
    hi_order = [F.col("avg_margin_pct").desc_nulls_last(), F.col("product").asc_nulls_last()]
    lo_order = [F.col("avg_margin_pct").asc_nulls_last(), F.col("product").asc_nulls_last(),
                F.col("category").asc_nulls_last()]
    hi = _rank(agg(["product"]).withColumn("category", F.lit(None).cast("string"))
               .orderBy(*hi_order).limit(n_high), *hi_order).withColumn("side", F.lit("highest"))
    lo = _rank(agg(["product", "category"]).orderBy(*lo_order).limit(n_low), *lo_order) \
        .withColumn("side", F.lit("lowest"))
    return hi.unionByName(lo)


# -- B16 ---------------------------------------------------------------------
def product_return_rate(w: Warehouse, n: int = 12) -> DataFrame:
    """Aggregate each fact per product name first, then join (F4: no fan-out)."""
    p = _products(w).select("product_sk", "product")
    sales = (_sales_products(w).groupBy("product", "sale_id")
             .agg(F.sum("net_amount").alias("n"))
             .groupBy("product").agg(F.sum("n").cast(MONEY).alias("net_revenue"),
                                     F.count(F.lit(1)).alias("num_orders")))
    rets = w.fact_returns.join(p, "product_sk").groupBy("product").agg(
        F.count(F.lit(1)).alias("num_returns"))
    j = sales.join(rets, "product", "left").fillna(0, ["num_returns"])
    j = j.withColumn("return_rate_pct", round_div(F.col("num_returns") * 100, F.col("num_orders"), 1))
    order = [F.col("num_returns").desc(), F.col("product").asc_nulls_last()]
    return _rank(j.orderBy(*order).limit(n), *order).drop("num_orders")


# -- B17 ---------------------------------------------------------------------
def _top_members(w: Warehouse, key: str, top: DataFrame) -> DataFrame:
    """(product_sk, key) of the products whose ``key`` is among the few rows of ``top``: facts meet these products only."""
    return _products(w).join(F.broadcast(top.select(key).distinct()), key, "left_semi").select("product_sk", key)


def _sales_of_top(w: Warehouse, key: str, top: DataFrame) -> DataFrame:
    f, products, link = _sales(w)
    return f.join(products.join(F.broadcast(top.select(key).distinct()), key, "left_semi").select(link, key), link, "inner")


def product_seasonality(w: Warehouse, n: int = 5) -> DataFrame:
    f = with_period(_sales_of_top(w, "product", top_products(w, n)))
    p = f.groupBy("product").pivot("month", MONTHS).agg(F.sum("net_amount").cast(MONEY))
    return p.select("product", *[F.coalesce(F.col(str(m)), F.lit(0).cast(MONEY)).alias(f"m{m:02d}")
                                 for m in MONTHS])


# -- B18 / B19 / B20 -------------------------------------------------------------
def _group_totals(w: Warehouse, key: str) -> DataFrame:
    f, products, groups = _grouped_products(w, key, only=_nonempty(key))
    sums = f.groupBy("group").agg(
        F.sum("net_amount").cast(MONEY).alias("net_revenue"), F.sum("quantity").cast("long").alias("units"),
        avg_pct().alias("avg_margin_pct"))
    sales, _, link = _sales(w)
    sold = sales.select(*dict.fromkeys(("product_sk", link))).distinct().join(products, link).groupBy("group").agg(
        F.count(F.lit(1)).alias("num_products"))
    return groups.join(sums.join(_order_counts(f, "group"), "group").join(sold, "group"), "group").select(
        key, "net_revenue", "units", "avg_margin_pct", "num_orders", "num_products")


def brands(w: Warehouse, n: int = 12) -> DataFrame:
    order = [F.col("net_revenue").desc(), F.col("brand")]
    return _rank(_group_totals(w, "brand").orderBy(*order).limit(n), *order)


def brand_returns(w: Warehouse, n: int = 12) -> DataFrame:
    p = _products(w).filter(_nonempty("brand")).select("product_sk", "brand")
    rets = w.fact_returns.join(p, "product_sk").groupBy("brand").agg(F.count(F.lit(1)).alias("num_returns"))
    marg = _sales_products(w).filter(_nonempty("brand")).groupBy("brand").agg(avg_pct().alias("avg_margin_pct"))
    j = rets.join(marg, "brand", "left")
    order = [F.col("num_returns").desc(), F.col("brand")]
    return _rank(j.orderBy(*order).limit(n), *order)


def categories(w: Warehouse) -> DataFrame:
    return _group_totals(w, "category")


# -- B21 ---------------------------------------------------------------------
def _with_years_grid(keys: DataFrame, years_src: DataFrame, key: str) -> DataFrame:
    """keys x all years with sales (years: one row holding a bounded array)."""
    yrs = years_src.agg(F.sort_array(F.collect_set("year")).alias("years"))
    return keys.transform(attach, yrs).select(key, F.explode("years").alias("year"))


def category_by_year(w: Warehouse, n: int = 6) -> DataFrame:
    f = with_period(_sales_products(w)).filter(_nonempty("category"))
    per = f.groupBy("category", "year").agg(F.sum("net_amount").cast(MONEY).alias("net_revenue"))
    tot = f.groupBy("category").agg(F.sum("net_amount").alias("t"))
    top = tot.orderBy(F.col("t").desc(), F.col("category")).limit(n).select("category")
    grid = _with_years_grid(top, f.select("year"), "category")
    return grid.join(per, ["category", "year"], "left").select(
        "category", "year", F.coalesce("net_revenue", F.lit(0).cast(MONEY)).alias("net_revenue"))


# -- B22 / B23 / B24 -------------------------------------------------------------
def profit_monthly(w: Warehouse) -> DataFrame:
    f = with_period(w.fact_sales)
    return f.groupBy("year", "month").agg(
        F.sum("net_amount").cast(MONEY).alias("net_revenue"),
        F.sum("gross_amount").cast(MONEY).alias("gross_revenue"),
        F.sum("cost_amount").cast(MONEY).alias("total_cost"),
        F.sum("gross_margin").cast(MONEY).alias("gross_margin"),
        avg_pct().alias("avg_margin_pct")).select(
        "year", "month", month_label(F.col("year"), F.col("month")).alias("label"),
        "net_revenue", "gross_revenue", "total_cost", "gross_margin", "avg_margin_pct")


def profit_by_category(w: Warehouse) -> DataFrame:
    f = _sales_products(w).filter(_nonempty("category"))
    return f.groupBy("category").agg(
        F.sum("net_amount").cast(MONEY).alias("net_revenue"),
        F.sum("cost_amount").cast(MONEY).alias("total_cost"),
        F.sum("gross_margin").cast(MONEY).alias("gross_margin"),
        avg_pct().alias("avg_margin_pct"))


def profit_yearly(w: Warehouse) -> DataFrame:
    f = with_period(w.fact_sales)
    a = f.groupBy("year").agg(
        F.sum("net_amount").cast(MONEY).alias("net_revenue"),
        F.sum("gross_amount").cast(MONEY).alias("gross_revenue"),
        F.sum("cost_amount").cast(MONEY).alias("total_cost"),
        F.sum("gross_margin").cast(MONEY).alias("gross_margin"),
        avg_pct().alias("avg_margin_pct"),
        F.sum("quantity").cast("long").alias("units"),
        F.count(F.lit(1)).alias("lines"))
    cust = (f.select("year", "customer_sk").distinct().groupBy("year")
            .agg(F.count(F.lit(1)).alias("distinct_customers")))
    return a.join(cust, "year").withColumn(
        "margin_over_gross_pct", ratio(F.col("gross_margin"), F.col("gross_revenue")) * 100)


# -- B25 / B26 / B27 -------------------------------------------------------------
def store_kpis(w: Warehouse) -> DataFrame:
    f = w.fact_sales.join(_known_stores(w), "store_sk", "inner")
    per_order = f.groupBy("store", "sale_id").agg(
        F.sum("net_amount").alias("n"), F.sum("quantity").alias("u"),
        F.sum("unit_price").alias("up"), F.count("unit_price").alias("uc"),
        F.sum("margin_pct").alias("mp"), F.count("margin_pct").alias("mc"),
        F.sum("returned_qty").alias("r"))
    return per_order.groupBy("store").agg(
        F.sum("n").cast(MONEY).alias("net_revenue"), F.sum("u").cast("long").alias("units"),
        F.count(F.lit(1)).alias("num_orders"),
        round_div(F.sum("up"), F.sum("uc"), 2).alias("avg_unit_price"),
        round_div(F.sum("mp"), F.sum("mc"), 2).alias("avg_margin_pct"),
        (ratio(F.sum("r"), F.sum("u")) * 100).alias("return_rate"))


def store_monthly(w: Warehouse) -> DataFrame:
    """Net per known store and month; months without sales for a store = 0."""
    f = with_period(w.fact_sales.join(_known_stores(w), "store_sk", "inner")) \
        .withColumn("ym", F.col("year") * 100 + F.col("month"))
    per = f.groupBy("store", "ym").agg(F.sum("net_amount").cast(MONEY).alias("net_revenue"))
    months = f.agg(F.sort_array(F.collect_set("ym")).alias("yms"))   # bounded: months with sales
    stores = f.select("store").distinct()
    grid = stores.transform(attach, months).select("store", F.explode("yms").alias("ym"))
    out = grid.join(per, ["store", "ym"], "left")
    y, m = _div(F.col("ym"), 100).cast("int"), (F.col("ym") % 100).cast("int")
    return out.select("store", y.alias("year"), m.alias("month"), month_label(y, m).alias("label"),
                      F.coalesce("net_revenue", F.lit(0).cast(MONEY)).alias("net_revenue"))


def store_top_products(w: Warehouse, n: int = 3) -> DataFrame:
    f, products, link = _sales(w)
    f = f.join(_known_stores(w), "store_sk").join(products.select(link, "product"), link)
    per = f.groupBy("store_sk", "store", "product").agg(F.sum("net_amount").cast(MONEY).alias("net_revenue"))
    win = Window.partitionBy("store_sk").orderBy(F.col("net_revenue").desc(), F.col("product").asc_nulls_last())
    return (per.withColumn("rank", F.row_number().over(win).cast("long")).filter(F.col("rank") <= n)
            .select("store", "product", "net_revenue", "rank"))


# -- B28 / B29 / B30 / B31 -------------------------------------------------------
def year_over_year(w: Warehouse) -> DataFrame:
    f = with_period(w.fact_sales)
    per = f.groupBy("year", "month").agg(F.sum("net_amount").cast(MONEY).alias("net_revenue"))
    yrs = f.agg(F.sort_array(F.collect_set("year")).alias("years"))
    grid = yrs.select(F.explode("years").alias("year"),
                      F.sequence(F.lit(1), F.lit(12)).alias("ms")).select("year", F.explode("ms").alias("month"))
    return grid.join(per, ["year", "month"], "left").select(
        "month", month_abbr(F.col("month")).alias("month_name"), "year",
        F.coalesce("net_revenue", F.lit(0).cast(MONEY)).alias("net_revenue"))


def annual_growth(w: Warehouse) -> DataFrame:
    f = with_period(w.fact_sales)
    per_order = f.groupBy("year", "sale_id", "customer_sk").agg(F.sum("net_amount").alias("n"))
    a = per_order.groupBy("year").agg(F.sum("n").cast(MONEY).alias("net_revenue"),
                                      F.count(F.lit(1)).alias("num_orders"))
    c = (per_order.select("year", "customer_sk").distinct().groupBy("year")
         .agg(F.count(F.lit(1)).alias("active_customers")))
    return a.join(c, "year")


def best_worst_months(w: Warehouse, n: int = 10) -> DataFrame:
    f = with_period(w.fact_sales)
    per = f.groupBy("year", "month").agg(F.sum("net_amount").cast(MONEY).alias("net_revenue")) \
        .withColumn("label", F.concat(month_name(F.col("month")), F.lit(" "), F.col("year").cast("string")))
    best_o = [F.col("net_revenue").desc(), F.col("year"), F.col("month")]
    worst_o = [F.col("net_revenue").asc(), F.col("year"), F.col("month")]
    best = _rank(per.orderBy(*best_o).limit(n), *best_o).withColumn("side", F.lit("best"))
    worst = _rank(per.orderBy(*worst_o).limit(n), *worst_o).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def product_growth(w: Warehouse, n: int = 10) -> DataFrame:
    fs, products, link = _sales(w)
    if "year" in fs.columns:   # the two last years' folders only
        fs = _from_year(fs, fs.agg(F.max("year") - 1).scalar())
    f = with_period(fs)
    last = f.agg(F.max("year")).scalar()
    # Lines of the two last years only, already without the year: they are all that the sums hold.
    two = f.filter(F.col("year") >= last - 1).select(link, (F.col("year") == last).alias("is_last"), "net_amount")
    names = products.select(link, "product")
    z = F.lit(0).cast(MONEY)
    base = two.join(names, link, "inner").groupBy("product").agg(
        F.sum(F.when(~F.col("is_last"), F.col("net_amount")).otherwise(z)).cast(MONEY).alias("prev_net"),
        F.sum(F.when(F.col("is_last"), F.col("net_amount")).otherwise(z)).cast(MONEY).alias("last_net"))
    base = base.filter((F.col("prev_net") > 0) & (F.col("last_net") > 0)).withColumn(
        "growth_pct", round_div((F.col("last_net") - F.col("prev_net")) * 100, F.col("prev_net"), 1))
    up = [F.col("growth_pct").desc(), F.col("product").asc_nulls_last()]
    down = [F.col("growth_pct").asc(), F.col("product").asc_nulls_last()]
    best = _rank(base.orderBy(*up).limit(n), *up).withColumn("side", F.lit("best"))
    worst = _rank(base.orderBy(*down).limit(n), *down).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


# -- B32 / B33 / B34 -------------------------------------------------------------
def product_detail(w: Warehouse, n: int = 15) -> DataFrame:
    top = top_products(w, n)
    members = _top_members(w, "product", top)
    f = with_period(_sales_of_top(w, "product", top))
    monthly = f.groupBy("product", "year", "month").agg(
        F.sum("net_amount").cast(MONEY).alias("net_revenue"),
        F.sum("quantity").cast("long").alias("units"), avg_pct().alias("avg_margin_pct"))
    r = w.fact_returns.join(members, "product_sk")
    rets = r.groupBy("product").agg(F.count(F.lit(1)).alias("product_returns"),
                                    F.sum("returned_amount").cast(MONEY).alias("product_returned_amount"))
    return monthly.join(rets, "product", "left").select(
        "product", "year", "month", month_label(F.col("year"), F.col("month")).alias("label"),
        "net_revenue", "units", "avg_margin_pct",
        F.coalesce("product_returns", F.lit(0)).alias("product_returns"),
        F.coalesce("product_returned_amount", F.lit(0).cast(MONEY)).alias("product_returned_amount"))


def brand_detail(w: Warehouse, n: int = 12) -> DataFrame:
    top = brands(w, n)
    members = _top_members(w, "brand", top)
    f = with_period(_sales_of_top(w, "brand", top))
    month = ("brand", "year", "month")
    sums = f.groupBy(*month).agg(
        F.sum("net_amount").cast(MONEY).alias("net_revenue"), F.sum("quantity").cast("long").alias("units"),
        avg_pct().alias("avg_margin_pct"))
    monthly = sums.join(_order_counts(f, *month), list(month))
    r = w.fact_returns.join(members, "product_sk")
    rets = r.groupBy("brand").agg(F.count(F.lit(1)).alias("brand_returns"))
    return monthly.join(rets, "brand", "left").select(
        "brand", "year", "month", month_label(F.col("year"), F.col("month")).alias("label"),
        "net_revenue", "units", "avg_margin_pct", "num_orders",
        F.coalesce("brand_returns", F.lit(0)).alias("brand_returns"))


def category_by_brand(w: Warehouse, n: int = 12) -> DataFrame:
    top = brands(w, n).select("brand")
    f = _sales_products(w).filter(_nonempty("category")).join(F.broadcast(top), "brand", "left_semi")
    return f.groupBy("brand", "category").agg(F.sum("net_amount").cast(MONEY).alias("net_revenue"))


# -- B35 / B36 -------------------------------------------------------------------
def line_kpis(w: Warehouse) -> DataFrame:
    f = w.fact_sales
    return f.agg(
        F.sum("net_amount").cast(MONEY).alias("net_revenue"),
        F.sum("gross_amount").cast(MONEY).alias("gross_revenue"),
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("long").alias("units"),
        F.sum("gross_margin").cast(MONEY).alias("gross_margin"),
        (ratio(F.sum("gross_margin"), F.sum("gross_amount")) * 100).alias("margin_over_gross_pct"),
        F.sum("returned_qty").cast("long").alias("returned_units"),
        (ratio(F.sum("returned_qty"), F.sum("quantity")) * 100).alias("returned_units_pct"))


def category_margin(w: Warehouse) -> DataFrame:
    f = _sales_products(w)
    return f.groupBy("category").agg(
        F.sum("net_amount").cast(MONEY).alias("net_revenue"),
        F.sum("gross_margin").cast(MONEY).alias("gross_margin")).withColumn(
        "margin_over_net_pct", ratio(F.col("gross_margin"), F.col("net_revenue")) * 100)


# -- B37 .. B41: source-level reports ---------------------------------------------
def order_months(sale: DataFrame) -> DataFrame:
    return sale.groupBy(F.trunc("sale_date", "month").alias("month_start")).agg(
        F.count(F.lit(1)).alias("num_orders"), F.sum("total").cast(MONEY).alias("total"))


def top_products_by_units(sale_item: DataFrame, product: DataFrame, n: int = 10) -> DataFrame:
    per = sale_item.groupBy("product_id").agg(F.sum("quantity").cast("long").alias("units"),
                                              F.sum("subtotal").cast(MONEY).alias("revenue"))
    total = sale_item.agg(F.sum("quantity").alias("all_units"))
    j = per.join(product.select("product_id", "name"), "product_id", "inner")
    order = [F.col("units").desc(), F.col("product_id")]
    top = j.orderBy(*order).limit(n).transform(attach, total)
    return _rank(top.select("product_id", "name", "units", "revenue",
                            round_div(F.col("units") * 100, F.col("all_units"), 2).alias("units_pct")), *order)


def store_order_totals(store: DataFrame, sale: DataFrame) -> DataFrame:
    per = sale.groupBy("store_id").agg(F.count(F.lit(1)).alias("num_orders"),
                                       F.sum("total").cast(MONEY).alias("revenue"))
    return store.select("store_id", "name").join(per, "store_id", "left").select(
        "store_id", "name", F.coalesce("num_orders", F.lit(0)).alias("num_orders"),
        F.coalesce("revenue", F.lit(0).cast(MONEY)).alias("revenue"))


def products_per_brand_category(brand: DataFrame, category: DataFrame,
                                central_product: DataFrame) -> DataFrame:
    by_b = central_product.groupBy("brand_id").agg(F.count(F.lit(1)).alias("n"))
    by_c = central_product.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    b = brand.join(by_b, "brand_id", "left").select(
        F.lit("brand").alias("dimension"), F.col("name"), F.coalesce("n", F.lit(0)).alias("num_products"))
    c = category.join(by_c, "category_id", "left").select(
        F.lit("category").alias("dimension"), F.col("name"), F.coalesce("n", F.lit(0)).alias("num_products"))
    return b.unionByName(c)


def product_offers(product: DataFrame, product_offer: DataFrame, offer: DataFrame) -> DataFrame:
    o = offer.select("offer_id", F.col("name").alias("offer_name"), "discount_percent")
    return (product.select("product_id", F.col("name").alias("product_name"))
            .join(product_offer, "product_id", "inner").join(o, "offer_id", "inner"))


# -- B06 ---------------------------------------------------------------------
def findings(w: Warehouse, mart: DataFrame, labels: DataFrame) -> DataFrame:
    """Key facts in one row: each part is a one-row result of another operator."""
    from . import customers as C
    p80 = C.pareto_80(mart).select(F.col("customers_pct").alias("pct_customers_for_80_cltv"))
    peak = peak_month(w).select(F.col("month_name").alias("peak_month"))
    topp = top_products_latest_month(w, 1).select(F.col("product").alias("top_product_latest_month"))
    reason = returns_by_reason(w).filter(F.col("rank") == 1).select(F.col("reason").alias("top_return_reason"))
    m = C.labelled(mart, labels)
    ch = F.col("cluster_label") == "Champions"
    champ = m.agg(round_div(F.count(F.when(ch, 1)) * 100, F.count(F.lit(1)), 1).alias("champions_customer_pct"),
                  round_div(F.coalesce(F.sum(F.when(ch, F.col("cltv"))), F.lit(0)) * 100, F.sum("cltv"), 1)
                  .alias("champions_cltv_pct"))
    return p80.transform(attach, peak, topp, reason, champ)
