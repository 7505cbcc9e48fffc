"""Registers every operator of the build list under its query key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import warehouse as W
from .registry import register


# ---------------------------------------------------------------- warehouse
@register("stage_snapshot")
def q_stage_snapshot(c):
    return W.stage_snapshot(c.profile)


@register("dim_date")
def q_dim_date(c):
    return c.wh.dim_date


@register("dim_customer")
def q_dim_customer(c):
    return c.wh.dim_customer.select("customer_sk", "customer_nk", "first_name", "last_name", "is_unknown")


@register("dim_product")
def q_dim_product(c):
    return c.wh.dim_product.select("product_sk", "product_nk", "name", "category", "brand",
                                   "price", "unit_cost", "margin_pct", "is_unknown")


@register("dim_store")
def q_dim_store(c):
    return c.wh.dim_store.select("store_sk", "store_nk", "name", "city", "postal_code", "is_unknown")


@register("dim_zone")
def q_dim_zone(c):
    return c.wh.dim_zone


@register("dim_offer")
def q_dim_offer(c):
    return c.wh.dim_offer.select("offer_sk", "offer_nk", "name", "discount_pct", "is_no_offer")


@register("dim_return_reason")
def q_dim_return_reason(c):
    return c.wh.dim_return_reason


@register("returns_by_line")
def q_returns_by_line(c):
    return c.wh.returns_by_line


@register("fact_sales")
def q_fact_sales(c):
    return c.wh.fact_sales.drop("product_group")


@register("fact_returns")
def q_fact_returns(c):
    return c.wh.fact_returns


# --------------------------------------------------------------------- mart
@register("customer_360")
def q_customer_360(c):
    return c.mart


@register("customer_zone")
def q_customer_zone(c):
    return c.customer_zone


# ------------------------------------------------------------------ reports
from ..operators import reports as B  # noqa: E402

for _name, _fn in {
    "month_comparison": B.month_comparison,
    "trailing_12_months": B.trailing_12_months,
    "top_products_latest_month": B.top_products_latest_month,
    "peak_month": B.peak_month,
    "monthly_evolution": B.monthly_evolution,
    "top_products": B.top_products,
    "sales_by_store": B.sales_by_store,
    "seasonality": B.seasonality,
    "return_kpis": B.return_kpis,
    "returns_monthly": B.returns_monthly,
    "returns_by_reason": B.returns_by_reason,
    "returns_by_product": B.returns_by_product,
    "product_margin_rank": B.product_margin_rank,
    "product_return_rate": B.product_return_rate,
    "product_seasonality": B.product_seasonality,
    "brands": B.brands,
    "brand_returns": B.brand_returns,
    "categories": B.categories,
    "category_by_year": B.category_by_year,
    "profit_monthly": B.profit_monthly,
    "profit_by_category": B.profit_by_category,
    "profit_yearly": B.profit_yearly,
    "store_kpis": B.store_kpis,
    "store_monthly": B.store_monthly,
    "store_top_products": B.store_top_products,
    "year_over_year": B.year_over_year,
    "annual_growth": B.annual_growth,
    "best_worst_months": B.best_worst_months,
    "product_growth": B.product_growth,
    "product_detail": B.product_detail,
    "brand_detail": B.brand_detail,
    "category_by_brand": B.category_by_brand,
    "line_kpis": B.line_kpis,
    "category_margin": B.category_margin,
}.items():
    register(_name)((lambda f: lambda c: f(c.wh))(_fn))


@register("global_kpis")
def q_global_kpis(c):
    return B.global_kpis(c.wh, c.with_fact().mart)


@register("order_months")
def q_order_months(c):
    return B.order_months(c.src.sale)


@register("top_products_by_units")
def q_top_products_by_units(c):
    return B.top_products_by_units(c.src.sale_item, c.src.product)


@register("store_order_totals")
def q_store_order_totals(c):
    return B.store_order_totals(c.src.store, c.src.sale)


@register("products_per_brand_category")
def q_products_per_brand_category(c):
    s = c.src
    return B.products_per_brand_category(s.brand, s.category, s.central_product)


@register("product_offers")
def q_product_offers(c):
    s = c.src
    return B.product_offers(s.product, s.product_offer, s.offer)


# ------------------------------------------------------------------ quality
from ..operators import quality as Q  # noqa: E402
from ..operators import repairs as R  # noqa: E402
from ..sources.binding import roles  # noqa: E402
from ..sources.profile import profile_of  # noqa: E402

DESCRIBE_COLUMNS = ("quantity", "unit_price", "subtotal")


def _t(c):
    return roles(c.src)


def _delta(c):
    after = R.repaired_tables(_t(c))
    return Q.quality_score_delta(_t(c), c.profile, after, profile_of(after))


for _name, _fn in {
    "table_row_counts": lambda c: Q.table_row_counts(c.profile),
    "rows_by_system": lambda c: Q.rows_by_system(c.profile),
    "null_profile": lambda c: Q.null_profile(c.profile),
    "null_summary": lambda c: Q.null_summary(Q.null_profile(c.profile)),
    "exact_duplicates": lambda c: Q.exact_duplicates(_t(c)),
    # customer first/last names are unique in the binding; product (name, category) repeats
    "logical_duplicates": lambda c: Q.logical_duplicates(c.src.product, ("name", "category")),
    "length_distribution": lambda c: Q.length_distribution(c.raw.customer, "c_name", 18),
    "email_format": lambda c: Q.email_format(c.raw.pages, "url"),
    "postal_format": lambda c: Q.postal_format(c.src.city_zone, "postal_code"),
    "date_range": lambda c: Q.date_range(c.src.sale),
    "price_ranges": lambda c: Q.price_ranges(c.src.product, c.src.central_product),
    "line_ranges": lambda c: Q.line_ranges(c.profile),
    "product_margins": lambda c: Q.product_margins(c.src.product, c.src.central_product),
    "fk_orphans": lambda c: Q.fk_orphans(_t(c)),
    "order_total_mismatch": lambda c: Q.order_total_mismatch(c.src.sale, c.src.sale_item),
    "line_subtotal_mismatch": lambda c: Q.line_subtotal_mismatch(c.src.sale_item),
    "margin_by_category": lambda c: Q.margin_by_category(c.src.product, c.src.central_product, c.src.category),
    "returns_before_sale": lambda c: Q.returns_before_sale(c.src.return_item, c.src.sale_item, c.src.sale),
    "sales_outside_offer": lambda c: Q.sales_outside_offer(c.src.sale_item, c.src.sale, c.src.offer),
    "quality_score": lambda c: Q.quality_score(_t(c), c.profile),
    "store_opening_check": lambda c: Q.store_opening_check(c.src.store, c.src.sale),
    "quality_score_delta": lambda c: _delta(c),
    "issue_rollup": lambda c: Q.issue_rollup(Q.issue_list(_t(c), c.profile)),
    "issue_impact": lambda c: Q.issue_impact(c.src.sale_item, c.src.sale, c.src.product, c.src.central_product),
    "range_battery": lambda c: Q.range_battery(c.src.product, c.src.central_product, c.profile),
    "certification": lambda c: Q.certification(_t(c), c.profile),
    "catalog_overlap": lambda c: Q.catalog_overlap(c.src.product, c.src.central_product),
    "describe": lambda c: Q.describe(c.src.sale_item, DESCRIBE_COLUMNS),
    "price_points": lambda c: Q.price_points(c.src.sale_item),
    "category_share": lambda c: Q.category_share(c.src.product),
    "offer_usage": lambda c: Q.offer_usage(c.src.sale_item),
    "customer_coverage": lambda c: Q.customer_coverage(c.src.customer, c.src.sale),
    "return_share_of_lines": lambda c: Q.return_share_of_lines(c.src.return_item, c.src.sale_item),
    # repairs
    "repair_price": lambda c: R.repair_price(c.src.product, c.src.central_product).select("product_id", "price"),
    "repair_line_subtotal": lambda c: R.repair_line_subtotal(c.src.sale_item).select("sale_item_id", "subtotal"),
    "repair_order_total": lambda c: R.repair_order_total(
        c.src.sale, R.repair_line_subtotal(c.src.sale_item)).select("sale_id", "total"),
    "repair_snapshot": lambda c: R.repair_snapshot(_t(c)),
    "repair_log": lambda c: R.repair_log(_t(c)),
}.items():
    register(_name)(_fn)


# ------------------------------------------------------------------ checks
from ..operators import checks as V  # noqa: E402


def _checks(c):
    return V.all_checks(c.wh, c.src)


for _name, _ids in V.GROUPS.items():
    register(_name)((lambda ids: lambda c: V.check_rows([k for k in _checks(c) if k.id in ids]))(_ids))
register("check_report")(lambda c: V.check_report(_checks(c)))


# ------------------------------------------------------ customer analytics
from ..operators import customers as C  # noqa: E402

LOOKUP_TERM = "00000012"


def _labels(c):
    return C.tercile_labels(c.mart)


for _name, _fn in {
    "cltv_kpis": lambda c: C.cltv_kpis(c.mart),
    "cltv_top_share": lambda c: C.cltv_top_share(c.mart),
    "cltv_log_histogram": lambda c: C.cltv_log_histogram(c.mart),
    "metric_histogram": lambda c: C.metric_histogram(c.mart),
    "cltv_by_tenure": lambda c: C.cltv_by_tenure(c.mart),
    "orders_band": lambda c: C.orders_band(c.mart),
    "pareto_curve": lambda c: C.pareto_curve(c.mart),
    "pareto_80": lambda c: C.pareto_80(c.mart),
    "lorenz_curve": lambda c: C.lorenz_curve(c.mart),
    "lorenz_top_80": lambda c: C.lorenz_top_80(c.mart),
    "gini": lambda c: C.gini(c.mart),
    "rfm_matrix": lambda c: C.rfm_matrix(c.mart),
    "cohorts": lambda c: C.cohorts(c.mart),
    "top_customers": lambda c: C.top_customers(c.mart, _labels(c)),
    "cltv_by_zone": lambda c: C.cltv_by_zone(c.with_fact().mart, c.customer_zone),
    "metric_correlation": lambda c: C.metric_correlation(c.mart),
    "high_return_profile": lambda c: C.high_return_profile(c.mart),
    "return_rate_anomalies": lambda c: C.return_rate_anomalies(c.mart),
    "metric_stats": lambda c: C.metric_stats(c.mart),
    "customer_percentile": lambda c: C.customer_percentile(c.mart),
    "customer_lookup": lambda c: C.customer_lookup(c.mart, name_term=LOOKUP_TERM),
    "customer_vs_segment": lambda c: C.customer_vs_segment(c.mart, _labels(c)),
    "health_score": lambda c: C.health_score(c.mart, _labels(c)),
    "health_light": lambda c: C.health_light(c.wh.fact_sales, c.mart),
    "cltv_scatter": lambda c: C.cltv_scatter(c.mart, _labels(c)),
    "customer_export": lambda c: C.customer_export(c.mart, _labels(c)),
    "executive_summary": lambda c: C.executive_summary(c.mart, _labels(c)),
    "findings": lambda c: B.findings(c.wh, c.with_fact().mart, _labels(c)),
}.items():
    register(_name)(_fn)


# ------------------------------------------------------------ segmentation
from ..operators import mart as M  # noqa: E402
from ..operators import segmentation as S  # noqa: E402


def _z(c):
    return S.standardize(S.features(c.mart))


def _xy(c):
    """Deterministic 2-D coordinates for the label-fed centroid check: z(cltv), z(aov)."""
    return _z(c).select("customer_sk", F.col("z_cltv").alias("pc1"), F.col("z_aov").alias("pc2"))


for _name, _fn in {
    "features": lambda c: S.features(c.mart),
    "standardize": _z,
    "pca_2d": lambda c: c.segmentation[1].select("customer_sk", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2")),
    "pca_variance": lambda c: c.segmentation[2].withColumn("explained_variance", F.round("explained_variance", 6)),
    "kmeans": lambda c: S.kmeans(c.segmentation[1]),
    "cluster_labels": lambda c: c.segmentation[0],
    "silhouette_sweep": lambda c: S.silhouette_sweep(c.segmentation[1]),
    "assign_clusters": lambda c: M.assign_clusters(c.mart, c.segmentation[0]),
    "cluster_distribution": lambda c: S.cluster_distribution(c.mart, _labels(c)),
    "cluster_profile": lambda c: S.cluster_profile(c.mart, _labels(c)),
    "cluster_profile_norm": lambda c: S.cluster_profile_norm(c.mart, _labels(c)),
    "cluster_centroids": lambda c: S.cluster_centroids(_xy(c), _labels(c)),
    "pca_sample": lambda c: S.pca_sample(c.segmentation[1], _labels(c)),
    "cluster_cltv_range": lambda c: S.cluster_cltv_range(c.mart, _labels(c)),
    "segment_behaviour": lambda c: S.segment_behaviour(c.mart, _labels(c)),
}.items():
    register(_name)(_fn)


# ------------------------------------------------------- keys and pipelines
import hashlib  # noqa: E402
import uuid  # noqa: E402

from ..session import scratch_path  # noqa: E402
from . import pipeline as P  # noqa: E402
from .registry import REGISTRY  # noqa: E402


@register("surrogate_keys")
def q_surrogate_keys(c):
    """W09 key map of the keyed dimensions: dense in natural-key order, unknown member = 1."""
    w = c.wh
    parts = [d.select(F.lit(name).alias("dimension"), F.col(f"{name}_nk").cast("long").alias("natural_key"),
                      F.col(f"{name}_sk").cast("long").alias("surrogate_key"))
             for name, d in (("customer", w.dim_customer), ("product", w.dim_product), ("store", w.dim_store))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _run_dir(c, what: str) -> str:
    return scratch_path(c.spark, f"{what}-{hashlib.sha1(c.sf_dir.encode()).hexdigest()[:12]}")


@register("build_warehouse")
def q_build_warehouse(c):
    """W13 end to end (stage, dimensions, facts, checks, mart, clusters), then the
    row count of every written table."""
    res = P.build_warehouse(c.spark, c.sf_dir, _run_dir(c, "warehouse"))
    return P.warehouse_summary(c.spark, res["out_dir"])


# Report sections of the bundle (the export's business and customer sections).
BUNDLE_SECTIONS = (
    # The first reads the fact and the mart and keeps the fact for both.
    "global_kpis", "month_comparison", "trailing_12_months", "top_products_latest_month", "peak_month",
    "monthly_evolution", "top_products", "sales_by_store", "seasonality", "return_kpis",
    "returns_monthly", "returns_by_reason", "returns_by_product", "product_margin_rank",
    "product_return_rate", "product_seasonality", "brands", "brand_returns", "categories",
    "category_by_year", "profit_monthly", "profit_by_category", "profit_yearly", "store_kpis",
    "store_monthly", "store_top_products", "year_over_year", "annual_growth", "best_worst_months",
    "product_growth", "product_detail", "brand_detail", "category_by_brand",
    "cltv_kpis", "cltv_top_share", "cltv_log_histogram", "cltv_by_tenure", "orders_band", "pareto_curve",
    "pareto_80", "rfm_matrix", "cohorts", "health_light", "pca_variance")
# Sections over the segments, with the mart's own labels (K-Means, beyond SQL).
SEGMENT_SECTIONS = {
    "findings": lambda c: B.findings(c.wh, c.mart, c.segmentation[0]),
    "top_customers": lambda c: C.top_customers(c.mart, c.segmentation[0]),
    "customer_export": lambda c: C.customer_export(c.mart, c.segmentation[0]),
    "cltv_scatter": lambda c: C.cltv_scatter(c.mart, c.segmentation[0]),
    "cluster_scatter": lambda c: S.pca_sample(c.segmentation[1], c.segmentation[0]),
    "cluster_distribution": lambda c: S.cluster_distribution(c.mart, c.segmentation[0]),
    "cluster_profile": lambda c: S.cluster_profile(c.mart, c.segmentation[0]),
    "cluster_profile_norm": lambda c: S.cluster_profile_norm(c.mart, c.segmentation[0]),
}


def bundle_sections() -> dict:
    from ..functions.output import finalize
    fns = {**{k: REGISTRY[k] for k in BUNDLE_SECTIONS}, **SEGMENT_SECTIONS}
    return {k: (lambda fn: lambda ctx: finalize(fn(ctx)))(fn) for k, fn in fns.items()}


@register("report_bundle")
def q_report_bundle(c):
    """Every section written as JSON; the values of the sections without segments, added up from the output."""
    out = P.report_bundle(c, f"{_run_dir(c, 'report-bundle')}/{uuid.uuid4().hex}", bundle_sections())
    return P.bundle_values(out.where(F.col("section").isin(list(BUNDLE_SECTIONS))))
