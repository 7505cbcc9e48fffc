"""Oracles for customer analytics (C), checks (V) and label-fed segment reports."""

from __future__ import annotations

from .base import STAR, rdiv, with_ctes
from .queries import ORACLES

D = lambda x: f"CAST({x} AS DOUBLE)"

LABELS = """labels AS (
  SELECT customer_sk, CAST(t - 1 AS BIGINT) AS cluster_id,
         CASE t WHEN 1 THEN 'Champions' WHEN 2 THEN 'Base' ELSE 'Churned' END AS cluster_label
  FROM (SELECT customer_sk, CASE WHEN 3 * (r - 1) <= n - 1 THEN 1 WHEN 3 * (r - 1) <= 2 * (n - 1) THEN 2 ELSE 3 END AS t
        FROM (SELECT customer_sk, ROW_NUMBER() OVER (ORDER BY cltv DESC, customer_sk) AS r, COUNT(*) OVER () AS n
              FROM customer_360 WHERE cltv IS NOT NULL) a) b),
lm AS (SELECT m.*, l.cluster_id, l.cluster_label FROM customer_360 m LEFT JOIN labels l ON l.customer_sk = m.customer_sk
       WHERE m.cltv IS NOT NULL)"""
ZONE = """czone AS (
  SELECT customer_sk, zone_sk, district, area_type, orientation, lines FROM (
    SELECT p.*, z.district, z.area_type, z.orientation,
           ROW_NUMBER() OVER (PARTITION BY p.customer_sk ORDER BY p.lines DESC, p.zone_sk) AS rn
    FROM (SELECT customer_sk, zone_sk, COUNT(*) AS lines FROM fact_sales WHERE customer_sk <> 1
          GROUP BY customer_sk, zone_sk) p JOIN dim_zone z ON z.zone_sk = p.zone_sk) t WHERE rn = 1)"""
ASC = """asc_o AS (SELECT customer_sk, cltv, ROW_NUMBER() OVER (ORDER BY cltv, customer_sk) AS pos,
                   SUM(cltv) OVER (ORDER BY cltv, customer_sk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                   COUNT(*) OVER () AS n, SUM(cltv) OVER () AS total FROM customer_360 WHERE cltv IS NOT NULL)"""
DESC = """desc_o AS (SELECT customer_sk, cltv, ROW_NUMBER() OVER (ORDER BY cltv DESC, customer_sk) AS pos,
                   SUM(cltv) OVER (ORDER BY cltv DESC, customer_sk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                   COUNT(*) OVER () AS n, SUM(cltv) OVER () AS total FROM customer_360 WHERE cltv IS NOT NULL)"""


def oracle(name, body, *extra):
    ORACLES[name] = with_ctes(body, *extra)


V = "(SELECT * FROM customer_360 WHERE cltv IS NOT NULL)"

oracle("cltv_kpis", f"""
SELECT {D('SUM(cltv)')} AS total_cltv, CAST(SUM(cltv) AS DOUBLE) / COUNT(cltv) AS mean_cltv,
       quantile_cont(CAST(cltv AS DOUBLE), 0.5) AS median_cltv, {D('MAX(cltv)')} AS max_cltv,
       {D('MIN(cltv) FILTER (WHERE cltv > 0)')} AS min_positive_cltv FROM {V} v""")
oracle("cltv_top_share", f"""
SELECT {D(rdiv('SUM(cltv) FILTER (WHERE pos <= GREATEST(1, n * 10 // 100)) * 100', 'MAX(total)', 1))} AS top10_share_pct,
       {D(rdiv('SUM(cltv) FILTER (WHERE pos <= GREATEST(1, n * 20 // 100)) * 100', 'MAX(total)', 1))} AS top20_share_pct
FROM desc_o""", DESC)
oracle("cltv_log_histogram", """
SELECT g.bin, ROUND(pow(10.0, r.lo + (r.hi - r.lo) * g.bin / 19), 2) AS lower_edge,
       ROUND(pow(10.0, r.lo + (r.hi - r.lo) * (g.bin + 1) / 19), 2) AS upper_edge, COALESCE(c.n, 0) AS customers
FROM r CROSS JOIN (SELECT range AS bin FROM range(0, 19)) g
LEFT JOIN (SELECT CAST(LEAST(GREATEST(CASE WHEN r.hi - r.lo > 0
                   THEN floor((log10(x) - r.lo) / (r.hi - r.lo) * 19) ELSE 0 END, 0), 18) AS BIGINT) AS bin, COUNT(*) AS n
           FROM p CROSS JOIN r GROUP BY 1) c ON c.bin = g.bin""",
       "p AS (SELECT CAST(cltv AS DOUBLE) AS x FROM customer_360 WHERE cltv IS NOT NULL AND cltv > 0)",
       "r AS (SELECT log10(MIN(x)) AS lo, log10(MAX(x)) AS hi FROM p)")

HS = [("cltv", "full", 60), ("cltv", "below_p95", 50), ("aov", "full", 50), ("aov", "below_p95", 50),
      ("return_rate", "full", 40)]


def _hist(metric, scope, bins):
    src = f"SELECT {metric} AS x FROM customer_360 WHERE cltv IS NOT NULL AND {metric} IS NOT NULL"
    if scope == "below_p95":
        src = (f"SELECT x FROM ({src}) s WHERE CAST(x AS DOUBLE) <= "
               f"(SELECT quantile_cont(CAST({metric} AS DOUBLE), 0.95) FROM customer_360 WHERE cltv IS NOT NULL AND {metric} IS NOT NULL)")
    w = "CAST(st.hi - st.lo AS DOUBLE)"
    return f"""
SELECT '{metric}' AS metric, '{scope}' AS scope, g.bin, ROUND(CAST(st.lo AS DOUBLE) + {w} * g.bin / {bins}, 2) AS lower_edge,
       ROUND(CAST(st.lo AS DOUBLE) + {w} * (g.bin + 1) / {bins}, 2) AS upper_edge, COALESCE(c.n, 0) AS customers,
       st.mean, st.median
FROM (SELECT MIN(x) AS lo, MAX(x) AS hi, CAST(SUM(x) AS DOUBLE) / COUNT(x) AS mean,
             quantile_cont(CAST(x AS DOUBLE), 0.5) AS median FROM ({src}) a) st
CROSS JOIN (SELECT range AS bin FROM range(0, {bins})) g
LEFT JOIN (SELECT CAST(LEAST(CASE WHEN {w} > 0 THEN floor(CAST(s.x - st.lo AS DOUBLE) / {w} * {bins}) ELSE 0 END,
                             {bins - 1}) AS BIGINT) AS bin, COUNT(*) AS n
           FROM ({src}) s CROSS JOIN (SELECT MIN(x) AS lo, MAX(x) AS hi FROM ({src}) b) st GROUP BY 1) c ON c.bin = g.bin"""


oracle("metric_histogram", " UNION ALL ".join(_hist(*h) for h in HS))
oracle("cltv_by_tenure", f"""
SELECT band, CAST(SUM(cltv) AS DOUBLE) / COUNT(cltv) AS mean_cltv, quantile_cont(CAST(cltv AS DOUBLE), 0.5) AS median_cltv,
       COUNT(*) AS customers
FROM (SELECT cltv, CASE WHEN tenure_days > 0 AND tenure_days <= 365 THEN '0-1 years'
                        WHEN tenure_days > 365 AND tenure_days <= 730 THEN '1-2 years'
                        WHEN tenure_days > 730 AND tenure_days <= 1095 THEN '2-3 years'
                        WHEN tenure_days > 1095 THEN '3+ years' END AS band FROM {V} v) x
WHERE band IS NOT NULL GROUP BY band""")
oracle("orders_band", f"""
SELECT b.band, b.band_order, COUNT(v.customer_sk) AS customers
FROM (VALUES ('1 order', 1, 0, 1), ('2 orders', 2, 1, 2), ('3-5 orders', 3, 2, 5), ('6-10 orders', 4, 5, 10),
             ('more than 10', 5, 10, NULL)) b(band, band_order, lo, hi)
LEFT JOIN {V} v ON v.num_orders > b.lo AND (b.hi IS NULL OR v.num_orders <= b.hi)
GROUP BY b.band, b.band_order""")
oracle("pareto_curve", """
SELECT pos, CAST(pos AS DOUBLE) / CAST(n AS DOUBLE) * 100 AS customers_pct,
       CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS cltv_cum_pct
FROM desc_o WHERE (pos - 1) % GREATEST(1, n // 100) = 0""", DESC)
oracle("pareto_80", f"""
SELECT MIN(pos) AS customers_needed, {D(rdiv('MIN(pos) * 100', 'MAX(n)', 1))} AS customers_pct
FROM desc_o WHERE cum * 100 >= total * 80 HAVING COUNT(*) > 0""", DESC)
oracle("lorenz_curve", """
SELECT pos, CAST(pos AS DOUBLE) / CAST(n AS DOUBLE) * 100 AS population_pct,
       CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS cltv_pct FROM asc_o""", ASC)
oracle("lorenz_top_80", f"""
SELECT MIN(pos) AS crossing_pos, {D(rdiv('(MAX(n) - MIN(pos)) * 100', 'MAX(n)', 1))} AS top_pct_for_80
FROM asc_o WHERE cum * 100 >= total * 20 HAVING COUNT(*) > 0""", ASC)
oracle("gini", f"""
SELECT {D(rdiv('SUM(pos * cltv) * 2 - (MAX(n) + 1) * MAX(total)', 'MAX(n) * MAX(total)', 3))} AS gini, MAX(n) AS customers
FROM asc_o""", ASC)
oracle("rfm_matrix", f"""
SELECT CASE WHEN recency_days <= q1 THEN 'Recent' WHEN recency_days <= q2 THEN 'Medium' ELSE 'Inactive' END AS recency,
       CASE WHEN 3 * (fr - 1) <= n - 1 THEN 'Low' WHEN 3 * (fr - 1) <= 2 * (n - 1) THEN 'Medium' ELSE 'High' END AS frequency,
       {D(rdiv('SUM(cltv)', 'COUNT(cltv)', 2))} AS mean_cltv, COUNT(*) AS customers
FROM (SELECT v.*, ROW_NUMBER() OVER (ORDER BY monthly_frequency, customer_sk) AS fr, COUNT(*) OVER () AS n,
             (SELECT quantile_cont(CAST(recency_days AS DOUBLE), 1.0 / 3) FROM {V} a) AS q1,
             (SELECT quantile_cont(CAST(recency_days AS DOUBLE), 2.0 / 3) FROM {V} b) AS q2
      FROM {V} v) x GROUP BY 1, 2""")
oracle("cohorts", f"""
SELECT CAST(year(first_purchase) AS BIGINT) AS cohort_year, COUNT(*) AS customers,
       {D(rdiv('SUM(cltv)', 'COUNT(cltv)', 2))} AS mean_cltv, {D('SUM(cltv)')} AS total_cltv,
       CAST(SUM(aov) AS DOUBLE) / COUNT(aov) AS mean_aov,
       CAST(SUM(num_orders) AS DOUBLE) / COUNT(num_orders) AS mean_orders,
       CAST(SUM(tenure_days) AS DOUBLE) / COUNT(tenure_days) AS mean_tenure_days,
       CAST(SUM(return_rate) AS DOUBLE) / COUNT(return_rate) AS mean_return_rate
FROM {V} v WHERE first_purchase IS NOT NULL GROUP BY 1""")
oracle("top_customers", f"""
SELECT ROW_NUMBER() OVER (ORDER BY cltv DESC, customer_sk) AS rank, customer_sk, name, {D('cltv')} AS cltv,
       {D('net_revenue')} AS net_revenue, {D('aov')} AS aov, {D('monthly_frequency')} AS monthly_frequency,
       recency_days, num_orders, cluster_label,
       CAST(cltv AS DOUBLE) / CAST((SELECT SUM(cltv) FROM lm) AS DOUBLE) * 100 AS share_of_total_pct
FROM lm ORDER BY cltv DESC, customer_sk LIMIT 20""", LABELS)
oracle("cltv_by_zone", """
SELECT 'area' AS grouping, area_type, NULL::VARCHAR AS orientation, COUNT(*) AS customers,
       CAST(SUM(cltv) AS DOUBLE) / COUNT(cltv) AS mean_cltv FROM mz GROUP BY area_type
UNION ALL
SELECT 'orientation', NULL, orientation, COUNT(*), CAST(SUM(cltv) AS DOUBLE) / COUNT(cltv) FROM mz GROUP BY orientation
UNION ALL
SELECT 'area_x_orientation', area_type, orientation, COUNT(*), CAST(SUM(cltv) AS DOUBLE) / COUNT(cltv)
FROM mz GROUP BY area_type, orientation""", ZONE,
       "mz AS (SELECT m.cltv, z.area_type, z.orientation FROM customer_360 m LEFT JOIN czone z ON z.customer_sk = m.customer_sk WHERE m.cltv IS NOT NULL)")

CM = ["cltv", "net_revenue", "aov", "num_orders", "monthly_frequency", "tenure_days", "recency_days", "return_rate"]


oracle("metric_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS pearson FROM {V} v"
    for a in CM for b in CM))
oracle("high_return_profile", f"""
SELECT COUNT(*) FILTER (WHERE return_rate > 50) AS customers,
       CAST(COUNT(*) FILTER (WHERE return_rate > 50) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 AS pct_customers,
       CAST(SUM(cltv) FILTER (WHERE return_rate > 50) AS DOUBLE) / NULLIF(CAST(COUNT(*) FILTER (WHERE return_rate > 50) AS DOUBLE), 0) AS mean_cltv,
       CAST(SUM(cltv) FILTER (WHERE NOT return_rate > 50) AS DOUBLE) / NULLIF(CAST(COUNT(*) FILTER (WHERE NOT return_rate > 50) AS DOUBLE), 0) AS mean_cltv_rest,
       CAST(SUM(aov) FILTER (WHERE return_rate > 50) AS DOUBLE) / NULLIF(CAST(COUNT(aov) FILTER (WHERE return_rate > 50) AS DOUBLE), 0) AS mean_aov,
       CAST(SUM(return_rate) FILTER (WHERE return_rate > 50) AS DOUBLE) / NULLIF(CAST(COUNT(*) FILTER (WHERE return_rate > 50) AS DOUBLE), 0) AS mean_return_rate,
       CAST(COALESCE(SUM(units_returned) FILTER (WHERE return_rate > 50), 0) AS BIGINT) AS units_returned,
       {D('COALESCE(SUM(gross_revenue - net_revenue) FILTER (WHERE return_rate > 50), 0)')} AS lost_revenue
FROM {V} v""")
oracle("return_rate_anomalies", f"""
SELECT customer_sk, units_bought, units_returned, {D('return_rate_raw')} AS return_rate_raw, num_orders
FROM customer_360 WHERE return_rate_raw > 100""")
SM = lambda c: f"""
SELECT '{c}' AS metric, CAST(SUM({c}) AS DOUBLE) / COUNT({c}) AS mean, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
       CASE WHEN COUNT({c}) > 1 THEN sqrt(CAST(COUNT({c}) * SUM({c} * {c}) - SUM({c}) * SUM({c}) AS DOUBLE)
            / CAST(COUNT({c}) * (COUNT({c}) - 1) AS DOUBLE)) END AS std,
       {D(f'MIN({c})')} AS min, {D(f'MAX({c})')} AS max FROM {V} v"""  # noqa: E731
oracle("metric_stats", " UNION ALL ".join(SM(c) for c in ("cltv", "aov", "return_rate")))
oracle("customer_percentile", f"""
SELECT customer_sk, {D('cltv')} AS cltv,
       {D(rdiv('(RANK() OVER (ORDER BY cltv) - 1) * 100', 'COUNT(*) OVER ()', 1))} AS pct_below
FROM {V} v""")
LOOKUP_TERM = "00000012"
oracle("customer_lookup", f"""
SELECT customer_sk, customer_nk, name, num_orders, num_lines, first_purchase, last_purchase, tenure_days, recency_days,
       {D('gross_revenue')} AS gross_revenue, {D('net_revenue')} AS net_revenue, {D('total_cost')} AS total_cost,
       {D('gross_margin')} AS gross_margin, {D('margin_pct')} AS margin_pct, {D('aov')} AS aov,
       {D('monthly_frequency')} AS monthly_frequency, units_bought, units_returned, {D('return_rate')} AS return_rate,
       {D('return_rate_raw')} AS return_rate_raw, {D('cltv')} AS cltv
FROM customer_360 WHERE contains(lower(name), '{LOOKUP_TERM}')""")
SEGM = ["cltv", "aov", "num_orders", "tenure_days", "monthly_frequency", "return_rate"]
oracle("customer_vs_segment", " UNION ALL ".join(f"""
SELECT l.customer_sk, l.cluster_label, '{c}' AS metric, CAST(l.{c} AS DOUBLE) AS value, s.m AS segment_mean,
       (CAST(l.{c} AS DOUBLE) - r.lo) / (r.hi - r.lo + 1e-9) AS value_norm, (s.m - r.lo) / (r.hi - r.lo + 1e-9) AS segment_norm
FROM lm l LEFT JOIN (SELECT cluster_label, CAST(SUM({c}) AS DOUBLE) / COUNT({c}) AS m FROM lm GROUP BY cluster_label) s
  ON s.cluster_label IS NOT DISTINCT FROM l.cluster_label
CROSS JOIN (SELECT CAST(MIN({c}) AS DOUBLE) AS lo, CAST(MAX({c}) AS DOUBLE) AS hi FROM lm) r""" for c in SEGM), LABELS)
oracle("health_score", """
SELECT CAST(round_even(LEAST(ch / 15 * 33, 33.0) + GREATEST(0.0, (5.0 - rr) / 5 * 33) + LEAST(pos / 95 * 34, 34.0), 0) AS BIGINT) AS score,
       ch AS champions_pct, rr AS return_rate, pos AS positive_cltv_pct
FROM (SELECT CAST(COUNT(*) FILTER (WHERE cluster_label = 'Champions') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 AS ch,
             CAST(SUM(units_returned) AS DOUBLE) / CAST(SUM(units_bought) AS DOUBLE) * 100 AS rr,
             CAST(COUNT(*) FILTER (WHERE cltv > 0) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 AS pos FROM lm) x""", LABELS)
oracle("health_light", f"""
SELECT *, CASE WHEN points >= 5 THEN 'green' WHEN points >= 3 THEN 'yellow' ELSE 'red' END AS light FROM (
  SELECT f.return_rate, f.avg_margin_pct, c.avg_recency_days,
         (CASE WHEN f.return_rate < 5 THEN 2 WHEN f.return_rate < 15 THEN 1 ELSE 0 END
          + CASE WHEN f.avg_margin_pct > 40 THEN 2 WHEN f.avg_margin_pct > 25 THEN 1 ELSE 0 END
          + CASE WHEN c.avg_recency_days < 90 THEN 2 WHEN c.avg_recency_days < 180 THEN 1 ELSE 0 END) AS points
  FROM (SELECT CAST(SUM(returned_qty) AS DOUBLE) / CAST(SUM(quantity) AS DOUBLE) * 100 AS return_rate,
               CAST(SUM(margin_pct) AS DOUBLE) / CAST(COUNT(margin_pct) AS DOUBLE) AS avg_margin_pct FROM fact_sales) f,
       (SELECT CAST(SUM(recency_days) AS DOUBLE) / CAST(COUNT(recency_days) AS DOUBLE) AS avg_recency_days FROM {V} v) c) x""")
oracle("customer_export", """
SELECT customer_sk, name, num_orders, cluster_label, """ + ", ".join(
    f"CAST(ROUND(COALESCE(CAST({c} AS DECIMAL(18,4)), 0), 2) AS DOUBLE) AS {c}"
    for c in ("cltv", "net_revenue", "aov", "monthly_frequency", "recency_days", "tenure_days", "return_rate",
              "margin_pct")) + " FROM lm", LABELS)
oracle("executive_summary", f"""
SELECT x.*, g.gini, t.top_pct_for_80 FROM (
  SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE cluster_label = 'Champions') AS champions,
         COUNT(*) FILTER (WHERE cluster_label = 'Base') AS base, COUNT(*) FILTER (WHERE cluster_label = 'Churned') AS churned,
         {D('SUM(cltv)')} AS total_cltv, CAST(SUM(cltv) AS DOUBLE) / COUNT(cltv) AS mean_cltv,
         quantile_cont(CAST(cltv AS DOUBLE), 0.5) AS median_cltv, CAST(SUM(aov) AS DOUBLE) / COUNT(aov) AS mean_aov,
         CAST(SUM(units_returned) AS DOUBLE) / CAST(SUM(units_bought) AS DOUBLE) * 100 AS return_rate,
         COUNT(*) FILTER (WHERE return_rate > 50) AS high_return_customers,
         {D('SUM(gross_revenue - net_revenue)')} AS lost_revenue,
         {D(rdiv("COALESCE(SUM(cltv) FILTER (WHERE cluster_label = 'Champions'), 0) * 100", 'SUM(cltv)', 1))} AS champions_cltv_share_pct
  FROM lm) x,
  (SELECT {D(rdiv('SUM(pos * cltv) * 2 - (MAX(n) + 1) * MAX(total)', 'MAX(n) * MAX(total)', 3))} AS gini FROM asc_o) g,
  (SELECT {D(rdiv('(MAX(n) - MIN(pos)) * 100', 'MAX(n)', 1))} AS top_pct_for_80 FROM asc_o WHERE cum * 100 >= total * 20) t""",
       LABELS, ASC)

# ------------------------------------------------------------------ findings
oracle("findings", f"""
SELECT p.customers_pct AS pct_customers_for_80_cltv, pk.month_name AS peak_month, tp.product AS top_product_latest_month,
       rr.reason AS top_return_reason, ch.champions_customer_pct, ch.champions_cltv_pct
FROM (SELECT {D(rdiv('MIN(pos) * 100', 'MAX(n)', 1))} AS customers_pct FROM desc_o WHERE cum * 100 >= total * 80) p,
     (SELECT monthname(make_date(2000, month, 1)) AS month_name FROM
        (SELECT month, SUM(net_amount) AS net FROM star GROUP BY month ORDER BY net DESC, month LIMIT 1) a) pk,
     (SELECT product FROM (SELECT product, SUM(net_amount) AS net FROM star, latest
        WHERE star.year * 100 + star.month = latest.ym GROUP BY product ORDER BY net DESC, product LIMIT 1) b) tp,
     (SELECT reason FROM (SELECT m.reason, COUNT(*) AS n FROM fact_returns r JOIN dim_return_reason m ON m.reason_sk = r.reason_sk
        WHERE NOT m.is_unknown GROUP BY m.reason ORDER BY n DESC, m.reason LIMIT 1) c) rr,
     (SELECT {D(rdiv("COUNT(*) FILTER (WHERE cluster_label = 'Champions') * 100", 'COUNT(*)', 1))} AS champions_customer_pct,
             {D(rdiv("COALESCE(SUM(cltv) FILTER (WHERE cluster_label = 'Champions'), 0) * 100", 'SUM(cltv)', 1))} AS champions_cltv_pct
      FROM lm) ch""", STAR, DESC, LABELS)

# ------------------------------------------------------------------ checks (V)
CHECKS = [
    ("V01", "staged sale rows equal the expected count", "(SELECT COUNT(*) FROM sale)", "(SELECT COUNT(*) FROM sale)", "eq"),
    ("V02", "staged sale_item rows equal the expected count", "(SELECT COUNT(*) FROM sale_item)", "(SELECT COUNT(*) FROM sale_item)", "eq"),
    ("V03", "staged customer rows equal the expected count", "(SELECT COUNT(*) FROM customer_src)", "(SELECT COUNT(*) FROM customer_src)", "eq"),
    ("V04", "staged product rows equal the expected count", "(SELECT COUNT(*) FROM product)", "(SELECT COUNT(*) FROM product)", "eq"),
    ("V05", "dim_customer = customers + 1 unknown", "(SELECT COUNT(*) FROM dim_customer)", "(SELECT COUNT(*) + 1 FROM customer_src)", "eq"),
    ("V06", "dim_product = products + 1 unknown", "(SELECT COUNT(*) FROM dim_product)", "(SELECT COUNT(*) + 1 FROM product)", "eq"),
    ("V07", "dim_store = stores + 1 unknown", "(SELECT COUNT(*) FROM dim_store)", "(SELECT COUNT(*) + 1 FROM store)", "eq"),
    ("V08", "every sale date is in dim_date",
     "(SELECT COUNT(*) FROM (SELECT DISTINCT sale_date FROM sale) s WHERE sale_date NOT IN (SELECT date FROM dim_date))", "0", "zero"),
    ("V09", "exactly one no-offer member", "(SELECT COUNT(*) FROM dim_offer WHERE is_no_offer)", "1", "eq"),
    ("V10", "exactly one unknown return reason", "(SELECT COUNT(*) FROM dim_return_reason WHERE is_unknown)", "1", "eq"),
    ("V11", "fact_sales rows = sale lines", "(SELECT COUNT(*) FROM fact_sales)", "(SELECT COUNT(*) FROM sale_item)", "eq"),
    ("V12", "fact_returns has rows", "(SELECT COUNT(*) FROM fact_returns)", "0", "gt"),
    ("V13", "no orphan customer_sk in fact_sales",
     "(SELECT COUNT(*) FROM fact_sales f WHERE f.customer_sk NOT IN (SELECT customer_sk FROM dim_customer))", "0", "zero"),
    ("V14", "no orphan product_sk in fact_sales",
     "(SELECT COUNT(*) FROM fact_sales f WHERE f.product_sk NOT IN (SELECT product_sk FROM dim_product))", "0", "zero"),
    ("V15", "no orphan store_sk in fact_sales",
     "(SELECT COUNT(*) FROM fact_sales f WHERE f.store_sk NOT IN (SELECT store_sk FROM dim_store))", "0", "zero"),
    ("V16", "no orphan date_sk in fact_sales",
     "(SELECT COUNT(*) FROM fact_sales f WHERE f.date_sk NOT IN (SELECT date_sk FROM dim_date))", "0", "zero"),
    ("V17", "no quantity <= 0", "(SELECT COUNT(*) FROM fact_sales WHERE quantity <= 0)", "0", "zero"),
    ("V18", "no negative gross amount", "(SELECT COUNT(*) FROM fact_sales WHERE gross_amount < 0)", "0", "zero"),
    ("V19", "net never above gross + 0.01", "(SELECT COUNT(*) FROM fact_sales WHERE net_amount > gross_amount + 0.01)", "0", "zero"),
    ("V20", "no negative product margin (known products)",
     "(SELECT COUNT(*) FROM dim_product WHERE margin_pct < 0 AND NOT is_unknown)", "0", "zero"),
    ("V21", "fact gross total reconciles with staged subtotals (abs diff < 1)",
     "(SELECT ABS((SELECT SUM(gross_amount) FROM fact_sales) - (SELECT SUM(subtotal) FROM sale_item)))", "1", "lt"),
]
GROUPS = {
    "check_staging_counts": ("V01", "V02", "V03", "V04"), "check_dim_counts": ("V05", "V06", "V07"),
    "check_date_coverage": ("V08",), "check_special_members": ("V09", "V10"), "check_fact_counts": ("V11", "V12"),
    "check_fact_orphans": ("V13", "V14", "V15", "V16"), "check_positive_qty": ("V17",), "check_gross_nonneg": ("V18",),
    "check_net_le_gross": ("V19",), "check_product_margin": ("V20",), "check_total_reconciles": ("V21",),
}
OPS = {"eq": "value = expected", "zero": "value = 0", "gt": "value > expected", "lt": "value < expected"}


def _check_rows(ids):
    return " UNION ALL ".join(
        f"SELECT '{i}' AS check_id, '{d}' AS description, CAST({v} AS DOUBLE) AS value, CAST({e} AS DOUBLE) AS expected, "
        f"'{k}' AS kind" for i, d, v, e, k in CHECKS if i in ids)


def _check_sql(ids, report=False):
    sel = ("SELECT check_id, description, value, expected, kind, COALESCE(CASE kind "
           + " ".join(f"WHEN '{k}' THEN {c}" for k, c in OPS.items()) + " END, FALSE) AS ok FROM ("
           + _check_rows(ids) + ") c")
    if not report:
        return sel
    return (f"SELECT r.*, t.total, t.passed, t.failed FROM ({sel}) r, "
            f"(SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE ok) AS passed, COUNT(*) FILTER (WHERE NOT ok) AS failed "
            f"FROM ({sel}) z) t")


for _k, _ids in GROUPS.items():
    oracle(_k, _check_sql(_ids))
oracle("check_report", _check_sql([c[0] for c in CHECKS], report=True))
