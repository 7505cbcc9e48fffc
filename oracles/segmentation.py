"""Oracles for segmentation (S) fed with the deterministic tercile labels.

K-Means, the silhouette sweep and the hash samples have no SQL form; they are
checked by properties in tests/ (rows-only in the driver check).
"""

from __future__ import annotations

from .base import rdiv, with_ctes
from .customers import LABELS
from .queries import ORACLES

D = lambda x: f"CAST({x} AS DOUBLE)"
FEATS = ["cltv", "net_revenue", "aov", "monthly_frequency", "recency_days", "return_rate", "tenure_days"]
PROF = FEATS + ["num_orders", "margin_pct"]
MEAN = lambda c: f"CAST(SUM({c}) AS DOUBLE) / CAST(COUNT({c}) AS DOUBLE)"

FE = "fe AS (SELECT customer_sk, " + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in FEATS) + \
     " FROM customer_360 WHERE cltv IS NOT NULL)"
ST = "st AS (SELECT " + ", ".join(
    f"AVG(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS d_{c}" for c in FEATS) + " FROM fe)"
ZT = "zt AS (SELECT fe.customer_sk, " + ", ".join(
    f"CASE WHEN d_{c} > 0 THEN (CAST(fe.{c} AS DOUBLE) - m_{c}) / d_{c} ELSE 0.0 END AS z_{c}" for c in FEATS) + " FROM fe, st)"
# Principal axes of the 7 x 7 correlation matrix by power iteration; the second after taking the first out of the matrix.
_N = len(FEATS)


def _axis(name: str, matrix: str) -> str:
    """The axis after 400 steps, its largest loading made positive, and its eigenvalue."""
    times = f"list_transform({matrix}.m, lambda r: list_dot_product(r, v))"
    return f"""{name} AS (
  WITH RECURSIVE steps(t, v) AS (
    SELECT 0, {[1.0 - k / 10 for k in range(_N)]}::DOUBLE[]
    UNION ALL
    SELECT t + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
    FROM (SELECT t, {times} AS w FROM steps, {matrix} WHERE t < 400)),
  done AS (SELECT v, list_dot_product(v, {times}) AS l, list_transform(v, lambda y: abs(y)) AS sizes FROM steps, {matrix} WHERE t = 400)
  SELECT list_transform(v, lambda x: x * sign(v[list_position(sizes, list_max(sizes))])) AS v, l FROM done)"""


PCA = f"""corr_matrix AS (SELECT [{", ".join("[" + ", ".join(
    f"COALESCE(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 0)" for b in FEATS) + "]" for a in FEATS)}] AS m FROM fe),
{_axis("axis1", "corr_matrix")},
rest_matrix AS (SELECT list_transform(range(1, {_N + 1}), lambda i: list_transform(range(1, {_N + 1}), lambda j: m[i][j] - l * v[i] * v[j])) AS m
                FROM corr_matrix, axis1),
{_axis("axis2", "rest_matrix")}"""


def oracle(name, body, *extra):
    ORACLES[name] = with_ctes(body, *extra)


oracle("features", "SELECT customer_sk, " + ", ".join(D(c) + f" AS {c}" if c not in ("recency_days", "tenure_days")
                                                        else f"CAST({c} AS BIGINT) AS {c}" for c in FEATS) + " FROM fe", FE)
oracle("standardize", "SELECT * FROM zt", FE, ST, ZT)
_Z = "[" + ", ".join(f"z_{c}" for c in FEATS) + "]"
oracle("pca_2d", f"""
SELECT customer_sk, ROUND(list_dot_product({_Z}, axis1.v), 6) AS pc1, ROUND(list_dot_product({_Z}, axis2.v), 6) AS pc2
FROM zt, axis1, axis2""", FE, ST, ZT, PCA)
oracle("pca_variance", f"""
SELECT 'pc1' AS component, ROUND(l / {_N}, 6) AS explained_variance FROM axis1
UNION ALL SELECT 'pc2', ROUND(l / {_N}, 6) FROM axis2""", FE, PCA)
oracle("cluster_distribution", f"""
SELECT cluster_id, cluster_label, COUNT(*) AS customers,
       {D(rdiv('COUNT(*) * 100', '(SELECT COUNT(*) FROM lm)', 1))} AS pct_customers,
       {D('SUM(cltv)')} AS total_cltv, {D(rdiv('SUM(cltv) * 100', '(SELECT SUM(cltv) FROM lm)', 1))} AS pct_cltv,
       {MEAN('cltv')} AS mean_cltv, {MEAN('aov')} AS mean_aov, {MEAN('return_rate')} AS mean_return_rate
FROM lm GROUP BY cluster_id, cluster_label""", LABELS)
oracle("cluster_profile", "SELECT cluster_label, " + ", ".join(f"{MEAN(c)} AS {c}" for c in PROF)
       + " FROM lm GROUP BY cluster_label", LABELS)
oracle("cluster_profile_norm", "SELECT cluster_label, " + ", ".join(
    f"({c} - MIN({c}) OVER ()) / (MAX({c}) OVER () - MIN({c}) OVER () + 1e-9) AS {c}" for c in FEATS)
    + " FROM (SELECT cluster_label, " + ", ".join(f"{MEAN(c)} AS {c}" for c in FEATS)
    + " FROM lm GROUP BY cluster_label) p", LABELS)
oracle("cluster_centroids", """
SELECT l.cluster_label, AVG(z.z_cltv) AS mean_pc1, AVG(z.z_aov) AS mean_pc2, COUNT(*) AS customers
FROM zt z JOIN labels l ON l.customer_sk = z.customer_sk GROUP BY l.cluster_label""", FE, ST, ZT, LABELS)
oracle("cluster_cltv_range", f"""
SELECT cluster_label, COUNT(*) AS customers, {MEAN('cltv')} AS mean_cltv, {D('MIN(cltv)')} AS min_cltv,
       {D('MAX(cltv)')} AS max_cltv FROM lm GROUP BY cluster_label""", LABELS)
oracle("segment_behaviour", "SELECT cluster_label, COUNT(*) AS customers, " + ", ".join(
    f"{MEAN(c)} AS mean_{c}" for c in ("cltv", "recency_days", "tenure_days", "num_orders", "aov", "return_rate"))
    + ", CAST(COUNT(*) AS DOUBLE) / CAST((SELECT COUNT(*) FROM lm) AS DOUBLE) * 100 AS pct_customers"
    + " FROM lm GROUP BY cluster_label", LABELS)
