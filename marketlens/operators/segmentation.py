"""Customer segmentation (S): standardise, PCA, K-Means, labels and segment profiles.

* S02 and C16 share one aggregate of exact decimal sums and products (``functions.moments``); S02 uses the population
  standard deviation (Spark ML's scaler uses the sample one, F17); a constant feature standardises to 0.
* S03 takes the principal axes from the same sums: the correlation matrix of the features, 7 x 7, is decomposed on the
  driver; rows are projected by an expression.
* S04 starts from Spark ML's k-means|| once per seed and keeps the lowest inertia (F19). Lloyd's iterations of all fits read
  the points in common passes: Spark ML's own take a job an iteration and fit, each turning every row into objects.
* S06 measures Spark ML's silhouette, which needs per-cluster sums only: its distance is the squared Euclidean one. This is
  a deviation from the plain Euclidean silhouette (F18), whose work grows with the square of the customers.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import MONEY, ratio, round_div
from ..functions.moments import correlations, moments
from ..functions.output import attach
from .customers import LABELS, valid

# The seven clustering features.
FEATURES = ("cltv", "net_revenue", "aov", "monthly_frequency", "recency_days", "return_rate", "tenure_days")
PROFILE_FEATURES = FEATURES + ("num_orders", "margin_pct")

FITS_AT_ONCE = 8     # concurrent K-Means starts (Spark jobs of small aggregates)
POINTS_AT_ONCE = 8_000_000  # points that concurrent starts keep in memory together; two starts run beside each other at any size
ROWS_PER_TASK = 100_000
ROWS_PER_PASS_TASK = 1_000_000


# -- S01 / S02 --------------------------------------------------------------------
def features(mart: DataFrame, cols=FEATURES) -> DataFrame:
    """Customers with a CLTV; null features become 0."""
    return valid(mart).select("customer_sk", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])


def standardize(feats: DataFrame, cols=FEATURES) -> DataFrame:
    """z = (x - mean) / population std; a constant column gives 0."""
    m = moments(feats, cols)
    out = []
    for i, c in enumerate(cols):
        std = m.std(i)
        z = (F.col(c).cast("double") - F.lit(m.mean(i))) / F.lit(std) if std else F.lit(0.0)
        out.append(z.alias(f"z_{c}"))
    return feats.select("customer_sk", *out)


# -- S03 ---------------------------------------------------------------------------
def pca_2d(feats: DataFrame, cols=FEATURES, k: int = 2):
    """Project the standardised features on their k principal components.

    Returns (points: customer_sk, pc1..pck; variance: component, explained_variance).
    Component signs are fixed so the largest absolute loading is positive (K20).
    """
    m = moments(feats, cols)
    # The covariance of standardised columns is their correlation; a constant column has no share.
    c = np.nan_to_num(np.array(correlations(m), float))
    values, axes = np.linalg.eigh(c)
    order = np.argsort(-values)[:k]
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(k)] >= 0, 1.0, -1.0)
    z = standardize(feats, cols)
    pts = z.select("customer_sk", *[sum(F.col(f"z_{col}") * F.lit(float(axes[i, j])) for i, col in enumerate(cols)).alias(f"pc{j + 1}")
                                    for j in range(k)])
    total = values.sum()
    var = z.sparkSession.createDataFrame([(f"pc{j + 1}", float(values[order[j]] / total) if total else 0.0) for j in range(k)],
                                         "component string, explained_variance double")
    return pts, var


# -- S04 / S05 ---------------------------------------------------------------------
def _vectors(points: DataFrame, cols) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="_features").transform(points)


def _kept_vectors(points: DataFrame, cols) -> DataFrame:
    """The vectors of the points, persisted for the fits, in partitions of about ROWS_PER_TASK rows."""
    tasks = math.ceil(points.count() / ROWS_PER_TASK)
    return _vectors(points, cols).coalesce(max(1, tasks)).persist(StorageLevel.MEMORY_AND_DISK)


@dataclass(frozen=True)
class Model:
    """The centers of a K-Means fit, a row each."""

    centers: np.ndarray

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)

    def nearest(self, cols) -> Column:
        """Number of the nearest center; the first of equally near ones."""
        far = F.array(*[sum((d * d for d in (F.col(c).cast("double") - F.lit(float(x)) for c, x in zip(cols, center, strict=True))), F.lit(0.0))
                        for center in self.centers])
        return F.array_position(far, F.array_min(far)) - 1


def _blocks(vectors: DataFrame) -> DataFrame:
    """The vectors in blocks of one Arrow batch: their number, and their coordinates, dimension by dimension, in one cell."""
    def pack(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([x.T.tobytes()], pa.binary())], ["n", "x"])
    return vectors.select(vector_to_array("_features").alias("x")).mapInArrow(pack, "n long, x binary")


def _sums(blocks: RDD, models: list[np.ndarray]) -> list[np.ndarray]:
    """One pass for all models. Per model a row a center: number, cost and coordinate sums of the points nearest to it."""
    def partial(rows):
        total = [np.zeros((len(c), c.shape[1] + 2)) for c in models]
        for n, cell in rows:
            x = np.frombuffer(cell).reshape(-1, n)
            for c, t in zip(models, total, strict=True):
                near, least = np.zeros(n, np.intp), None
                for j, center in enumerate(c):
                    far = np.zeros(n)
                    for xi, ci in zip(x, center, strict=True):
                        d = xi - ci
                        d *= d
                        far += d
                    if least is None:
                        least = far
                    else:
                        np.copyto(near, j, where=far < least)
                        np.minimum(least, far, out=least)
                for i, w in enumerate([None, least, *x]):
                    t[:, i] += np.bincount(near, w, minlength=len(c))
        yield total

    out = [np.zeros((len(c), c.shape[1] + 2)) for c in models]
    for total in blocks.mapPartitions(partial).collect():
        for o, t in zip(out, total, strict=True):
            o += t
    return out


def _improved(blocks: DataFrame, starts: list[np.ndarray], max_iter: int, tol: float) -> list[tuple[np.ndarray, float]]:
    """Lloyd's iterations from each start, all in common passes, by Spark ML's rules: a center without points stays, a fit ends
    when no center moves further than ``tol``, and its cost is that of the last pass."""
    fits: list[tuple[np.ndarray, float]] = [(c, math.nan) for c in starts]
    cells = blocks.rdd  # planned once: a pass over a frame would plan, and describe, all that it comes from again
    moving = list(range(len(fits)))
    for _ in range(max_iter):
        if not moving:
            break
        sums = _sums(cells, [fits[i][0] for i in moving])
        still = []
        for i, t in zip(moving, sums, strict=True):
            old, n = fits[i][0], t[:, :1]
            new = np.where(n > 0, t[:, 2:] / np.maximum(n, 1), old)
            fits[i] = new, float(t[:, 1].sum())
            if (((new - old) ** 2).sum(1) > tol * tol).any():
                still.append(i)
        moving = still
    return fits


def best_fits(vectors: DataFrame, ks, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4,
              seed0: int = 42) -> dict[int, tuple[Model, float]]:
    """Per K the K-Means model of lowest inertia over ``n_init`` seeds, and that inertia.

    Spark ML's k-means|| gives the starts (fits of no iteration); the iterations of all fits read the points in common passes.
    """
    jobs = [(k, seed0 + i) for k in ks for i in range(n_init)]
    points = vectors.count()
    # Each pass starts its tasks anew: not many more than run at once, as long as they stay small.
    tasks = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(points / ROWS_PER_PASS_TASK))
    blocks = _blocks(vectors).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Of a frame that is not persisted itself Spark ML keeps the points as objects, read many times faster than rows.
        bare = vectors.select("_features")

        def start(job: tuple[int, int]) -> np.ndarray:
            k, seed = job
            return np.array(KMeans(k=k, seed=seed, maxIter=0, featuresCol="_features", predictionCol="_cluster").fit(bare).clusterCenters())

        with ThreadPoolExecutor(max_workers=max(2, min(FITS_AT_ONCE, POINTS_AT_ONCE // max(1, points)))) as pool:
            starts = list(pool.map(start, jobs))
        fits = _improved(blocks, starts, max_iter, tol)
    finally:
        blocks.unpersist()
    best: dict[int, tuple[float, int, np.ndarray]] = {}
    for (k, seed), (centers, cost) in zip(jobs, fits, strict=True):
        if k not in best or (cost, seed) < best[k][:2]:
            best[k] = (cost, seed, centers)
    return {k: (Model(centers), cost) for k, (cost, _, centers) in best.items()}


def kmeans(points: DataFrame, k: int = 3, n_init: int = 10, cols=("pc1", "pc2"), max_iter: int = 300,
           tol: float = 1e-4, seed0: int = 42) -> DataFrame:
    """K-Means with ``n_init`` seeds; lowest inertia wins."""
    vectors = _kept_vectors(points, cols)
    try:
        model, _ = best_fits(vectors, [k], n_init, max_iter, tol, seed0)[k]
    finally:
        vectors.unpersist()
    return points.select("*", model.nearest(cols).alias("cluster_raw"))


def cluster_labels(assigned: DataFrame, mart: DataFrame, names=LABELS) -> DataFrame:
    """Rank raw clusters by mean CLTV (descending): 0 = Champions, 1 = Base, 2 = Churned."""
    m = assigned.select("customer_sk", "cluster_raw").join(valid(mart).select("customer_sk", "cltv"), "customer_sk")
    means = m.groupBy("cluster_raw").agg(ratio(F.sum("cltv"), F.count("cltv")).alias("_mean"))
    # k rows: a single-task window over the cluster list is bounded by k.
    ranked = means.withColumn("cluster_id", (F.row_number().over(
        Window.orderBy(F.col("_mean").desc(), F.col("cluster_raw"))) - 1).cast("long"))
    lab = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("cluster_id") + 1).cast("int"))
    ranked = ranked.select("cluster_raw", "cluster_id", F.coalesce(lab, F.concat(
        F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("cluster_label"))
    return assigned.join(F.broadcast(ranked), "cluster_raw").select("customer_sk", "cluster_id", "cluster_label")


def segment(mart: DataFrame, k: int = 3, n_init: int = 10):
    """S01-S05 end to end: returns (labels, pca points, explained variance)."""
    pts, var = pca_2d(features(mart))
    pts = pts.persist(StorageLevel.MEMORY_AND_DISK)
    assigned = kmeans(pts, k=k, n_init=n_init)
    return cluster_labels(assigned, mart), pts, var


# -- S06 ----------------------------------------------------------------------------
def silhouette(points: DataFrame, cluster: str = "cluster_raw", cols=("pc1", "pc2")) -> float:
    """Mean silhouette over all points, by squared Euclidean distance; a single cluster or no point gives 0."""
    if points.select(cluster).distinct().limit(2).count() < 2:
        return 0.0
    return ClusteringEvaluator(predictionCol=cluster, featuresCol="_features").evaluate(_vectors(points, cols))


def silhouette_sweep(points: DataFrame, ks=range(2, 9), n_init: int = 4, cols=("pc1", "pc2")) -> DataFrame:
    """Mean silhouette of K-Means for each K; flags the best K."""
    vectors = _kept_vectors(points, cols)
    try:
        best = best_fits(vectors, list(ks), n_init)

        def measure(k: int) -> tuple[int, float, float]:
            model, cost = best[k]
            return int(k), silhouette(vectors.select(*cols, model.nearest(cols).alias("cluster_raw")), cols=cols), float(cost)

        with ThreadPoolExecutor(max_workers=FITS_AT_ONCE) as pool:
            rows = list(pool.map(measure, ks))
    finally:
        vectors.unpersist()
    top = max(rows, key=lambda r: r[1])[0]
    return points.sparkSession.createDataFrame(
        [(k, v, "squared-euclidean", e, k == top) for k, v, e in rows],
        "k long, silhouette double, method string, inertia double, is_best boolean")


# -- S07 .. S13 -----------------------------------------------------------------------
def _lab(mart: DataFrame, labels: DataFrame) -> DataFrame:
    return valid(mart).join(labels.select("customer_sk", "cluster_id", "cluster_label"), "customer_sk", "inner")


def cluster_distribution(mart: DataFrame, labels: DataFrame) -> DataFrame:
    m = _lab(mart, labels)
    tot = m.agg(F.count(F.lit(1)).alias("_n"), F.sum("cltv").alias("_t"))
    per = m.groupBy("cluster_id", "cluster_label").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("cltv").cast(MONEY).alias("total_cltv"),
        ratio(F.sum("cltv"), F.count("cltv")).alias("mean_cltv"),
        ratio(F.sum("aov"), F.count("aov")).alias("mean_aov"),
        ratio(F.sum("return_rate"), F.count("return_rate")).alias("mean_return_rate"))
    return per.transform(attach, tot).select(
        "cluster_id", "cluster_label", "customers",
        round_div(F.col("customers") * 100, F.col("_n"), 1).alias("pct_customers"),
        "total_cltv", round_div(F.col("total_cltv") * 100, F.col("_t"), 1).alias("pct_cltv"),
        "mean_cltv", "mean_aov", "mean_return_rate")


def cluster_profile(mart: DataFrame, labels: DataFrame, cols=PROFILE_FEATURES) -> DataFrame:
    m = _lab(mart, labels)
    return m.groupBy("cluster_label").agg(*[ratio(F.sum(c), F.count(c)).alias(c) for c in cols])


def cluster_profile_norm(mart: DataFrame, labels: DataFrame, cols=FEATURES) -> DataFrame:
    """Per feature, cluster means min-max scaled across clusters (+1e-9 in the denominator)."""
    prof = cluster_profile(mart, labels, cols)
    # One row per cluster (k rows): a window over the whole profile is bounded by k.
    w = Window.partitionBy()
    return prof.select("cluster_label", *[
        ((F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + F.lit(1e-9))).alias(c)
        for c in cols])


def cluster_centroids(points: DataFrame, labels: DataFrame, cols=("pc1", "pc2")) -> DataFrame:
    j = points.join(labels.select("customer_sk", "cluster_label"), "customer_sk")
    return j.groupBy("cluster_label").agg(*[F.avg(c).alias(f"mean_{c}") for c in cols],
                                          F.count(F.lit(1)).alias("customers"))


def pca_sample(points: DataFrame, labels: DataFrame, per_cluster: int = 800, seed: int = 42) -> DataFrame:
    """Up to ``per_cluster`` points per cluster, smallest key hash first (F23). The
    row_number <= k filter becomes a per-task group limit before the shuffle, so a
    large cluster never lands whole in one task."""
    j = points.join(labels.select("customer_sk", "cluster_label"), "customer_sk") \
        .withColumn("_h", F.xxhash64(F.col("customer_sk"), F.lit(seed)))
    w = Window.partitionBy("cluster_label").orderBy("_h", "customer_sk")
    return j.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_cluster).drop("_rn", "_h")


def cluster_cltv_range(mart: DataFrame, labels: DataFrame) -> DataFrame:
    m = _lab(mart, labels)
    return m.groupBy("cluster_label").agg(
        F.count(F.lit(1)).alias("customers"), ratio(F.sum("cltv"), F.count("cltv")).alias("mean_cltv"),
        F.min("cltv").alias("min_cltv"), F.max("cltv").alias("max_cltv"))


def segment_behaviour(mart: DataFrame, labels: DataFrame) -> DataFrame:
    m = _lab(mart, labels)
    tot = m.agg(F.count(F.lit(1)).alias("_n"))
    per = m.groupBy("cluster_label").agg(
        F.count(F.lit(1)).alias("customers"),
        *[ratio(F.sum(c), F.count(c)).alias(f"mean_{c}") for c in
          ("cltv", "recency_days", "tenure_days", "num_orders", "aov", "return_rate")])
    return per.transform(attach, tot).withColumn(
        "pct_customers", ratio(F.col("customers"), F.col("_n")) * 100).drop("_n")
