"""Segmentation: standardisation, silhouette against brute force, K-Means properties."""

from decimal import Decimal as D

import numpy as np

from marketlens.operators import segmentation as S


def _brute_silhouette(x, lab):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in np.unique(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def _points(spark, x, lab):
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, lab))],
                                 "customer_sk long, pc1 double, pc2 double, cluster_raw long")


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(5, 1, (50, 2)), rng.normal((0, 6), 1, (40, 2)), [[9.0, 9.0]]])
    lab = np.repeat([0, 1, 2, 7], [60, 50, 40, 1])                # the last: a cluster of one
    assert abs(S.silhouette(_points(spark, x, lab)) - _brute_silhouette(x, lab)) < 1e-9
    assert S.silhouette(_points(spark, x, np.zeros(len(x)))) == 0.0


def test_pca_axes_match_numpy(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(0, 1, (200, 3))
    x = np.round(np.c_[base, base[:, 0] * 2 + rng.normal(0, 0.2, 200), np.full(200, 5.0)], 2)
    cols = ("a", "b", "c", "d", "e")
    df = spark.createDataFrame([(i, *[D(str(v)) for v in r]) for i, r in enumerate(x)],
                               "customer_sk long, " + ", ".join(f"{c} decimal(18,2)" for c in cols))
    pts, var = S.pca_2d(df, cols)
    got = pts.toPandas().sort_values("customer_sk")[["pc1", "pc2"]].to_numpy()
    sd = x.std(0)
    z = np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    v = vt[:2].T * np.where(vt[:2].T[np.abs(vt[:2].T).argmax(0), [0, 1]] > 0, 1, -1)
    assert np.allclose(got, z @ v, atol=1e-8)
    assert np.allclose([r.explained_variance for r in var.orderBy("component").collect()], (s ** 2 / (s ** 2).sum())[:2])


def test_moments_of_constant_and_close_values_do_not_cancel(spark):
    from marketlens.functions.moments import correlations, moments
    constants = ["0.1", "0.01", "0.07", "123456.78", "99999999.99", "3.33", "-7.77", "1e6", "0.3", "33.33", "66.67", "0.02", "1.1", "2.2", "-0.1"]
    for v in constants:
        df = spark.createDataFrame([(D(v), D(str(i))) for i in range(11)], "a decimal(18,2), b decimal(18,2)")
        m = moments(df, ("a", "b"))
        assert m.std(0) == 0.0 and correlations(m)[0][1] is None and m.correlation(1, 1) == 1.0
    close = [D("90000000.00") + D(i) / 100 for i in range(10)]
    df = spark.createDataFrame([(v, None if i == 3 else i) for i, v in enumerate(close)], "a decimal(18,2), b long")
    m = moments(df, ("a", "b"))
    assert abs(m.std(0) - np.std(np.arange(10) / 100)) < 1e-12 and abs(m.correlation(0, 1) - 1.0) < 1e-12
    assert moments(df.limit(0), ("a", "b")).std(0) == 0.0


def test_standardize_population_std(spark):
    rows = [(i, D(str(v)), D("1.00")) for i, v in enumerate([1, 2, 3, 4, 10])]
    df = spark.createDataFrame(rows, "customer_sk long, a decimal(18,2), b decimal(18,2)")
    z = S.standardize(df, ("a", "b")).toPandas().sort_values("customer_sk")
    v = np.array([1, 2, 3, 4, 10.0])
    assert np.allclose(z.z_a.to_numpy(), (v - v.mean()) / v.std())
    assert (z.z_b == 0).all()                                     # constant column -> 0


def test_kmeans_and_labels_properties(spark):
    rng = np.random.default_rng(7)
    pts = np.vstack([rng.normal(0, 0.3, (40, 2)), rng.normal(4, 0.3, (40, 2)), rng.normal(-4, 0.3, (40, 2))])
    df = spark.createDataFrame([(i + 2, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "customer_sk long, pc1 double, pc2 double")
    assigned = S.kmeans(df, k=3, n_init=3)
    sizes = sorted(r["count"] for r in assigned.groupBy("cluster_raw").count().collect())
    assert sizes == [40, 40, 40]
    mart = spark.createDataFrame([(i + 2, D(str(round(float(a) * 100, 2)))) for i, (a, _) in enumerate(pts)],
                                 "customer_sk long, cltv decimal(18,2)")
    lab = S.cluster_labels(assigned, mart).join(mart, "customer_sk").groupBy("cluster_id", "cluster_label") \
        .avg("cltv").orderBy("cluster_id").collect()
    assert [r.cluster_label for r in lab] == ["Champions", "Base", "Churned"]
    assert lab[0][2] > lab[1][2] > lab[2][2]


def test_best_of_restarts_is_no_worse_than_any_seed(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(c, 0.8, (50, 2)) for c in ((0, 0), (3, 0), (0, 3), (3, 3))])
    vectors = S._vectors(_points(spark, pts, np.zeros(len(pts))), ("pc1", "pc2")).persist()
    model, cost = S.best_fits(vectors, [3], n_init=4)[3]
    each = [S.best_fits(vectors, [3], n_init=1, seed0=42 + i)[3][1] for i in range(4)]
    assert abs(cost - min(each)) < 1e-9 * cost
    c = np.array(model.clusterCenters())
    d2 = ((pts[:, None, :] - c[None, :, :]) ** 2).sum(-1).min(1).sum()
    assert abs(d2 - cost) < 1e-6 * max(1.0, d2)
    sweep = S.silhouette_sweep(_points(spark, pts, np.zeros(len(pts))), ks=(2, 4), n_init=2).collect()
    assert {r.k: r.is_best for r in sweep} == {2: False, 4: True}


def test_fits_are_those_of_spark_ml_in_common_passes(spark):
    from pyspark.ml.clustering import KMeans
    pts = np.random.default_rng(11).uniform(0, 1, (3000, 2))
    vectors = S._kept_vectors(_points(spark, pts, np.zeros(len(pts))), ("pc1", "pc2"))
    tracker = spark.sparkContext.statusTracker()
    before = max(tracker.getJobIdsForGroup())
    fits = S.best_fits(vectors, [2, 5, 8], n_init=4)
    # Five jobs or so a start and one a pass; a job for every iteration of every fit would be several times as many.
    assert max(tracker.getJobIdsForGroup()) - before < 300
    for k, (model, cost) in fits.items():
        each = [KMeans(k=k, seed=s, maxIter=300, tol=1e-4, featuresCol="_features").fit(vectors) for s in range(42, 46)]
        want = min(each, key=lambda m: m.summary.trainingCost)
        assert abs(cost - want.summary.trainingCost) < 1e-9 * cost
        assert np.allclose(model.clusterCenters(), want.clusterCenters(), atol=1e-9)
        got = vectors.select("_features", model.nearest(("pc1", "pc2")).alias("near"))
        assert want.transform(got).where("near != prediction").count() == 0


def test_a_center_without_points_stays_and_few_points_get_few_centers(spark):
    vectors = S._vectors(_points(spark, np.array([[0.0, 0.0], [1.0, 0.0]]), np.zeros(2)), ("pc1", "pc2")).persist()
    (centers, cost), = S._improved(S._blocks(vectors), [np.array([[0.0, 0.0], [1.0, 0.0], [9.0, 9.0]])], 10, 1e-4)
    assert centers.tolist() == [[0.0, 0.0], [1.0, 0.0], [9.0, 9.0]] and cost == 0.0
    model, cost = S.best_fits(vectors, [4], n_init=2)[4]
    assert len(model.clusterCenters()) <= 2 and cost == 0.0
