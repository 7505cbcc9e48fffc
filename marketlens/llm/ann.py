"""Nearest neighbours by inner product: stable projections, a kd-tree, a chi-square stopping test.

Inner product search becomes Euclidean search by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, zero for queries; distances are then
|q|^2 + M^2 - 2<q, x>. Vectors are dealt to blocks of about ``BLOCK_ROWS`` by hash. A
block projects its vectors to ``PROJECTED`` dimensions with one fixed Gaussian
(2-stable) matrix and indexes the projections in a kd-tree. A query walks the tree's
leaves by their distance from its projection and verifies their vectors exactly. A
vector at true distance d has a squared projected distance of d^2 times a chi-square
variable with ``PROJECTED`` degrees of freedom, so the walk stops once
chi2(next leaf distance^2 / d_k^2) >= ``CONFIDENCE``, d_k the distance of the k-th best
so far: a nearer vector would then have shown up with that probability. Blocks' results
merge by exact score.

Query blocks meet vector blocks as bounded pairs; neither side is broadcast. Vectors
that are null, zero, or hold null or non-finite components take no part; a query is answered
among the vectors of its own length, which have blocks of their own. Rows that share a
query's id are the query's own and are skipped; of repeated query ids the least vector asks
(the shortest, then by components); repeated candidates each count. Scores are double inner products of the original
vectors; ties go to the smaller id. An empty table gives no row.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PROJECTED = 8
CONFIDENCE = 0.9
LEAF_ROWS = 32
BLOCK_ROWS = 16_384
QUERY_ROWS = 8_192
SEED = 7


def chi2_quantile(p: float, dof: int) -> float:
    """x with P(chi-square with an even ``dof`` <= x) = p, by bisection on the closed form."""
    def cdf(x: float) -> float:
        return 1.0 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


@lru_cache(maxsize=4)
def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTED))


class KdTree:
    """Median splits down to leaves of at most LEAF_ROWS points; leaves keep their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        spans = [(0, len(points))]
        leaves = []
        while spans:
            a, b = spans.pop()
            rows = self.order[a:b]
            sub = points[rows]
            if b - a <= LEAF_ROWS:
                leaves.append((a, b, sub.min(axis=0), sub.max(axis=0)))
                continue
            axis = int(np.argmax(sub.max(axis=0) - sub.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = rows[np.argpartition(sub[:, axis], mid)]
            spans += [(a, a + mid), (a + mid, b)]
        leaves.sort(key=lambda x: x[0])
        self.start = np.array([x[0] for x in leaves])
        self.stop = np.array([x[1] for x in leaves])
        self.low = np.array([x[2] for x in leaves])
        self.high = np.array([x[3] for x in leaves])

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from each query projection to each leaf's box."""
        out = np.zeros((len(q), len(self.start)))
        for d in range(q.shape[1]):
            x = q[:, d:d + 1]
            out += np.maximum(0.0, np.maximum(self.low[:, d] - x, x - self.high[:, d])) ** 2
        return out


def search_block(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, norm2: float,
                 k: int, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's nearest found in one block."""
    n, dim = vectors.shape
    proj = projection(dim + 1)
    lift = np.sqrt(np.maximum(0.0, norm2 - np.einsum("ij,ij->i", vectors, vectors)))
    tree = KdTree(vectors @ proj[:dim] + lift[:, None] * proj[dim])
    ids, vectors = ids[tree.order], vectors[tree.order]
    limit = chi2_quantile(confidence, PROJECTED)
    found_q, found_i, found_s = [], [], []
    width = int((tree.stop - tree.start).max())
    for a in range(0, len(qids), 256):
        q, qid = queries[a:a + 256], qids[a:a + 256]
        m = len(q)
        dist = tree.leaf_distances(q @ proj[:dim])
        walk = np.argsort(dist, axis=1, kind="stable")
        q2 = np.einsum("ij,ij->i", q, q) + norm2
        best_s, best_i = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
        live = np.arange(m)
        for step in range(walk.shape[1]):
            leaf = walk[live, step]
            kth = best_s[live, -1]
            d2 = np.maximum(0.0, q2[live] - 2 * kth)  # infinite until k are found
            live = live[dist[live, leaf] < limit * d2]
            if not len(live):
                break
            leaf = walk[live, step]
            at = tree.start[leaf][:, None] + np.arange(width)
            ok = at < tree.stop[leaf][:, None]
            at = np.minimum(at, n - 1)
            s = np.matmul(vectors[at], q[live][:, :, None])[:, :, 0]
            cand = ids[at]
            ok &= cand != qid[live][:, None]
            s[~ok] = -np.inf
            # Only queries whose leaf can change their list are merged.
            change = s.max(axis=1) >= best_s[live, -1]
            rows = live[change]
            if not len(rows):
                continue
            all_s = np.hstack([best_s[rows], s[change]])
            all_i = np.hstack([best_i[rows], np.where(ok, cand, np.iinfo(np.int64).max)[change]])
            top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best_s[rows] = np.take_along_axis(all_s, top, 1)
            best_i[rows] = np.take_along_axis(all_i, top, 1)
        r, c = np.nonzero(np.isfinite(best_s))
        found_q.append(a + r)
        found_i.append(best_i[r, c])
        found_s.append(best_s[r, c])
    return np.concatenate(found_q), np.concatenate(found_i), np.concatenate(found_s)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, v) of the vectors that take part; dim is their length."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), F.col(vec_col).cast("array<double>").alias("v")) \
        .where(F.col("id").isNotNull() & v.isNotNull() & (F.col("dim") > 0)).where(good)


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
            block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """Each query's ``k`` nearest found: query_id, rank (from 1), id, score. ``is_query`` is a condition on ``id``."""
    rows = materialize(usable(df, id_col, vec_col), "vectors")
    queries = rows.where(is_query).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.dim", "q.v")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    # One row per vector length: block counts and the largest norm.
    stats = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm2).alias("norm")).collect()
    asked = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    longest = {r["dim"]: float(r["norm"]) for r in stats}

    def per_length(counts: dict[int, int], size: int) -> Column:
        pairs = [F.lit(x) for d, n in counts.items() for x in (d, max(1, math.ceil(n / size)))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("dim")), F.lit(1)) if pairs else F.lit(1)

    blocks = per_length({r["dim"]: r["n"] for r in stats}, block_rows)
    query_blocks = per_length(asked, query_rows)

    def deal(x: DataFrame, own: str, own_n: Column, other: str, other_n: Column) -> DataFrame:
        return x.withColumn(own, F.pmod(F.xxhash64("id"), own_n).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), other_n - 1)))

    def work(cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(cand) or not len(ask):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        cand, ask = cand.sort_values("id"), ask.sort_values("id")
        qids = ask["id"].to_numpy(np.int64)
        q, i, s = search_block(cand["id"].to_numpy(np.int64), np.stack(cand["v"].to_list()), qids,
                               np.stack(ask["v"].to_list()), longest[int(ask["dim"].iloc[0])], k, confidence)
        return pd.DataFrame({"query_id": qids[q], "id": i, "score": s})

    left = deal(rows, "b", blocks, "qb", query_blocks).groupBy("dim", "b", "qb")
    right = deal(queries, "qb", query_blocks, "b", blocks).groupBy("dim", "b", "qb")
    found = left.cogroup(right).applyInPandas(work, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
