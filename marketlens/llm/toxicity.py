"""Toxicity score: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, adjacent pairs and one-gap pairs (skip-grams),
lower-cased and hashed into ``DIMS`` buckets. Training takes at most ``TRAIN_ROWS``
labelled texts (hash order, a documented bound). They are dealt to shards of about
``SHARD_ROWS`` texts; each shard runs FTRL-proximal with per-coordinate rates and L1,
and Spark averages the shards' weights. L1 leaves few non-zero weights (``DIMS`` at
most), which travel with the scoring function.

Null and empty texts score as the bias alone. Without any labelled text the score is
0.5. Repeated rows score alike; other columns pass through; labels that are null do
not train, and a text with several labels counts with the highest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

DIM_BITS = 18
DIMS = 1 << DIM_BITS
TRAIN_ROWS = 16_000
SHARD_ROWS = 8_000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 10.0, 0.1, 2.0, 0.0
EXPONENT = 0.3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SKIP = np.uint64(0x165667B19E3779F9)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every word, adjacent pair and one-gap pair."""
    h, _, _, doc = tb.tokens(data, offs, whitespace=False)
    shift = np.uint64(64 - DIM_BITS)
    out, docs = [h >> shift], [doc]
    for gap, salt in ((1, np.uint64(0)), (2, _SKIP)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            pair = tb.mix(h[:-gap][same] * _A + h[gap:][same] * _B + salt)
            out.append(pair >> shift)
            docs.append(doc[:-gap][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(docs)


def scale(n):
    """Value of each feature of a text with ``n`` of them, repeats included: long texts must not drown single words."""
    return np.maximum(n, 1) ** -EXPONENT


def ftrl(examples: list[tuple[np.ndarray, float]], labels: np.ndarray, epochs: int | None = None) -> np.ndarray:
    """FTRL-proximal over texts given as (distinct buckets, their value); the last weight is the bias."""
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(i):
        zi = z[i]
        l1 = np.where(i == DIMS, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0,
                        -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs or EPOCHS):
        for (idx, x), y in zip(examples, labels, strict=True):
            w = weights(idx)
            g = np.full(len(idx), 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, w[:-1].sum() * x + w[-1])))) - y)
            g[:-1] *= x
            old = n[idx]
            new = old + g * g
            z[idx] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[idx] = new
    return weights(np.arange(DIMS + 1))


def _fit_shard(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["__order", "text"], kind="stable")
    examples = []
    for _, data, offs in tb.pieces(pa.array(frame["text"], pa.string())):
        f, doc = features(data, offs)
        value = scale(np.bincount(doc, minlength=len(offs) - 1))
        key = np.unique(doc * np.int64(DIMS) + f)
        doc, f = key // DIMS, key % DIMS
        cut = np.searchsorted(doc, np.arange(len(offs)))
        examples += [(np.append(f[cut[i]:cut[i + 1]], DIMS).astype(np.int32), value[i]) for i in range(len(offs) - 1)]
    w = ftrl(examples, frame["__y"].to_numpy(float))
    at = np.flatnonzero(w)
    return pd.DataFrame({"bucket": at.astype(np.int32), "w": w[at], "rows": len(frame)})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) learned from the labelled texts of ``docs``.

    Only ids are sorted to choose the sample; its at most ``rows`` ids are the one
    thing broadcast.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y")) \
        .withColumn("__order", F.xxhash64("__id")).orderBy("__order", "__id").limit(rows).persist()
    try:
        n = chosen.count()
        shards = max(1, math.ceil(n / SHARD_ROWS))
        texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")) \
            .join(F.broadcast(chosen), "__id") \
            .select("__order", "__y", F.coalesce("text", F.lit("")).alias("text"),
                    F.pmod("__order", F.lit(shards)).cast("int").alias("__shard"))
        fitted = texts.groupBy("__shard").applyInPandas(_fit_shard, "bucket int, w double, rows long")
        out = fitted.groupBy("bucket").agg((F.sum(F.col("w") * F.col("rows")) / max(1, n)).alias("w")).toPandas()
    finally:
        chosen.unpersist()
    bias = float(out.loc[out.bucket == DIMS, "w"].sum())
    out = out[out.bucket != DIMS].sort_values("bucket")
    return out.bucket.to_numpy(np.int64), out.w.to_numpy(np.float64), bias


def score_batch(text: pa.Array, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """Probability of label 1 per text: every distinct bucket of the whole text counts once."""
    at, w, bias = model
    dense = np.zeros(DIMS)
    dense[at] = w
    out = np.full(len(text), bias)
    for row, data, offs in tb.pieces(text):
        f, doc = features(data, offs)
        n = len(offs) - 1
        value = scale(np.bincount(doc, minlength=n))
        hit = dense[f] != 0
        key = np.unique(doc[hit] * np.int64(DIMS) + f[hit])
        out[row:row + n] += np.bincount(key // DIMS, dense[key % DIMS], n) * value
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def scorer(model: tuple[np.ndarray, np.ndarray, float]):
    """Column function: text -> probability of label 1."""
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(score_batch(text, model))

    return score


def score_texts(docs: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    return docs.withColumn(out, scorer(model)(F.col(text_col)))


def predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")
