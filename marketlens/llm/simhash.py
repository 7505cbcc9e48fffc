"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprint: XXH64 (seed 42) of every three-word shingle, repeats included; a bit is
one when more than half the hashes set it. Fingerprints within ``RADIUS`` bits are
linked, exactly:

* Equal fingerprints first collapse to one row (map-side minimum of the ids).
* Every bit position gets a non-zero (RADIUS+1)-bit code. For each non-zero code v,
  table v keeps the bits whose code has an odd product with v. The codes of at most
  RADIUS differing bits span too little to reach every v, so some table drops all of
  them: each pair within the radius meets in at least one of the 2^(RADIUS+1)-1 tables.
* A bucket with more than ``BUCKET_ROWS`` fingerprints is split by the same
  construction over the bits its table drops, which keeps the guarantee; at most
  2^15 fingerprints can then still agree on all kept bits.
* Buckets are walked in sorted order; each yields a spanning forest of its links, never
  all pairs. Components are contracted in Spark.

Null and empty texts have fingerprint zero and are linked like any other. Repeated
rows share a fingerprint; null ids take part but never name a component unless all
its ids are null. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET_ROWS = 4096
_BATCH_HASHES = 1 << 18


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``bits`` such that any ``radius`` of them are all dropped by some mask."""
    codes = (1 << (radius + 1)) - 1
    code = {b: 1 + i % codes for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (code[b] & v).bit_count() % 2) for v in range(1, codes + 1)]


def shingle_hashes(text: str | None, words: int = SHINGLE) -> list[int]:
    """XXH64 of every ``words``-word shingle; of the whole sequence when it is shorter; none for no word."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return []
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)]
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1:].tolist(), strict=True)]


def fingerprint_batch(text: pa.Array, words: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints of whole texts."""
    out = np.zeros(len(text), np.uint64)
    held: list[int] = []
    sizes: list[int] = []
    first = 0

    def flush(first: int) -> None:
        n = np.array(sizes, np.int64)
        bits = np.unpackbits(np.array(held, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = np.flatnonzero(n)
        if len(rows):
            at = np.concatenate(([0], np.cumsum(n[rows])[:-1]))
            ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
            packed = np.packbits(2 * ones > n[rows, None], axis=1, bitorder="little")
            out[first + rows] = packed.view(np.uint64)[:, 0]

    for i in range(len(text)):
        h = shingle_hashes(text[i].as_py(), words)
        if len(h) > _BATCH_HASHES:  # one very long text: count its bits in slices
            ones = np.zeros(64, np.int64)
            for a in range(0, len(h), _BATCH_HASHES):
                part = np.array(h[a:a + _BATCH_HASHES], np.uint64).view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
            h = []
            sizes.append(0)
        else:
            sizes.append(len(h))
        held += h
        if len(held) >= _BATCH_HASHES:
            flush(first)
            first, held, sizes = i + 1, [], []
    if sizes:
        flush(first)
    return out.view(np.int64)


def _fingerprint(words: int):
    @F.arrow_udf("long")
    def fp(text: pa.Array) -> pa.Array:
        return pa.array(fingerprint_batch(text, words))

    return fp


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), _fingerprint(words)(F.col(text_col)).alias("fp"))


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Spanning-forest edges (root, member) of the links among distinct fingerprints."""
    left = np.arange(len(fps))
    a: list[int] = []
    b: list[int] = []
    while len(left) > 1:
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(fps[left] ^ fps[todo.pop()]) <= radius
            found = left[near].tolist()
            a += [root] * len(found)
            b += found
            todo += found
            left = left[~near]
    return a, b


def bucket_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning-forest links of every run of equal (v, k1, k2) in a sorted stream that ends with column ``fp``."""
    def links(rows: np.ndarray) -> pa.RecordBatch:
        fp = rows[3].view(np.uint64)
        run = np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))
        cut = np.append(np.flatnonzero(run), rows.shape[1])
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        a, b = [fp[near]], [fp[near + 1]]
        for i in np.flatnonzero(size > 2):
            group = fp[cut[i]:cut[i + 1]]
            x, y = _forest(group, radius)
            a.append(group[x])
            b.append(group[y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)),
                                           pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    held = np.zeros((4, 0), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        held = np.hstack([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                          for c in ("v", "k1", "k2", "fp")])])
        other = np.flatnonzero((held[:3] != held[:3, -1:]).any(axis=0))
        done = int(other[-1]) + 1 if len(other) else 0
        if done:
            yield links(held[:, :done])
            held = held[:, done:]
    if held.shape[1]:
        yield links(held)


def linked_fingerprints(classes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints (column fp) linked within ``radius``."""
    masks = covering_masks(list(range(64)), radius)
    table = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k1"))
                                for v, m in enumerate(masks)])).alias("t")
    rows = classes.select("fp", table).select("t.v", "t.k1", "fp")
    sizes = rows.groupBy("v", "k1").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(sizes, ["v", "k1"])

    split = None
    for v, m in enumerate(masks):
        free = [b for b in range(64) if not m >> b & 1]
        keys = F.array(*[F.struct((F.lit(v) + 16 * (w + 1)).alias("v"),
                                  F.col("fp").bitwiseAND(F.lit(_signed(m | extra))).alias("k2"))
                         for w, extra in enumerate(covering_masks(free, radius))])
        split = F.when(F.col("v") == v, keys) if split is None else split.when(F.col("v") == v, keys)
    small = met.where(F.col("n") <= bucket_rows).select("v", "k1", F.lit(0).cast("long").alias("k2"), "fp")
    large = met.where(F.col("n") > bucket_rows).select("k1", "fp", F.explode(split).alias("s")) \
        .select("s.v", "k1", "s.k2", "fp")
    dealt = small.unionByName(large).repartition("v", "k1", "k2").sortWithinPartitions("v", "k1", "k2", "fp")
    return dealt.mapInArrow(lambda it: bucket_edges(it, radius), "a long, b long").distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, radius: int, words: int, *more: str) -> DataFrame:
    """(id, fp, the columns ``more``, component, component_id) per row of ``docs``."""
    fp = _fingerprint(words)(F.col(text_col)).alias("fp")
    fps = materialize(docs.select(F.col(id_col).alias("id"), fp, *more), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-classes")
    comp = connected_components(linked_fingerprints(classes, radius), "simhash")
    named = classes.join(comp, classes.fp == comp.node, "left") \
        .select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return fps.join(named.join(least, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (least id reachable)."""
    return _components(docs, id_col, text_col, radius, words) \
        .select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """One row of every component of linked texts; all columns kept.

    The row with the least id stays; among rows that repeat that id (or in a component of null ids only),
    the one with the least text hash, and one of those with equal texts. Decided per (id, text hash), so a
    repeated or null id loses its linked texts only.
    """
    keyed = docs.withColumn("__t", F.xxhash64(F.col(text_col)))
    found = materialize(_components(keyed, id_col, text_col, radius, words, "__t"), "simhash-found")
    best = found.where(F.col("id").eqNullSafe(F.col("component_id"))) \
        .groupBy("component").agg(F.min("__t").alias("__t"), F.min("component_id").alias("id"))
    stay = best.select(F.col("id").alias("__id"), F.col("__t").alias("__h"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__h"))
    kept = keyed.join(stay, same, "left_semi")
    # Rows equal in id and text: few, and one of each stays.
    twice = found.groupBy("id", "__t").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("__id"), F.col("__t").alias("__h"))
    if twice.isEmpty():
        return kept.drop("__t")
    names = [c for c in docs.columns]
    once = kept.join(twice, same, "left_anti").select(*names)
    rest = kept.join(twice, same, "left_semi").groupBy(id_col, "__t").agg(F.first(F.struct(*names)).alias("__row")).select("__row.*")
    return once.unionByName(rest)
