"""Dedup, SimHash, components and search against brute force."""

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from marketlens.llm import ann, exact_dedup, simhash
from marketlens.llm.graph import connected_components


def test_exact_dedup_edge_rows(spark):
    rows = [(1, "a  b", "p"), (2, "a b", "q"), (1, "a b", "r"), (None, "a\tb", "s"), (None, None, "t"), (5, "", "u"), (3, "c", "v"),
            (3, "c", "v"), (4, "x" * 50_000, "w"), (9, "x" * 50_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert exact_dedup.deduplicate(df.limit(0)).count() == exact_dedup.mark(df.limit(0)).count() == 0


def test_masks_cover_every_triple():
    masks = simhash.covering_masks(list(range(64)))
    for a in range(64):
        for b in range(a, 64):
            left = [m for m in masks if not (m >> a | m >> b) & 1]
            seen = 0
            for m in left:
                seen |= ~m
            assert seen & (1 << 64) - 1 == (1 << 64) - 1


def test_fingerprint_definition():
    rnd = random.Random(1)
    texts = [None, "", " \t", "One", "Two Words", "É É É É"] + [" ".join(rnd.choice("ABCdef") for _ in range(rnd.randint(1, 40))) for _ in range(50)]
    got = simhash.fingerprint_batch(pa.array(texts, pa.string())).view(np.uint64)
    for t, g in zip(texts, got, strict=True):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in grams]
        assert int(g) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_links_match_brute_force_also_in_split_buckets(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(40)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    want = {}
    for i, x in enumerate(fps):
        want.setdefault(find(i), set()).add(x)
    want = sorted(map(sorted, (g for g in want.values() if len(g) > 1)))
    for bucket in (4096, 5):
        got = {}
        for r in connected_components(simhash.linked_fingerprints(df, bucket_rows=bucket), "t").collect():
            got.setdefault(r.component, set()).add(r.node % (1 << 64))
        assert sorted(map(sorted, got.values())) == want


def test_near_duplicates_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b c d e f", 1), (4, "A b c d e f", 2), (4, "a b c d e f", 3), (None, "q", 4)],
                               "doc_id long, text string, fp int")
    got = {(r.id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got[(2, "0" * 16)] == 1
    assert [v for (i, _), v in got.items() if i == 4] == [3]
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(df).collect()) == ["1", "3", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_nearest_recall_and_unusable_vectors(spark):
    rnd = np.random.default_rng(4)
    v = rnd.standard_normal((1500, 16)) * rnd.uniform(0.5, 2, (1500, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 20 == 0, block_rows=500).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 20)) and (got.groupby("query_id")["rank"].max() == 20).all()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(g["id"]))
        assert np.allclose(g.sort_values("rank").score, s[g.sort_values("rank")["id"]])
    assert hit >= 0.9 * 20 * 75
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_deduplicate_decides_by_text_not_by_id(spark):
    rnd = random.Random(3)
    text = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(6)]
    rows = [(5, text[0], "a"), (7, text[0], "b"), (7, text[1], "c"), (None, text[0], "d"), (None, text[2], "e"), (None, text[3], "f"),
            (None, text[3], "g"), (8, text[4], "h"), (8, text[5], "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(r.kept for r in simhash.deduplicate(df).collect())
    assert got in (["a", "c", "e", "f", "h", "i"], ["a", "c", "e", "g", "h", "i"])
    assert simhash.deduplicate(df.limit(0)).columns == df.columns


def test_search_answers_every_length_and_repeats_itself(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6 if i % 3 else 4).tolist(), "clash") for i in range(240)]
    rows += [(20, [9.0] * 6, "clash"), (300, [0.0] * 6, "x"), (320, None, "x"), (340, [float("nan")] * 6, "x"), (None, [1.0] * 6, "x"), (360, [], "x")]
    rows += [(500 + i, rows[40][1], "tie") for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4)
    ask = F.col("id") % 20 == 0
    got = [[tuple(r) for r in ann.nearest(x, ask, k=5, block_rows=40, query_rows=4, confidence=0.999999).orderBy("query_id", "rank").collect()]
           for x in (df, df.repartition(3, "vec_id"))]
    assert got[0] == got[1]
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and np.isfinite(v).all() and np.any(v)]
    want = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        own = min((v for i, v in good if i == q), key=lambda v: (len(v), v.tolist()))
        near = sorted((-float(np.dot(v, own)), i) for i, v in good if i != q and len(v) == len(own))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(near, 1)]
    assert [(q, k, i) for q, k, i, _ in got[0]] == [(q, k, i) for q, k, i, _ in want]
    assert np.allclose([x[3] for x in got[0]], [x[3] for x in want])
    assert ann.nearest(df.limit(0), ask).count() == 0
