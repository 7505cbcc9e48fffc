"""Substring dedup, packing and exact dedup: brute force, hot keys and edge rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import exact_dedup, packing, substring_dedup
from marketlens.llm import substring_dedup as S


def words(rnd, n):
    return " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))


@pytest.fixture
def pairs_compared(monkeypatch):
    seen = []
    real = S.materialize

    def spy(df, name):
        out = real(df, name)
        if name == "paragraph-pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(S, "materialize", spy)
    return seen


def test_unlike_documents_that_share_a_line_are_not_all_compared(spark, pairs_compared):
    rnd = random.Random(21)
    line = words(rnd, 35)
    done = []
    for n in (50, 100, 200):
        rows = [(i, f"{words(rnd, 60)} {line} {words(rnd, 60)}") for i in range(n)]
        got = substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, got)) == rows
        done.append(sum(pairs_compared))
        pairs_compared.clear()
    assert done[1] <= 2.5 * done[0] + 20 and done[2] <= 2.5 * done[1] + 20 and done[2] < 200 * 8


def test_copies_of_a_frequent_passage_are_compared_with_one_of_them(spark, pairs_compared):
    rnd = random.Random(22)
    passage, line = words(rnd, 70), words(rnd, 30)
    rows = [(i, f"{words(rnd, 50)} {passage} {words(rnd, 50)}" if i % 3 else f"{words(rnd, 30)} {line} {words(rnd, 90)}") for i in range(150)]
    got = {r.doc_id: r for r in substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    for i, text in rows:
        if i % 3 and i > 1:
            assert passage not in got[i].text and got[i].removed_words == 70 and got[i].component_id == 1
        else:
            assert got[i].text == text
    assert sum(pairs_compared) < 150 * 6


def test_near_copies_beside_a_frequent_line_are_found(spark):
    rnd = random.Random(23)
    line = words(rnd, 20)
    rows = [(i, f"{words(rnd, 60)} {line} {words(rnd, 60)}") for i in range(60)]
    pairs = []
    for k in range(25):
        own = words(rnd, 50).split()
        near = [*own[:5], "changed", *own[6:]]
        rows += [(100 + 2 * k, f"{words(rnd, 20)} {' '.join(own)} {line} {words(rnd, 20)}"),
                 (101 + 2 * k, f"{words(rnd, 20)} {' '.join(near)} {line} {words(rnd, 20)}")]
        pairs.append(101 + 2 * k)
    got = {r.doc_id: r.removed_words for r in
           substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    assert sum(got[i] >= 44 for i in pairs) >= 24 and all(v == 0 for i, v in got.items() if i not in pairs)


def brute_spans(texts):
    """Words of each text (by number) that lie in a 50-word window repeated exactly in an earlier text."""
    seen, out = set(), []
    for t in texts:
        w = t.lower().split()
        windows = [tuple(w[i:i + 50]) for i in range(len(w) - 49)]
        gone = np.zeros(len(w), bool)
        for i, x in enumerate(windows):
            if x in seen:
                gone[i:i + 50] = True
        seen.update(windows)
        out.append(gone)
    return out


def test_every_exact_window_brute_force_finds_is_cut(spark):
    rnd = random.Random(24)
    stock = [words(rnd, rnd.choice([20, 30, 50, 51, 80, 200])) for _ in range(12)]
    texts = []
    for i in range(120):
        parts = [x for _ in range(rnd.randint(1, 4)) for x in (words(rnd, rnd.randint(5, 60)), rnd.choice(stock))]
        texts.append(" ".join(parts + ([words(rnd, 1500)] if i % 40 == 7 else [])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup.clean(df).collect()}
    missed = found = 0
    kept_windows = set()
    for i, (text, gone) in enumerate(zip(texts, brute_spans(texts), strict=True)):
        left = got[i].lower().split()
        found += int(gone.sum())
        here = {tuple(left[k:k + 50]) for k in range(len(left) - 49)}
        missed += len(here & kept_windows)
        kept_windows |= here
        assert len(left) >= len(text.split()) - int(gone.sum()) - 12 * 4  # little beyond the repeated windows goes
    assert found > 3000 and missed == 0


def test_report_replaces_clashing_columns(spark):
    rnd = random.Random(25)
    passage = words(rnd, 60)
    rows = [(i, passage, "x", 5, "y") for i in range(3)] + [(None, passage, "x", 5, "y"), (9, None, "x", 5, "y"), (2, passage, "x", 5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_spans int, id string")
    out = substring_dedup.clean(df, report=True)
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert out.columns.count("component_id") == out.columns.count("n_spans") == 1
    assert [(r.doc_id, r.text, r.component_id) for r in got[:4]] == [(0, passage, 0), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert got[-1].doc_id is None and got[-1].text == passage and got[4].text is None
    assert substring_dedup.clean(df.limit(0), report=True).count() == 0


# ---- packing

def test_packing_equals_plain_python_with_null_and_large_ids(spark):
    rnd = random.Random(26)
    big = 9007199254740993
    rows = [(big, "One two", "s", 1), (big + 2, "three", "s", 1), (None, "four five", "s", 1), (None, None, "s", 1), (7, "", "s", 1),
            (7, "", "s", 1), (8, "word " * 9000, "s", 1)] + [(i, words(rnd, rnd.randint(0, 900)), "s", 1) for i in range(100, 190)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, length int").repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    want = []
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    got = packing.pack(packing.pieces(df, path), shard_rows=20).collect()
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted([(r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack_documents(df.limit(0), path).count() == 0


# ---- exact dedup

def test_exact_dedup_plan_is_small_and_keeps_unlike_texts(spark):
    rnd = random.Random(27)
    texts = [words(rnd, 3) for _ in range(200)]
    rows = [(i, rnd.choice(texts), "k") for i in range(600)] + [(i, words(rnd, 3), "k") for i in range(1000, 1400)] + [(None, texts[0], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    out = exact_dedup.deduplicate(df)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    kept = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept.setdefault(t, i)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((i, t) for t, i in kept.items())


def test_exact_dedup_decides_each_row_once(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    out = exact_dedup.deduplicate(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Texts are normalised and hashed before the branches; the tables of the first steps are no part of them.
    assert "regexp_replace" not in plan and "sha2" not in plan, plan
    assert sorted(r.doc_id for r in out.collect()) == list(range(7))


def test_signatures_pass_every_pair_that_holds_a_span():
    rng = random.Random(8)
    line = [f"c{i}" for i in range(44)]
    texts = []
    for i in range(60):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(40, 500))]
        if i % 3 == 0 and len(w) > 60:
            w[10:10] = line[:rng.randrange(30, 45)]
        if texts and i % 2:
            other = rng.choice(texts).split()
            part = other[:rng.randrange(40, 200)]
            w[5:5] = [x if rng.random() > 0.03 else "edit" for x in part]
        texts.append(" ".join(w[:561]))
    sigs = S._signatures(pa.array(texts))
    words = [S.tb.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), whitespace=True)[0] for t in texts]
    pairs = [(i, j) for i in range(60) for j in range(60) if i != j]
    a, b = (pa.array(x, pa.int64()) for x in zip(*pairs))
    batch = pa.RecordBatch.from_arrays([a, a, b, b, sigs.take(a), sigs.take(b)], ["id", "block", "rep", "rep_block", "sig", "rep_sig"])
    kept = {(r["id"], r["rep"]) for out in S._may_repeat(iter([batch])) for r in out.to_pylist()}
    held = {p for p in pairs if S.common_spans(words[p[0]], words[p[1]])}
    assert held and held <= kept and len(kept) < len(pairs) // 4


def test_shuffle_files_of_written_tables_go_and_workers_get_small_batches(spark):
    from marketlens.llm import common
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before, rows = spark.conf.get(common.SHUFFLE_CLEANUP), spark.conf.get(common.ARROW_KEY)
    held = tracker.shuffleStatuses().size()
    out = common.materialize(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "cleanup-test")
    assert out.count() == 7 and tracker.shuffleStatuses().size() <= held + 1  # that of the count
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == before
    try:
        for given, kept in (("10000", "1000"), ("50", "50"), ("0", "1000")):
            spark.conf.set(common.ARROW_KEY, given)
            common.workers_find_package(spark)
            assert spark.conf.get(common.ARROW_KEY) == kept
    finally:
        spark.conf.set(common.ARROW_KEY, rows)


def test_a_word_said_over_and_over_is_one_passage():
    rng = random.Random(31)

    def hashes(w):
        t = " ".join(w)
        return S.tb.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), whitespace=True)[0]

    def own(n):
        return [f"q{rng.randrange(10**6)}" for _ in range(n)]

    for la, lb, unit in ((120, 90, ["the"]), (300, 60, ["the"]), (60, 300, ["so"]), (120, 100, ["la", "li", "lo"])):
        a, b = own(20) + (unit * la)[:la] + own(30), own(50) + (unit * lb)[:lb] + own(10)
        cut = np.zeros(len(a), bool)
        for s, e, rs, re in S.common_spans(hashes(a), hashes(b)):
            cut[s:e] = True
            assert 50 <= rs < re <= 50 + lb
        assert all(e - s < 50 for s, e in S._runs(~cut[20:20 + la])), (la, lb, S._runs(cut))  # no paragraph of the run is left
        assert not cut[:20].any() and not cut[20 + la:].any()
    assert S.common_spans(hashes(own(20) + ["the"] * 60), hashes(own(20) + ["the"] * 30 + own(40))) == []


def test_repeats_of_one_word_leave_with_the_first_representative(spark, pairs_compared):
    rnd = random.Random(32)
    rows = [(i, f"{words(rnd, 40)} {'the ' * rnd.randint(60, 140)}{words(rnd, 40)}") for i in range(60)]
    got = {r.doc_id: r for r in substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    assert got[0].text == rows[0][1] and all(got[i].removed_words >= 56 and got[i].component_id == 0 for i in range(1, 60))
    assert sum(pairs_compared) < 60 * 2


def test_only_paragraphs_whose_shingles_two_blocks_hold_are_compared_further(spark, pairs_compared):
    rnd = random.Random(33)
    lines = [words(rnd, 20) for _ in range(6)]
    rows = [(i, " ".join(f"{words(rnd, 60)} {line}" for line in rnd.sample(lines, 3)) + " " + words(rnd, 60)) for i in range(60)]
    assert sorted(map(tuple, substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == rows
    assert sum(pairs_compared[1:]) == 0  # nothing is left after the first representatives


def test_words_of_a_large_vocabulary_are_tokenised_once():
    cache = packing.WordCache(public_tokenizers.path("word_bpe_49k.json"))
    learned, real = [], cache._learn
    cache._learn = lambda new: (learned.extend(new), real(new))[1]
    text = " ".join(f"{'abcdefghij'[i % 10]}{i * 7919 % 100_003}" for i in range(100_000))
    first = cache.encode(text)
    assert cache.encode(text) == first and len(learned) == 100_000


def test_exact_dedup_normalises_a_text_once_a_scan(spark, monkeypatch):
    seen, real = {}, exact_dedup.materialize

    def spy(df, name):
        seen.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace("))
        return real(df, name)

    monkeypatch.setattr(exact_dedup, "materialize", spy)
    df = spark.createDataFrame([(i, f"text  {i % 7}\t") for i in range(30)] + [(30, None), (31, ""), (32, "alone")], "doc_id long, text string")
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark(df).collect()}
    assert got == {**{i: (i % 7, 5 if i % 7 < 2 else 4, i < 7) for i in range(30)}, 30: (30, 2, True), 31: (30, 2, False), 32: (32, 1, True)}
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(df).collect()) == [*range(7), 30, 32]
    assert seen["text-digests"] == seen["copy-digests"] == 1 and seen["shared-values"] == 1


def test_spent_tables_are_deleted(spark, monkeypatch):
    from pathlib import Path

    from marketlens.llm import common
    folders, real = [], S.materialize

    def spy(df, name):
        out = real(df, name)
        folders.append((name, Path(common._FOLDERS[out].removeprefix("file:"))))
        return out

    monkeypatch.setattr(S, "materialize", spy)
    rnd = random.Random(34)
    passage = words(rnd, 80)
    rows = [(i, f"{words(rnd, 30)} {passage} {words(rnd, 30)}") for i in range(20)]
    out = substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(folders) > 10 and {name for name, f in folders if f.exists()} == {"cuts"}
    assert sum(passage in r.text for r in out.collect()) == 1
