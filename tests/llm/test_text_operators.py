"""Text operators against the libraries, planted cases and brute force."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from marketlens.llm import html_extract, langid, packing, sentencepiece_bpe, substring_dedup, toxicity, url_filter

ALPHABET = "ab éü.,_-1² \n\t▁日😀\x00'\"(){}<>s/́AÉİΣσς|\xa0"


def fuzz(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


EDGE = ["", " ", "  a  b ", "\n", "▁a▁", "<s> </s>", "x <|endoftext|> y", "was " * 5000, "don't I'll \"x\".", "a² ².x"]


def test_sentencepiece_matches_the_library():
    m = sentencepiece_bpe.Bpe(public_tokenizers.path("piece_bpe_32k.model"))
    for t in EDGE + fuzz(1500, 1):
        ids = m.library.encode(t)
        assert m.encode(t) == ids, t
        assert m.decode(ids) == m.library.decode(ids), t


def test_sentencepiece_groups_of_texts_match_the_library(monkeypatch):
    m = sentencepiece_bpe.Bpe(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [None, *EDGE, *fuzz(1500, 4), "é① ²x\r\n  日本" * 3000, None]
    for size in (1 << 20, 50, 7):  # texts beyond the size go through in pieces
        monkeypatch.setattr(sentencepiece_bpe, "GROUP_CHARS", size)
        n, ids, decoded = m.round_trip(texts if size > 50 else texts[:400])
        for t, k, i, d in zip(texts, n, ids, decoded):
            theirs = m.library.encode(t or "")
            assert (k, i, d) == (len(theirs), ",".join(map(str, theirs)), m.library.decode(theirs)), (size, t)
    assert m.round_trip([])[1] == [] and m.round_trip([None, ""])[1] == ["", ""]


def test_sentencepiece_segments_merge_together(monkeypatch):
    m = sentencepiece_bpe.Bpe(public_tokenizers.path("piece_bpe_32k.model"))
    segments = sorted({p for t in EDGE + fuzz(400, 5) if t for p in m._segments([" " + t])[0].to_pylist()})
    segments = [s.replace(" ", "▁") for s in segments]
    by_agenda = [m.merge(s) for s in segments]
    rows = sum(len(s) <= sentencepiece_bpe.ROW_CHARS and (m.char_symbols[[ord(c) for c in s]] > 0).all() for s in segments)
    calls, merge = [], m.merge
    monkeypatch.setattr(m, "merge", lambda s: calls.append(s) or merge(s))
    ids, joined, surface = m._merge_all(segments)
    assert ids == by_agenda and rows > 100 and len(calls) == len(segments) - rows
    assert joined == [",".join(map(str, x)) for x in ids] and surface == [m.surface(x) for x in ids]


def test_word_cache_matches_the_library():
    c = packing.WordCache(public_tokenizers.path("word_bpe_49k.json"))
    assert c.plain
    for t in EDGE + fuzz(1500, 2):
        assert c.encode(t) == np.array(c.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_best_fit_is_gapless_and_tight():
    rnd = np.random.default_rng(3)
    lengths = np.concatenate((rnd.integers(1, 4097, 3000), np.full(500, 2048), np.full(200, 4096)))
    seq, off = packing.best_fit(lengths)
    for s in np.unique(seq):
        rows = np.flatnonzero(seq == s)
        rows = rows[np.argsort(off[rows])]
        assert off[rows].tolist() == [0, *np.cumsum(lengths[rows])[:-1].tolist()]
        assert lengths[rows].sum() <= 4096 and (lengths[rows] > 4096 / 3).sum() <= 2
    assert packing.cut(b"\0" * 4 * 4097)[1][:3] == (1, 4096, 1)


def test_html_page():
    p = html_extract.Page("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two"
                          "<p>th<b>re</b>e<div class='comments'>c</div><script>var x='</p>'</script></article><footer>f</footer>")
    assert " ".join(t for t, _ in p.article()) == "A & B one two three"
    for broken in ("", "<", "<p", "<script>never closed <p>x", "a<b", "<!-- open", "</p></div>"):
        html_extract.Page(broken).article()


def test_template_blocks_go_and_copied_articles_stay(spark):
    rows = [(i, "http://h.example/x", f"<body><div><p>site slogan</p></div><div><p>story {i} only here</p></div></body>") for i in range(30)]
    rows += [(100 + i, "http://h.example/y", "<body><article><p>copied article</p></article></body>") for i in range(30)]
    rows += [(200, None, None), (201, "nothing", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert len(got) == 62 and got[3] == "story 3 only here" and got[110] == "copied article" and got[200] == got[201] == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def test_language_filters(spark):
    text = {"xx": "tionre thand ofer ", "yy": "éauque ñolla ciónez "}
    rows = [(i, text[k] * (1 + i % 5), k) for i in range(60) for k in text] + [(200, None, "xx"), (201, "", None), (202, "12 !", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.train(df)).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got if r.doc_id < 200)
    assert {r.lang_pred for r in got if r.doc_id >= 200} == {"und"}
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}


def test_toxicity_learns_planted_words(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        t = [rnd.choice(words) for _ in range(60)]
        if i % 5 == 0:
            t[rnd.randrange(60)] = t[rnd.randrange(60)] = "zork"
        docs.append((i, " ".join(t)))
        labels.append((i, int(i % 5 == 0)))
    docs += [(1000, None), (1001, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y)
    got = {r.doc_id: r.score for r in toxicity.score_texts(d, model).collect()}
    right = sum((got[i] >= 0.5) == bool(t) for i, t in labels)
    assert right >= 0.97 * len(labels) and got[1000] == got[1001] < 0.5
    none = toxicity.train(d, y.limit(0))
    assert {r.score for r in toxicity.score_texts(d, none).collect()} == {0.5}


@pytest.mark.parametrize("url,rule,verdict", [("http://a.b.COM/x", "com/", "allow"), ("http://example.com/en/1", "example.com/en/", "block"),
                                              ("https://www.example.com/en/1?q", "www.example.com/en/", "allow"), ("http://x.net/es/", "net/es/", "block")])
def test_url_rules(spark, url, rule, verdict):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    df = spark.createDataFrame([(1, url), (2, None), (3, "no scheme")], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df, rules).collect()}
    assert (got[1].rule, got[1].verdict) == (rule, verdict)
    assert got[2].host == got[2].path == got[3].host == "" and got[2].rule is None and got[2].verdict in ("allow", "block")


def test_passages_are_cut_from_later_documents(spark):
    rnd = random.Random(7)
    new = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    passage = new(55)
    rows = [(i, f"{new(40)} {passage} {new(700 if i == 3 else 30)}") for i in range(6)]
    rows += [(10, new(120)), (11, None), (12, ""), (None, passage), (13, rows[0][1]), (14, new(10)), (15, "was " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' as component_id0")
    got = {r.doc_id: r for r in substring_dedup.clean(df.drop("component_id0"), report=True).collect()}
    assert got[0].text == rows[0][1] and got[10].text == rows[6][1] and got[13].text == "" and got[11].text is None
    for i in range(1, 6):
        assert passage not in got[i].text and got[i].removed_words == 55 and got[i].component_id == 0
    assert substring_dedup.clean(df.limit(0)).count() == 0


def test_passages_are_found_beside_an_earlier_unlike_document(spark):
    rnd = random.Random(11)
    new = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    rows, passages = [], []
    for i in range(30):
        words = new(50).split()
        passages.append(" ".join(words))
        part = " ".join(words[:39])
        # The least document holds 39 of the 50 words, and in a later block the whole passage for odd i.
        rows.append((3 * i, f"{new(30)} {part} {new(1300)} {passages[i] if i % 2 else ''} {new(30)}"))
        rows += [(3 * i + k, f"{new(40)} {passages[i]} {new(40)}") for k in (1, 2)]
    got = {r.doc_id: r.text for r in substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, passage in enumerate(passages):
        assert got[3 * i] == rows[3 * i][1]
        assert (passage in got[3 * i + 1]) == (i % 2 == 0)
        assert passage not in got[3 * i + 2]


def test_section_notice_goes_on_a_large_host(spark):
    # 100 pages in 10 sections: each section's notice is on a tenth of the host's pages.
    rows = [(i, f"http://h.com/s{i % 10}/{i}", f"<body><div><b>Notice of section {i % 10}</b></div><div>Own text {i}</div></body>")
            for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {i: f"Own text {i}" for i in range(100)}


def test_bands_find_near_copies_at_the_threshold():
    rnd = random.Random(5)
    new = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]

    def keys(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        return set(substring_dedup.band_keys(data, np.array([0, len(data)]))[0].tolist())

    found = 0
    for _ in range(200):
        passage = new(50)
        near = [*passage[:25], "changed", *passage[26:]]  # 41 of 51 shingles shared
        found += bool(keys(new(60) + passage + new(60)) & keys(new(60) + near + new(60)))
    assert found >= 196
