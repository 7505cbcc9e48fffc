"""Prefix trie, chat formatting and ranked search against brute force and round trips."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import chat_format as C
from marketlens.llm import lexical_search as L
from marketlens.llm import prefix_trie as P
from marketlens.llm import queries as Q

CONV = "conv_id long, turn long, role string, text string, depth string, rep long"


def rebuilt(rows):
    """conv_id -> list of (role, text), by the rule of op12."""
    conv = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            conv[c].append(((turn is not None, turn or 0), tie, (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in conv.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def brute_trie(rows):
    nodes = collections.defaultdict(dict)
    for c, seq in rebuilt(rows).items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])][c] = d == len(seq)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for s in nodes:
        if s:
            children[s[:-1]] += 1
    for s, members in nodes.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(members) - 1) * len(s[-1][1].encode()) if s else 0
            leaves[s[:d]] += s not in children
    return sorted((min(m), len(s), min(nodes[s[:-1]]) if s else -99, len(m), children[s], leaves[s], saved[s],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if m[c]).encode()).hexdigest()) for s, m in nodes.items())


def run_trie(df):
    conv = F.col("conv_id")
    out = P.trie(df, base=conv - conv % 5, keep=F.crc32(conv.cast("string")) % 9, max_head=8)
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in out.collect())


def conversations(seed, n):
    rnd = random.Random(seed)
    words = ["hi", "", None, "sí ñ", "a\nb", "x" * 3000]
    rows = []
    for c in rnd.sample(range(-40, 200), n):
        for t in range(rnd.choice([1, 2, 3, 5, 12, 40])):
            turn = rnd.choice([t, t, t, None, 3])
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice(words[:rnd.choice([1, 2, 6])]), "clash", 7))
    rows += [(None, 0, "user", "no conversation", "x", 1)] + rows[:3]
    return rows


def test_trie_equals_brute_force(spark):
    for seed, n in ((1, 60), (2, 3)):
        rows = conversations(seed, n)
        assert run_trie(spark.createDataFrame(rows, CONV)) == brute_trie(rows)


def test_trie_of_one_hot_conversation_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_BYTES", 64)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400) for t in range(10)] + [(c, 0, "user", "alone") for c in range(1000, 1020)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert run_trie(df) == brute_trie(rows)
    assert run_trie(df.limit(0)) == []


def test_trie_rebuilds_on_a_collision(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t} {c % 3}") for c in range(20) for t in range(3)]
    real = P.elements
    calls = []

    def clumsy(digest):
        calls.append(1)
        return [F.lit(5).cast("long")] * P.LANES if len(calls) == 1 else real(digest)

    monkeypatch.setattr(P, "elements", clumsy)
    assert run_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")) == brute_trie(rows)
    assert len(calls) == 2


def test_fingerprints_compose(spark):
    def lanes(seq, seed):
        h = [0] * P.LANES
        for i, ts in enumerate(seq, 1):
            h = [(x + t * pow(a, i, P.PRIME)) % P.PRIME for x, t, a in zip(h, ts, P.bases(seed), strict=True)]
        return h

    rnd = random.Random(4)
    seq = [[rnd.randrange(P.PRIME) for _ in range(P.LANES)] for _ in range(900)]
    lit = lambda h: [F.lit(x).cast("long") for x in h]
    row = spark.range(1)
    for cut in (0, 1, 7, 800):
        head, whole, suffix = lanes(seq[:cut], 3), lanes(seq, 3), lanes(seq[cut:], 3)
        q = P.quotient(lit(whole), F.lit(cut).cast("long"), lit(head), 3)
        c = P.compose((F.lit(cut).cast("long"), lit(head)), lit(suffix), 3)
        got = row.select(*[x.alias(f"q{k}") for k, x in enumerate(q)], *[x.alias(f"c{k}") for k, x in enumerate(c)]).first()
        assert list(got) == suffix + whole


# ---- chat formatting

ROWS = "conv_id long, turn long, role string, text string, formatted string, id long"


def formatted_text(df):
    parts = C.format_turns(C.canonical_turns(df)).orderBy("id", F.col("turn").asc_nulls_first(), "place", "role", "text").collect()
    out = collections.defaultdict(str)
    for r in parts:
        out[r.id] += r.formatted
    return out


def test_chat_round_trip_of_control_strings(spark):
    rnd = random.Random(5)
    pool = [*C.INSTRUCT.controls, "\\", "\\\\", "[", "<", "/", "ok", "\n", "é", "S>", "[IN", "<\\/s>"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", "</s>", "", None]),
             "".join(rnd.choices(pool, k=rnd.randint(0, 12))), "clash", 1) for c in range(60) for t in range(rnd.randint(1, 5))]
    rows += [(None, 0, "user", "x", "y", 1), (70, 0, None, None, None, None), (71, None, "assistant", "b" * 300_000, "", 2),
             (72, 1, "user", "b", "", 2), (72, 1, "user", "a", "", 2), (72, 1, "user", "a", "", 2)]
    df = spark.createDataFrame(rows, ROWS).select("conv_id", "turn", "role", "text")
    got = {r.id: r for r in C.read_back(C.format_turns(C.canonical_turns(df))).collect()}
    conv = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        conv[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(conv)
    texts = formatted_text(df)
    for c, turns in conv.items():
        turns = [x[1:] for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), len(texts[c]))
        marks = re.findall("|".join(map(re.escape, C.INSTRUCT.controls)), texts[c])
        assert len(marks) == sum(2 if role in C.INSTRUCT.roles else 3 for role, _ in turns)  # no text forges a mark
    assert C.read_back(C.format_turns(C.canonical_turns(df.limit(0)))).count() == 0


def test_layouts_select_their_mappings(spark):
    df = spark.read.json(spark.sparkContext.parallelize([
        '{"conv_id": 1, "prompt": "p", "response": "r"}',
        '{"conv_id": 2, "instruction": "do", "output": "done"}',
        '{"conv_id": 3, "instruction": "do", "input": "this", "output": "done"}',
        '{"conv_id": 4, "messages": [{"role": "user", "content": "m"}, {"role": "assistant", "content": null}]}',
        '{"conv_id": 5, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": "t"}]}',
        '{"conv_id": 6, "turn": 1, "role": "assistant", "text": "second"}',
        '{"conv_id": 6, "turn": 0, "role": "user", "text": "first"}',
        '{"conv_id": 7, "prompt": "no answer"}']))
    got = collections.defaultdict(list)
    for r in C.canonical_turns(df).orderBy("id", "turn", "place").collect():
        got[r.id].append((r.role, r.text))
    assert got == {1: [("user", "p"), ("assistant", "r")], 2: [("user", "do"), ("assistant", "done")],
                   3: [("user", "do\n\nthis"), ("assistant", "done")], 4: [("user", "m"), ("assistant", "")],
                   5: [("user", "h"), ("assistant", "g"), ("tool", "t")], 6: [("user", "first"), ("assistant", "second")]}
    named = {r.paths: (r.mapping, r.records) for r in C.layouts(df, [c for c in df.columns if c != "conv_id"]).collect()}
    assert named["prompt"] == (None, 1) and named["role\ntext\nturn"] == ("turn rows", 2)
    assert named["messages[].content\nmessages[].role"] == ("messages", 1)
    prints = [C.fingerprint(p) for m in C.MAPPINGS for p in m.layouts()]
    assert len(prints) == len(set(prints))


# ---- ranked search

def brute_search(docs, items, top=50):
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    bags = [(d, collections.Counter(token(t))) for d, t, *_ in docs]
    n_docs = sum(1 for _, b in bags if b)
    n_terms = sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for d, b in bags:
            n = sum(b.values())
            m = 100 - 50 + (50 * n * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
                    for t in set(token(text)) if b[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def ranked(docs, items, top=50):
    return sorted(((r.item_id, r["rank"], r.id, r.score) for r in L.search(docs, items, top).collect()), key=str)


@pytest.mark.parametrize("block_items", [256, 3])
def test_search_equals_brute_force(spark, monkeypatch, block_items):
    monkeypatch.setattr(L, "BLOCK_ITEMS", block_items)
    monkeypatch.setattr(L, "BATCH_CELLS", 2000)
    rnd = random.Random(6)
    words = ["the", "The", "ÉTÉ", "été", "a1", "1", "x_y", "日本", "of-of", *[f"w{k}" for k in range(40)]]
    text = lambda n: " ".join(rnd.choices(words, weights=range(len(words), 0, -1), k=n))
    docs = [(i, text(rnd.randint(0, 60)), "c", 1) for i in range(300)] + [(5, "the w3", "c", 1)] * 3
    docs += [(None, "été w1 w2", "c", 1), (400, None, "c", 1), (401, "", "c", 1), (402, "the " * 50_000, "c", 1), (403, "., !", "c", 1)]
    items = [(i, text(rnd.randint(1, 20))) for i in range(20)] + [(3, "w1 w2"), (3, "w1 w2"), (None, "w3 unheard"), (50, None), (51, ""), (52, "w9 " * 999)]
    d = spark.createDataFrame(docs, "doc_id long, text string, terms string, n long").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert ranked(d, q, 7) == brute_search(docs, items, 7)
    if block_items == 3:
        assert ranked(d.limit(0), q) == ranked(d, q.limit(0)) == []
        assert ranked(d.where("doc_id = 400"), q) == []


def test_sharing_dag_sums_every_item_once_and_saves_additions():
    rnd = random.Random(7)
    common = [rnd.sample(range(40), 12) for _ in range(4)]
    items = [set(rnd.choice(common) + rnd.sample(range(40, 200), rnd.randint(0, 9))) for _ in range(60)] + [set(), {5}, set(range(200, 900))]
    dag = L.mine(items)
    values = {t: rnd.randint(1, 1000) for t in set().union(*items)}
    terms = sorted(values)
    got = L.evaluate(dag, np.array([dag.leaf[t] for t in terms]), np.zeros(len(terms), np.int64), np.array([values[t] for t in terms]), 1)
    assert got[:, 0].tolist() == [sum(values[t] for t in s) for s in items]
    assert dag.additions < sum(max(0, len(s) - 1) for s in items) / 3
    assert L.mine([]).n_sets == 0 and L.mine([set()]).parts == [[]]
    shared = collections.Counter(itertools.chain.from_iterable(itertools.combinations(p, 2) for p in dag.parts))
    assert not shared or max(shared.values()) == 1  # no pair is left that two items hold


def test_queries_on_small_data_have_their_columns(spark):
    got = Q.QUERIES["op13_chat_format"](spark, "/root/testdata/sf0.001")
    probe = [r for r in got.collect() if r.conv_id == -1]
    assert len(probe) == 1 and probe[0].n_turns == 2 and probe[0].loss_chars == len(Q.PROBE)
