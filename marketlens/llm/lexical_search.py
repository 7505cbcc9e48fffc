"""Ranked lexical search of many queries at once, by common-subexpression evaluation.

A document's score for an item is a sum over the item's terms, so items that share terms share partial sums.

* Mining: terms that occur in the same items of a block form one set; of what is left, the pair of sets that most
  items hold together becomes a new set, again and again, until no pair is held twice. The sets form a DAG whose
  inner nodes add two others; an item is the sum of its last few.
* Evaluation: per batch of documents every set's accumulator (one 64-bit sum per document) is materialised
  once, level by level, and all items that hold the set read it.
* Statistics (documents with a term, terms in all, document frequencies) are counted over the whole table before.

Documents are read once: a pass keeps per document its length and the counts of item terms (a fixed-size bit
table of term hashes lets few others through). Items are taken in blocks, bounded in rows and in term pairs;
each block scores all documents, every task keeps its best ``top`` per item, and a rank over these rows decides.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased, and are known
by 64-bit hashes. Null and empty texts have no term: such a document counts nowhere, such an item has no
result. Equal scores go by ascending document id, null ids last; rows that repeat an id are ranked as documents of
their own. Rows that repeat item id and text are one item; an id with several texts is ranked for each. Extra
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import materialize

FILTER_BITS = 1 << 24
BLOCK_ITEMS = 256
BLOCK_PAIRS = 1 << 21
BATCH_CELLS = 1 << 22
SCALE = 1_000_000_000
_POSTINGS = "id long, n long, terms array<long>, counts array<int>"


def term_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash, count) of the distinct terms of each text, and each text's number of terms."""
    h, _, _, doc = tb.tokens(data, offs, whitespace=False)
    n = np.bincount(doc, minlength=len(offs) - 1)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first].view(np.int64), np.diff(np.append(first, len(h))), n


def _lists(values: np.ndarray, owner: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    ends = np.searchsorted(owner, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def postings(texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(id, n, terms, counts) per row of ``texts`` (id, text): its length and the counts of its terms.

    With ``wanted`` (column term), only terms that hit a table of FILTER_BITS bits (2 MB) made from it: all the wanted
    and few others.
    """
    table = None
    if wanted is not None:
        slot = F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1))
        words = wanted.groupBy(F.shiftright(slot, 5).cast("int").alias("word")) \
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int"))).alias("mask")).toArrow()
        bits = np.zeros(FILTER_BITS // 32, np.uint32)
        bits[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)
        table = texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else np.frombuffer(table.value, np.uint32)
        for batch in batches:
            for row, data, offs in tb.pieces(batch.column("text")):
                doc, term, count, n = term_counts(data, offs)
                if bits is not None:
                    slot = term & (FILTER_BITS - 1)
                    hit = bits[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1) > 0
                    doc, term, count = doc[hit], term[hit], count[hit]
                rows = len(offs) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, rows), pa.array(n, pa.int64()), _lists(term, doc, rows, pa.int64()),
                     _lists(count.astype(np.int32), doc, rows, pa.int32())], ["id", "n", "terms", "counts"])

    return texts.mapInArrow(work, _POSTINGS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class SharingDag:
    """Sums of terms shared among items.

    ``leaf``: the set (by number) of every term. ``levels``: per level the numbers (first, last + 1) of its sets and the
    pairs of sets that they add. ``parts``: the sets whose sum is the item's, per item.
    """

    n_leaves: int
    leaf: dict[int, int]
    levels: list[tuple[int, int, np.ndarray, np.ndarray]]
    parts: list[list[int]]

    @property
    def n_sets(self) -> int:
        return self.levels[-1][1] if self.levels else self.n_leaves

    @property
    def additions(self) -> int:
        return self.n_sets - self.n_leaves + sum(max(0, len(p) - 1) for p in self.parts)


def mine(items: list[set[int]]) -> SharingDag:
    """The sharing DAG of the items' term sets: terms of equal signature first, then the commonest pair of sets again and again."""
    holders: dict[int, list[int]] = defaultdict(list)
    for i, terms in enumerate(items):
        for t in terms:
            holders[t].append(i)
    number: dict[tuple[int, ...], int] = {}
    leaf = {t: number.setdefault(tuple(holders[t]), len(number)) for t in sorted(holders)}
    held: list[set[int]] = [set() for _ in items]
    for signature, k in number.items():
        for i in signature:
            held[i].add(k)
    with_pair: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, sets in enumerate(held):
        for pair in combinations(sorted(sets), 2):
            with_pair[pair].add(i)
    queue = [(-len(v), p) for p, v in with_pair.items() if len(v) > 1]
    heapify(queue)
    made: list[tuple[int, int]] = []
    n_leaves = len(number)
    while queue:
        count, (a, b) = heappop(queue)
        owners = with_pair[a, b]
        if len(owners) != -count:
            if len(owners) > 1:
                heappush(queue, (-len(owners), (a, b)))
            continue
        new = n_leaves + len(made)
        made.append((a, b))
        touched = set()
        for i in list(owners):
            held[i] -= {a, b}
            for x in held[i]:
                for old in (a, b):
                    with_pair[min(old, x), max(old, x)].discard(i)
                with_pair[x, new].add(i)
                touched.add((x, new))
            held[i].add(new)
        owners.clear()
        for p in touched:
            if len(with_pair[p]) > 1:
                heappush(queue, (-len(with_pair[p]), p))
    # Number the sets by level, so that a level is evaluated at once.
    level = [0] * (n_leaves + len(made))
    for k, (a, b) in enumerate(made, n_leaves):
        level[k] = 1 + max(level[a], level[b])
    order = sorted(range(len(level)), key=lambda k: (level[k], k))
    place = {k: p for p, k in enumerate(order)}
    levels, at = [], n_leaves
    while at < len(order):
        stop = at
        while stop < len(order) and level[order[stop]] == level[order[at]]:
            stop += 1
        pairs = [made[order[p] - n_leaves] for p in range(at, stop)]
        levels.append((at, stop, np.array([place[a] for a, _ in pairs]), np.array([place[b] for _, b in pairs])))
        at = stop
    return SharingDag(n_leaves, {t: place[k] for t, k in leaf.items()}, levels, [sorted(place[k] for k in s) for s in held])


class Best:
    """The ``top`` best (score, document) per item so far: higher scores, then smaller ids, null ids last."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.score = [np.zeros(0, np.int64)] * n_items
        self.id = [np.zeros(0, np.int64)] * n_items
        self.known = [np.zeros(0, bool)] * n_items
        self.least = np.zeros(n_items, np.int64)  # a score must exceed 0, and reach the last of a full list

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """``scores``: items x documents."""
        hit = (scores > 0) & (scores >= self.least[:, None])
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            at = np.flatnonzero(hit[i])
            s = np.concatenate((self.score[i], scores[i, at]))
            d = np.concatenate((self.id[i], ids[at]))
            k = np.concatenate((self.known[i], known[at]))
            if len(s) > self.top:
                keep = np.lexsort((d, ~k, -s))[:self.top]
                s, d, k = s[keep], d[keep], k[keep]
                self.least[i] = s[-1]
            self.score[i], self.id[i], self.known[i] = s, d, k


def evaluate(dag: SharingDag, leaf_of: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """Scores (items x documents): ``value`` adds to leaf set ``leaf_of`` of document ``doc``."""
    acc = np.zeros((dag.n_sets, docs), np.int64)
    np.add.at(acc.reshape(-1), leaf_of * docs + doc, value)
    for a, b, left, right in dag.levels:
        np.add(acc[left], acc[right], out=acc[a:b])
    out = np.zeros((len(dag.parts), docs), np.int64)
    for i, parts in enumerate(dag.parts):
        if parts:
            out[i] = acc[parts].sum(axis=0)
    return out


def _search_block(table: DataFrame, items: list[tuple[int, int, set[int]]], df: dict[int, int], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """Best documents per task for a block of items (block-wide number, item id, terms)."""
    weights = {t: weight(n_docs, c) for t, c in df.items()}
    useful = [{t for t in terms if weights.get(t, 0) > 0} for _, _, terms in items]
    dag = mine(useful)
    terms = np.array(sorted(dag.leaf), np.int64)
    leaf = np.array([dag.leaf[t] for t in terms.tolist()], np.int64)
    w = np.array([weights[t] for t in terms.tolist()], np.int64)
    number = np.array([k for k, _, _ in items], np.int64)
    item_ids = [i for _, i, _ in items]
    shared = table.sparkSession.sparkContext.broadcast((dag, terms, leaf, w))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, terms, leaf, w = shared.value
        best = Best(len(item_ids), top)
        size = max(16, BATCH_CELLS // max(1, dag.n_sets + len(item_ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                n = part.column("n").to_numpy(zero_copy_only=False)
                m = 50 + (50 * n * n_docs) // max(1, n_terms)
                lists = part.column("terms")
                doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
                term = lists.flatten().to_numpy()
                tf = part.column("counts").flatten().to_numpy().astype(np.int64)
                place = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
                hit = terms[place] == term if len(terms) else np.zeros(len(term), bool)
                doc, place, tf = doc[hit], place[hit], tf[hit]
                value = w[place] * ((SCALE * tf) // (1000 * tf + 20 * m[doc]))
                ids = part.column("id")
                best.add(evaluate(dag, leaf[place], doc, value, len(n)), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))
        rows = [len(s) for s in best.score]
        which = np.repeat(np.arange(len(rows)), rows)
        ids = np.concatenate([np.zeros(0, np.int64), *best.id])
        known = np.concatenate([np.zeros(0, bool), *best.known])
        yield pa.RecordBatch.from_arrays(
            [pa.array(number[which], pa.int64()), pa.array([item_ids[i] for i in which.tolist()], pa.int64()),
             pa.array(ids, pa.int64(), mask=~known), pa.array(np.concatenate([np.zeros(0, np.int64), *best.score]), pa.int64())],
            ["item", "item_id", "id", "score"])

    return table.mapInArrow(work, "item long, item_id long, id long, score long")


def item_blocks(items: DataFrame) -> Iterator[tuple[int, int]]:
    """Ranges [first, last] of item numbers, each within BLOCK_ITEMS rows and BLOCK_PAIRS term pairs (or one item)."""
    first, last, rows, pairs = None, None, 0, 0
    for r in items.select("item", F.size("terms").cast("long").alias("k")).orderBy("item").toLocalIterator():
        own = r["k"] * (r["k"] - 1) // 2
        if rows and (rows >= BLOCK_ITEMS or pairs + own > BLOCK_PAIRS):
            yield first, last
            rows, pairs = 0, 0
        if not rows:
            first = r["item"]
        last, rows, pairs = r["item"], rows + 1, pairs + own
    if rows:
        yield first, last


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``top`` best documents of every item: item_id, rank, id, score."""
    spark: SparkSession = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).distinct()
    asked = materialize(postings(asked).where("n > 0"), "search-items")
    numbered = materialize(asked.orderBy(F.col("id").asc_nulls_last()).select(F.monotonically_increasing_id().alias("item"), "id", "terms"),
                           "search-items")
    wanted = numbered.select(F.explode("terms").alias("term")).distinct()
    table = materialize(postings(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), wanted), "search-postings")
    total = table.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    frequency = materialize(table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
                            .join(wanted, "term", "left_semi"), "search-frequencies")
    found = spark.createDataFrame([], "item long, item_id long, id long, score long")
    for first, last in item_blocks(numbered):
        block = numbered.where(F.col("item").between(first, last))
        rows = [(r["item"], r["id"], set(r["terms"])) for r in block.orderBy("item").collect()]
        df = frequency.join(block.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        found = found.unionByName(_search_block(table, rows, {r["term"]: r["df"] for r in df.collect()}, total["n"], total["l"], top))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "id", "score")
