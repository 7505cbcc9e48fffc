"""Best-fit packing of tokenised documents with large-item matching.

Documents become ids of a given tokenizer plus an end id. Only longer ones are cut,
into pieces of the capacity. Piece lengths (never ids) are dealt to shards of about
``SHARD_ROWS`` by hash; each shard is packed on its own, so a run wastes at most a few
open sequences per shard, at every size:

* Full pieces are sequences by themselves.
* Of the pieces above a third of the capacity at most two share a sequence: from the
  longest down, each is matched with the longest that still fits beside it.
* The rest, longest first, goes to the open sequence with the smallest gap that holds it.

Null text counts as empty and packs as its end id alone. Repeated rows are packed each
on their own. Null ids pass through. Empty tables give empty results; other columns
are ignored; very long texts are cut, never truncated.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textbatch import Remembered

CAPACITY = 4096
SHARD_ROWS = 50_000
CACHE_WORDS, CACHE_PARTS = 250_000, 250_000
LATIN_END = 0x250
# Latin letters (checked further by isalpha), then ASCII punctuation without the apostrophe.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u024F]+)([!-&(-/:-@\[-`{-~]*)")
SLICE = 1 << 14
_CACHES: dict[str, "WordCache"] = {}


class WordCache:
    """Ids of whitespace-separated words by the tokenizers library, remembered per word.

    The tokenizer must never look across ASCII white space (its pre-tokenizer drops
    it); then the ids of a text are the ids of its words, one after the other. Where
    ``plain`` holds, a word of Latin letters and trailing ASCII punctuation is known to
    pre-tokenize into those two parts, lower-cased, so the library's model gets them
    directly; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_file(path)
        self.known = Remembered(CACHE_WORDS)
        self.parts = Remembered(CACHE_PARTS)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.surface = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, LATIN_END) if chr(c).isalpha()}
        self.plain = all(self._whole([w])[0] == b"".join(self._part(x) for x in _PLAIN.fullmatch(w).groups() if x)
                         for w in ("Thé", "ÀÉÎÕÜßñ***", "don", "x,.;", "Œuvre_", "ſtÿ)", "ŁÓDŹ!!", "ǅo|", "llve-"))

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        low = part.lower()
        return array("I", [t.id for t in self.library.model.tokenize(low if low.isascii() else low.translate(self.surface))]).tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        found = [_PLAIN.fullmatch(w) if self.plain else None for w in words]
        found = [m and (m[1].lower(), m[2]) if m and m[1].isalpha() and (m[1].isascii() or m[1].lower().isalpha()) else None for m in found]
        parts = [x for m in found if m for x in m if x]
        known = dict(zip(parts, self.parts.get_all(parts, lambda new: [self._part(x) for x in new]), strict=True))
        rest = [w for w, m in zip(words, found, strict=True) if m is None]
        whole = dict(zip(rest, self._whole(rest), strict=True))
        return [whole[w] if m is None else known[m[0]] + known.get(m[1], b"") for w, m in zip(words, found, strict=True)]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the text."""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        # A slice at a time, so that one long text fits the cache.
        return b"".join([x for a in range(0, len(words), SLICE)
                         for x in self.known.get_all(words[a:a + SLICE], self._learn)])


def encoder(path: str) -> Callable[[str], bytes]:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path].encode


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its ids) of one document's ids."""
    n, view = len(ids) // 4, memoryview(ids)
    return [(k, a, min(capacity, n - a), zlib.crc32(view[4 * a:4 * (a + capacity)]))
            for k, a in enumerate(range(0, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows = [cut(encode(t.as_py() or "") + end, capacity) for t in batch.column("text")]
            at = np.repeat(np.arange(batch.num_rows), [len(r) for r in rows])
            flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), pa.array(flat[:, 0].astype(np.int32)),
                 pa.array(flat[:, 1]), pa.array(flat[:, 2]), pa.array(flat[:, 3])],
                ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(work, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of every piece."""
    n = len(lengths)
    seq, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit g is set while some open sequence has a gap of g
    count = 0

    def leave(s: int, gap: int) -> None:
        nonlocal filled
        if gap:
            gaps[gap].append(s)
            filled |= 1 << gap

    large = int(np.searchsorted(-size, -(capacity / 3), side="left"))
    rising = (size[:large][::-1]).tolist()  # ascending lengths of the unmatched large pieces
    item = order[:large][::-1].tolist()
    while rising:
        long_, i = rising.pop(), item.pop()
        seq[i] = count
        gap = capacity - long_
        k = bisect.bisect_right(rising, gap) - 1
        if k >= 0:
            mate = rising.pop(k)
            j = item.pop(k)
            seq[j], offset[j] = count, long_
            gap -= mate
        leave(count, gap)
        count += 1
    for i, need in zip(order[large:].tolist(), size[large:].tolist(), strict=True):
        fits = filled >> need
        if fits:
            gap = need + (fits & -fits).bit_length() - 1
            s = gaps[gap].pop()
            if not gaps[gap]:
                filled ^= 1 << gap
        else:
            s, gap = count, capacity
            count += 1
        seq[i], offset[i] = s, capacity - gap
        leave(s, gap - need)
    return seq, offset


def pack(table: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pieces`` output with sequence_id and offset. The piece table (lengths only) is written once."""
    table = materialize(table, "pieces")
    shards = max(1, math.ceil(table.count() / shard_rows))
    cols = table.columns

    def work(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([(c, "ascending") for c in ("length", "id", "piece", "ids_crc32")])
        seq, offset = best_fit(shard["length"].to_numpy(), capacity)
        numbers = shard["shard"].to_numpy().astype(np.int64) * (1 << 32) + seq
        return shard.select(cols).append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", sequence_id long, offset long"
    shard = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shards)).cast("int")
    return table.withColumn("shard", shard).groupBy("shard").applyInArrow(work, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    packed = pack(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), capacity)
    return packed.withColumnRenamed("id", id_col)
