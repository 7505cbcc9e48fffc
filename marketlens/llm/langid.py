"""Language ID with bit-sliced Bloom filters over character n-grams.

Spark counts the n-grams of every labelled text. A language keeps the n-grams that
make up at least ``MIN_SHARE`` of its n-grams of that length, at most 1/MIN_SHARE of
them whatever the data size. All languages share one slot table: slot j holds a bit
mask of the languages that set it, so the AND of an n-gram's ``HASHES`` slots returns
all languages that (may) contain it. A text is decided by its per-language popcounts,
corrected for each language's own false-positive rate (fill ** HASHES): the corrected
count estimates how many of its n-grams the language truly contains.

Null texts and texts without a letter are ``und`` with score 0. A text none of whose
n-grams is known gets the commonest training language with score 0; without training
rows everything is ``und``. Ties go to the name that sorts first. Other columns pass
through; repeated rows are predicted alike; very long texts are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import mix

GRAMS = (3, 4)
MIN_SHARE = 4e-5
SLOT_BITS = 20
HASHES = 3
WORD_BITS = 62
PIECE_CHARS = 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 for anything that is not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with single gaps (1) between words, and each character's text number."""
    joined = "\n".join(t or "" for t in texts)
    code = _codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    size = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), size)[:len(code)]
    keep = code > 0
    keep[1:] |= code[:-1] > 0
    keep[0:1] = True
    code, doc = code[keep].astype(np.uint64), doc[keep]
    code[code == 0] = 1
    return code, doc


def gram_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hash, text number) of all n-grams of letters and word gaps; none spans two texts."""
    code, doc = _letters(texts)
    for n in GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ code[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        same = doc[:m] == doc[n - 1:]
        yield n, mix(h[same]), doc[:m][same]


def _runs(text: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of about PIECE_CHARS characters together."""
    row, held, size = 0, [], 0
    for i in range(len(text)):
        t = text[i].as_py()
        held.append(t)
        size += len(t or "")
        if size >= PIECE_CHARS:
            yield row, held
            row, held, size = i + 1, [], 0
    if held:
        yield row, held


def slots(h: np.ndarray) -> list[np.ndarray]:
    """Slot numbers of each hash, one array per hash function."""
    mask = np.uint64((1 << SLOT_BITS) - 1)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(HASHES)]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), dtype=object)
        text = batch.column("text")
        for name in sorted(set(lang)):
            mine = text.filter(pa.array(lang == name))
            parts: dict[int, list] = {n: [] for n in GRAMS}
            for _, texts in _runs(mine):
                for n, h, _ in gram_hashes(texts):
                    parts[n].append(np.unique(h, return_counts=True))
            for n, found in parts.items():
                if not found:
                    continue
                h = np.concatenate([f[0] for f in found])
                c = np.concatenate([f[1] for f in found])
                u, inv = np.unique(h, return_inverse=True)
                total = np.bincount(inv, c, len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(u)), pa.array(np.full(len(u), n, np.int32)),
                     pa.array(u.view(np.int64)), pa.array(total)], ["lang", "n", "gram", "c"])


class Filters:
    """The learned table: languages, slot masks (one column per WORD_BITS languages), false-positive rates."""

    def __init__(self, langs: list[str], prior: str, table: np.ndarray):
        self.langs, self.prior, self.table = langs, prior, table
        self.rate = np.array([(np.count_nonzero(table[:, i // WORD_BITS] >> np.uint64(i % WORD_BITS) & np.uint64(1))
                               / max(1, len(table))) ** HASHES for i in range(len(langs))])

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        out, score = [UNKNOWN] * len(text), np.zeros(len(text))
        names = np.array(self.langs, dtype=object)
        for row, texts in _runs(text):
            n = len(texts)
            code, doc = _letters(texts)
            has_letter = np.bincount(doc[code > 1], minlength=n) > 0
            total = np.zeros(n)
            hits = np.zeros((len(self.langs), n))
            for _, h, at in gram_hashes(texts) if self.langs else ():
                total += np.bincount(at, minlength=n)
                where = slots(h)
                for word in range(self.table.shape[1]):
                    column = self.table[:, word]
                    found = column[where[0]]
                    for s in where[1:]:
                        found = found & column[s]
                    for i in range(word * WORD_BITS, min(len(self.langs), (word + 1) * WORD_BITS)):
                        hits[i] += np.bincount(at[(found >> np.uint64(i % WORD_BITS) & np.uint64(1)) > 0], minlength=n)
            if not self.langs:
                continue
            true = np.clip((hits - self.rate[:, None] * total) / (1 - self.rate[:, None] + 1e-12), 0, None)
            best = true.argmax(axis=0)
            top, every = true.max(axis=0), true.sum(axis=0)
            for i in np.flatnonzero(has_letter):
                out[row + i] = names[best[i]] if top[i] > 0 else self.prior
                score[row + i] = top[i] / every[i] if top[i] > 0 else 0.0
        return out, np.clip(score, 0.0, 1.0)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Learn the filters from every row with a non-null language and text.

    What reaches the driver is the slot table: at most 2^SLOT_BITS rows per mask word.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count_batches, "lang string, n int, gram long, c long") \
        .groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).persist()
    try:
        totals = counts.groupBy("lang", "n").agg(F.sum("c").alias("total"))
        sums = [tuple(r) for r in totals.collect()]
        if not sums:
            return Filters([], UNKNOWN, np.zeros((1 << SLOT_BITS, 1), np.uint64))
        langs = sorted({r[0] for r in sums})
        prior = max(langs, key=lambda x: sum(r[2] for r in sums if r[0] == x))
        least = F.create_map(*[x for r in sums for x in (F.lit(f"{r[0]}|{r[1]}"), F.lit(r[2] * MIN_SHARE))])
        number = F.create_map(*[x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))])
        kept = counts.where(F.col("c") >= F.try_element_at(least, F.concat_ws("|", "lang", "n")))
        mask = F.lit((1 << SLOT_BITS) - 1)
        step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1)).bitwiseAND(mask)
        slot = F.explode(F.array(*[(F.col("gram").bitwiseAND(mask) + step * k).bitwiseAND(mask).cast("int") for k in range(HASHES)]))
        table = kept.select(slot.alias("slot"), F.try_element_at(number, F.col("lang")).alias("i")) \
            .select("slot", F.floor(F.col("i") / WORD_BITS).cast("int").alias("word"),
                    F.expr(f"shiftleft(1L, i % {WORD_BITS})").alias("bit")) \
            .groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toPandas()
    finally:
        counts.unpersist()
    masks = np.zeros((1 << SLOT_BITS, (len(langs) - 1) // WORD_BITS + 1), np.uint64)
    masks[table["slot"].to_numpy(), table["word"].to_numpy()] = table["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters(langs, prior, masks)


def identify(docs: DataFrame, filters: Filters, text_col: str = "text",
             lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its share of the corrected counts."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded: 2^SLOT_BITS masks

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        lang, score = shared.value.predict(text)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    return docs.withColumn("__lang", predict(F.col(text_col))) \
        .withColumns({lang_out: F.col("__lang.lang"), score_out: F.col("__lang.score")}).drop("__lang")
