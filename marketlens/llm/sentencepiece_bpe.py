"""Encoding and decoding with a merge-type SentencePiece vocabulary.

Encoding keeps an agenda of adjacent symbol pairs ordered by the merged piece's score
(ties: leftmost first); the best pair is merged, its new neighbours enter the agenda,
until no adjacent pair is a piece. Characters outside the vocabulary become byte pieces.
Segments of up to ``ROW_CHARS`` known characters have their agendas in the rows of an array: every
turn merges the best pair of each row.

A merge never crosses two adjacent characters that stand together in no piece, so a
text is cut there first: before white space marks, at newlines and between letters and
other characters, each only where the vocabulary proves it. The cuts of a group of texts
come from one table of character classes; Arrow's dictionary encoding leaves every
segment of the group once, and the results return to the texts by index. Segments recur
between groups, so they are remembered per worker (bounded). Every segment that is
computed is checked, in batches, against the sentencepiece library; a difference raises.

Null and empty texts have no ids and decode to the empty string. Repeated rows encode
alike; other columns pass through; very long texts are encoded whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Remembered

SPACE = "▁"
CACHE_SEGMENTS = 200_000
GROUP_CHARS = 1 << 20
ROW_CHARS = 48
_NO_PAIR = np.int32(2**31 - 1)
ANY, LETTER, MARK, NEWLINE = range(4)
BREAK = re.compile(f"[^ {SPACE}][ {SPACE}]")
RESULT = pa.struct([("n", pa.int64()), ("ids", pa.string()), ("surface", pa.string())])
_MODELS: dict[str, "Bpe"] = {}


class Bpe:
    """A BPE SentencePiece model with identity normalisation, space prefix and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  b\tc　ééﬁ "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models with identity normalisation and a space prefix are supported")
        n = sp.get_piece_size()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.piece = {i: p for p, i in self.ids.items()}
        # Equal scores share a rank, so that the leftmost pair goes first among them.
        score = {p: sp.get_score(i) for p, i in self.ids.items()}
        order = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in score.items()}
        self._number_symbols()
        self.classes = self._classes()
        self.known = Remembered(CACHE_SEGMENTS)

    def _classes(self) -> np.ndarray | None:
        """Class of every character: no piece spans two classes, but marks lead pieces. None: no cut is proven."""
        inner = [p.lstrip(SPACE) for p in self.ids]
        if any(SPACE in p for p in inner):
            return None
        pairs = {p[i:i + 2] for p in inner for i in range(len(p) - 1)}
        chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        letters = {c for c in re.findall(r"[^\W\d_]", chars) if c.isalpha()}
        table = np.full(0x110000, ANY, np.uint8)
        if not any((a in letters) != (b in letters) for a, b in pairs):
            table[[ord(c) for c in letters]] = LETTER
        if not any("\n" in p and len(p) > 1 for p in self.ids):
            table[ord("\n")] = NEWLINE
        table[[ord(" "), ord(SPACE)]] = MARK
        return table

    def _number_symbols(self) -> None:
        """Numbers of the pieces (0 for whatever else), and by two of them the rank and number of the piece they make."""
        names = ["", *self.ids]
        number = {p: i for i, p in enumerate(names)}
        self.symbol_ids = np.array([-1, *self.ids.values()], np.int64)
        self.id_texts = pa.array(["", *map(str, self.ids.values())])
        self.surfaces = pa.array([p.replace(SPACE, " ") for p in names])
        self.char_symbols = np.zeros(0x110000, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.char_symbols[ord(p)] = i
        # A piece with a character that is no piece is left to ``merge``, with all segments that hold such characters.
        pairs = sorted((number[p[:k]] * len(names) + number[p[k:]], self.rank[p], i) for p, i in number.items()
                       for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pair_keys, ranks, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.pair_ranks, self.pair_made = ranks.astype(np.int32), made.astype(np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the piece that each two symbols make; _NO_PAIR where they make none."""
        key = left.astype(np.int64) * len(self.symbol_ids) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NO_PAIR), self.pair_made[at]

    def _merge_rows(self, sym: np.ndarray) -> np.ndarray:
        """Merged symbols of segments, one a row, padded with 0 (the last column at least); -1 where a symbol went into the one before."""
        n, width = sym.shape
        rank, made = self._pairs(sym[:, :-1], sym[:, 1:])
        rank, made = (np.hstack([x, np.full((n, 1), _NO_PAIR)]).ravel() for x in (rank, made))
        sym = sym.ravel()
        nxt = np.tile(np.arange(1, width + 1), n)
        prv = np.tile(np.arange(-1, width - 1), n)
        first = np.arange(n) * width
        while len(first):
            best = rank.reshape(n, width)[first // width].argmin(axis=1)
            i = first + best
            some = rank[i] != _NO_PAIR
            first, i, best = first[some], i[some], best[some]
            j = first + nxt[i]
            k = nxt[j]
            sym[i] = made[i]
            sym[j] = -1
            rank[j] = _NO_PAIR
            nxt[i] = k
            prv[first + k] = best
            rank[i], made[i] = self._pairs(sym[i], sym[first + k])
            h = prv[i]
            led = h >= 0
            h = first[led] + h[led]
            rank[h], made[h] = self._pairs(sym[h], sym[i[led]])
        return sym.reshape(n, width)

    def _merge_all(self, segments: list[str]) -> tuple[list[list[int]], list[str], list[str]]:
        """Ids of each segment, the same joined by commas, and their surface."""
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        start = np.cumsum(size) - size
        symbols = self.char_symbols[chars]
        plain = (np.minimum.reduceat(symbols, start) > 0) & (size <= ROW_CHARS)
        ids: list[list[int]] = [[]] * len(segments)
        joined, surface = [""] * len(segments), [""] * len(segments)
        for x in np.flatnonzero(~plain).tolist():
            ids[x] = self.merge(segments[x])
            joined[x], surface[x] = ",".join(map(str, ids[x])), self.surface(ids[x])
        rows = np.flatnonzero(plain)
        rows = rows[np.argsort(size[rows], kind="stable")]
        for a in range(0, len(rows), 8192):
            some = rows[a:a + 8192]
            place = np.arange(size[some[-1]] + 1)
            inside = place < size[some, None]
            sym = np.zeros(inside.shape, np.int32)
            sym[inside] = symbols[(start[some, None] + place)[inside]]
            sym = self._merge_rows(sym)
            left = sym > 0
            flat, ends = sym[left], np.cumsum(np.concatenate(([0], left.sum(axis=1))))
            lists = pa.array(ends, pa.int32())
            own, bounds = self.symbol_ids[flat].tolist(), ends.tolist()
            texts, faces = (pc.binary_join(pa.ListArray.from_arrays(lists, names.take(pa.array(flat))), sep).to_pylist()
                            for names, sep in ((self.id_texts, ","), (self.surfaces, "")))
            for x, b, e, t, f in zip(some.tolist(), bounds, bounds[1:], texts, faces, strict=False):
                ids[x], joined[x], surface[x] = own[b:e], t, f
        return ids, joined, surface

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by the score-ordered agenda."""
        n = len(segment)
        if n == 1 and segment in self.ids:
            return [self.ids[segment]]
        sym: list[str] = list(segment)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        rank = self.rank.get
        # An entry is the rank of a pair and its place in one number; it is stale once the pair there has another rank.
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank(segment[i:i + 2])) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            e = pop(agenda)
            i = e & 0xFFFFFFFF
            j = nxt[i]
            if j >= n or not sym[i]:
                continue
            pair = sym[i] + sym[j]
            if rank(pair) != e >> 32:
                continue
            sym[i], sym[j] = pair, ""
            j = nxt[i] = nxt[j]
            if j < n:
                prv[j] = i
                r = rank(pair + sym[j])
                if r is not None:
                    push(agenda, r << 32 | i)
            h = prv[i]
            if h >= 0:
                r = rank(sym[h] + pair)
                if r is not None:
                    push(agenda, r << 32 | h)
        out = []
        for s in sym:
            if s:
                i = self.ids.get(s)
                if i is None:
                    out += [self.bytes[b] for b in s.encode()]
                else:
                    out.append(i)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids without the space prefix."""
        return self.surface(ids).removeprefix(" ")

    def surface(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.piece[i] for i in ids]).replace(SPACE, " ")
        out = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is None:
                out += self.piece[i].encode()
            else:
                out.append(b)
        return out.decode("utf-8", "replace").replace(SPACE, " ")

    def _learn(self, segments: list[str]) -> list[tuple[int, str, str]]:
        segments = [s.replace(" ", SPACE) for s in segments]
        found, joined, surface = self._merge_all(segments)
        self._check(segments, found)
        return list(zip(map(len, found), joined, surface, strict=True))

    def _check(self, segments: list[str], found: list[list[int]]) -> None:
        """Compare with the library, which puts a space mark before every text: only segments that carry one."""
        own = [(s[1:].replace(SPACE, " "), ids) for s, ids in zip(segments, found, strict=True) if s[0] == SPACE and len(s) > 1]
        bare = [(s, ids) for s, ids in zip(segments, found, strict=True) if s[0] != SPACE]
        if own:
            for (t, ids), theirs in zip(own, self.library.encode([t for t, _ in own], num_threads=1), strict=True):
                if ids != theirs:
                    raise ValueError(f"encoding of {t!r} differs from the library")
        if bare:
            # A newline stands alone, so it separates the mark from the segment.
            gap = self.bytes[10]
            for (t, ids), theirs in zip(bare, self.library.encode(["\n" + t for t, _ in bare], num_threads=1), strict=True):
                if theirs[theirs.index(gap) + 1:] != ids:
                    raise ValueError(f"encoding of {t!r} differs from the library")

    def _segments(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Segments of not empty texts in order, and the number of the first segment of each text."""
        data = "".join(texts)
        chars = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0, *map(len, texts)])
        cut = np.zeros(len(chars) + 1, bool)
        if self.classes is not None:
            c = self.classes[chars]
            # A class ends where another begins, but marks go with what follows; newlines stand alone.
            cut[1:-1] = (c[1:] != c[:-1]) & ((c[:-1] != MARK) | (c[1:] == NEWLINE)) | (c[1:] == NEWLINE)
        cut[starts] = True
        at = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), out=at[1:])
        bounds = np.flatnonzero(cut)
        parts = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(at[bounds]), pa.py_buffer(data.encode())])
        return parts, np.searchsorted(bounds, starts)

    def _results(self, texts: list[str]) -> pa.StructArray:
        """Number of ids, ids joined by commas and surface of texts that begin with their space mark."""
        if not texts:
            return pa.array([], RESULT)
        parts, first = self._segments(texts)
        coded = parts.dictionary_encode()
        n, ids, surface = zip(*self.known.get_all(coded.dictionary.to_pylist(), self._learn), strict=True)
        lists = pa.array(first, pa.int32())
        joined = [pc.binary_join(pa.ListArray.from_arrays(lists, pa.array(x, pa.string()).take(coded.indices)), sep)
                  for x, sep in ((ids, ","), (surface, ""))]
        counts = np.add.reduceat(np.array(n, np.int64)[coded.indices.to_numpy()], first[:-1])
        return pa.StructArray.from_arrays([pa.array(counts), *joined], fields=list(RESULT))

    def _cuts(self, text: str) -> Iterator[str]:
        """A long text in pieces of about ``GROUP_CHARS``, each begun by a mark after another character."""
        while self.classes is not None and (m := BREAK.search(text, GROUP_CHARS)):
            yield text[:m.end() - 1]
            text = text[m.end() - 1:]
        yield text

    def round_trip(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[str]]:
        """Number of ids, ids joined by commas and decoded text of each text, groups of about ``GROUP_CHARS`` at a time."""
        n, ids, surface = np.zeros(len(texts), np.int64), [""] * len(texts), [""] * len(texts)
        group: list[int] = []
        size = 0

        def end_group() -> None:
            found = self._results([" " + texts[k] for k in group]).flatten()  # type: ignore[operator]
            n[group] = found[0].to_numpy()
            for k, i, s in zip(group, found[1].to_pylist(), found[2].to_pylist(), strict=True):
                ids[k], surface[k] = i, s

        for k, t in enumerate(texts):
            if t and len(t) > GROUP_CHARS:
                found = [self._results([x]).to_pylist()[0] for x in self._cuts(" " + t)]
                n[k] = sum(x["n"] for x in found)
                ids[k], surface[k] = ",".join(x["ids"] for x in found), "".join(x["surface"] for x in found)
            elif t:
                group.append(k)
                size += len(t)
                if size > GROUP_CHARS:
                    end_group()
                    group, size = [], 0
        end_group()
        return n, ids, [s.removeprefix(" ") for s in surface]

    def encode(self, text: str) -> list[int]:
        ids = self.round_trip([text])[1][0]
        return [int(i) for i in ids.split(",")] if ids else []


def model(path: str) -> Bpe:
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the array of ids of every whole text."""
    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        m = model(model_path)
        return pa.array([m.encode(t.as_py() or "") for t in text], pa.list_(pa.int32()))

    return docs.withColumn(out, encode(F.col(text_col)))


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of every array of ids; null ids give the empty string."""
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        m = model(model_path)
        return pa.array([m.decode(i.as_py() or []) for i in ids], pa.string())

    return df.withColumn(out, decode(F.col(ids_col)))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_text (decimal ids joined by commas), decoded."""
    @F.arrow_udf("struct<n_tokens: long, ids_text: binary, decoded: string>")
    def work(text: pa.Array) -> pa.Array:
        m = model(model_path)
        n, ids, decoded = m.round_trip(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(n), pa.array(ids, pa.string()).cast(pa.binary()), pa.array(decoded, pa.string())],
                                          ["n_tokens", "ids_text", "decoded"])

    return docs.select(F.col(id_col), work(F.col(text_col)).alias("e")).select(id_col, "e.n_tokens", "e.ids_text", "e.decoded")
