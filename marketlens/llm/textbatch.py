"""Vectorised text primitives over Arrow string arrays (numpy, per batch).

Texts are cut into pieces of about ``PIECE_BYTES`` so that the numpy temporaries of
a batch stay small; a single longer text forms its own piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Letters, digits and every byte of a multi-byte character continue a word.
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[ord("0"):ord("9") + 1] = True
_ALNUM[ord("A"):ord("Z") + 1] = True
_ALNUM[ord("a"):ord("z") + 1] = True
_ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_POSITION = (np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(arr: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive row ranges; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    n = len(arr)
    if n == 0:
        return
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + n + 1]
    body = arr.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, data[offs[row]:offs[stop]], offs[row:stop + 1] - offs[row]
        row = stop


def word_bounds(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of ``inside`` bytes; runs stop at text ends."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """One 64-bit hash per run: byte values weighted by random odd numbers per position."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    first = np.zeros(len(data), dtype=np.int64)
    first[starts] = np.diff(starts, prepend=0)
    pos = np.arange(len(data)) - np.cumsum(first)
    contrib = (data.astype(np.uint64) + np.uint64(1)) * _POSITION[pos & 255]
    contrib[~inside] = 0
    sums = np.add.reduceat(contrib, starts)
    return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def tokens(data: np.ndarray, offs: np.ndarray, whitespace: bool, lower: bool = True):
    """(hash, start, end, text number) of each word: whitespace-separated, or runs of letters and digits."""
    if lower:
        data = _LOWER[data]
    inside = ~_WS[data] if whitespace else _ALNUM[data]
    s, e, doc = word_bounds(data, offs, inside)
    return run_hashes(data, s, e, inside), s, e, doc


class Remembered:
    """Results per string, at most about 2 x ``limit`` of them: two generations, the older one goes first."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict = {}
        self.old: dict = {}

    def get_all(self, keys: list[str], learn) -> list:
        """Results of ``keys`` in order; ``learn(list)`` computes the unknown ones together."""
        missing = set(keys).difference(self.new)
        if missing:
            if self.new and len(self.new) + len(missing) > self.limit:
                self.old, self.new = self.new, {}
                missing = set(keys)
            new, old = self.new, self.old
            new.update({k: old[k] for k in missing if k in old})
            rest = [k for k in missing if k not in new]
            if rest:
                new.update(zip(rest, learn(rest), strict=True))
        new = self.new
        return [new[k] for k in keys]
