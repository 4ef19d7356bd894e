"""Words, lines and hashes of many texts at once, as numpy arrays over UTF-8 bytes.

``pieces`` cuts Arrow batches into slices of a few MB, so that the work arrays of
a task stay small whatever the batch holds; a single longer text is one slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
SMALL = 1 << 19  # for work with many values a byte
BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8: its powers have the longest period
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of letters and digits, once lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = False
ALNUM[0x3A:0x61] = False
ALNUM[0x7B:0x80] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Piece:
    """Some texts end to end: ``data`` (bytes) and ``bounds`` (where each begins, and the end)."""

    def __init__(self, column: pa.Array, lower: bool):
        column = pc.fill_null(column, "")
        if column.type != pa.large_string():
            column = column.cast(pa.large_string())
        _, offsets, values = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values else np.zeros(0, np.uint8)
        self.raw = raw
        self.data = LOWER[raw] if lower else raw
        self.bounds = bounds - bounds[0]
        self.n = len(column)

    def words(self, kind: np.ndarray) -> None:
        """Sets ``start``, ``end`` (bytes), ``doc`` and ``first`` (a text's first word, and the end)."""
        inside = kind[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.bounds] = True
        begins = inside & edge[:-1]
        begins[1:] |= inside[1:] & ~inside[:-1]
        ends = inside & edge[1:]
        ends[:-1] |= inside[:-1] & ~inside[1:]
        self.inside = inside
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def prefix(self) -> None:
        """Prepares ``span``."""
        n = len(self.data)
        terms = powers(BASE, n)
        terms *= _BYTES[self.data]
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self._sum[1:])
        del terms
        self._inv = powers(INVERSE, n + 1)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, alike for alike bytes in any piece."""
        return mix((self._sum[end] - self._sum[start]) * self._inv[start] + (end - start).astype(np.uint64))

    def runs(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive values within a text, and the place of the first of each."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = words[:n].copy()
        for j in range(1, k):
            out = out * BASE + words[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(out[at]), at

    def sums(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums of ``values`` by text; ``first`` has each text's first place, and the end."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[first[1:]] - total[first[:-1]]


def pieces(batch: pa.RecordBatch, column: str, lower: bool = False, limit: int = PIECE):
    """(rows, Piece) for consecutive rows whose texts have up to ``limit`` bytes together."""
    texts = batch.column(column)
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(at, to - at), Piece(texts.slice(at, to - at), lower)
        at = to


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, ends, 1)
    return np.cumsum(steps[:-1], out=steps[:-1]) > 0


def texts_of(piece: Piece) -> list[bytes]:
    whole = piece.raw.tobytes()
    return [whole[a:b] for a, b in zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist())]
