"""Words and shingles of many texts at once, as numpy arrays over UTF-8 bytes.

Texts stay in the Arrow buffer they came in. White space and A-Z are single
bytes in UTF-8, so splitting and lower-casing by byte is exact. A word's hash
is a polynomial over random byte values modulo 2**64, read off prefix sums,
then mixed; equal hashes of unequal words are about as likely as for any
64-bit hash.

Work goes by slices of whole texts of at most ``LIMIT`` bytes (a longer text
is a slice of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LIMIT = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For word models: everything in ASCII but letters and digits parts words.
PUNCT = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _GOLD)


_EXACT = stream(256, 1)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_PLACE = stream(64, 2) | np.uint64(1)
_POW = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW.get("n", 0) < n:
        size = max(n, LIMIT) + 1
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POW.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _POW["up"], _POW["down"]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs


def slices(offs: np.ndarray, limit: int = LIMIT) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole texts, of at most limit bytes if more than one."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of the texts b[offs[d]:offs[d + 1]]; word i of text d has woffs[d] <= i < woffs[d + 1]."""

    def __init__(self, b: np.ndarray, offs: np.ndarray, lower: bool, apart: np.ndarray = SPACE):
        self.b, self.offs, n = b, offs, len(b)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.woffs, self.hash = np.zeros(len(offs), np.int64), np.zeros(0, np.uint64)
            return
        solid = ~apart[b]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[offs[:-1][offs[:-1] < n]] = False
        after[offs[1:][offs[1:] > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.woffs = np.searchsorted(self.start, offs)
        up, down = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _EXACT)[b] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.woffs)

    def shingles(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of w words, text by text, and their offsets."""
        n, counts = len(self.hash), self.counts()
        per = np.maximum(counts - w + 1, 0)
        soffs = np.concatenate([[0], np.cumsum(per)])
        if soffs[-1] == 0:
            return np.zeros(0, np.uint64), soffs
        total = np.zeros(n - w + 1, np.uint64)
        for j in range(w):
            total += self.hash[j : n - w + 1 + j] * _PLACE[j]
        first = np.repeat(self.woffs[:-1], per) + np.arange(soffs[-1]) - np.repeat(soffs[:-1], per)
        return mix(total[first]), soffs

    def whole(self, d: int) -> np.uint64:
        """The hash of text d's whole sequence of words."""
        h = self.hash[self.woffs[d] : self.woffs[d + 1]]
        return mix(np.array([(h * _PLACE[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))]))[0]


def each(col: pa.Array, lower: bool, apart: np.ndarray = SPACE, limit: int = LIMIT) -> Iterator[tuple[int, int, Words]]:
    """(i, j, words of the texts i to j) over a column of texts."""
    data, offs = text_buffers(col)
    for i, j in slices(offs, limit):
        yield i, j, Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower, apart)
