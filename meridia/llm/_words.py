"""Words of Arrow text columns as NumPy arrays of 64-bit hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; texts are taken
whole, in slices of a quarter MB or so, so that memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C55 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MAX = U(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, SLICE_BYTES + 1)
        _POW, _INV = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BASE_INVERSE))
    return _POW, _INV


@dataclass
class Words:
    """Words of the texts lo to hi-1 of a batch: word w of text lo+d has first[d] <= w < first[d+1]."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))

    def windows(self, k: int, base: int) -> np.ndarray:
        """A hash of the k words from each word on; only those with left() >= k mean anything."""
        n = len(self.hashes)
        padded = np.concatenate([self.hashes, np.zeros(k, np.uint64)])
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc *= U(base)
            acc += padded[j : j + n]
        return mix(acc)

    def sequences(self, n: int) -> np.ndarray:
        """Of the n words from each word on, the hash that shingle_sets gives a text of just these words; only those with left() >= n mean anything."""
        padded = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        acc = np.full(len(self.hashes), n, np.uint64)
        for j in range(n):
            acc *= U(SHORT_BASE)
            acc += padded[j : j + len(acc)]
        return mix(acc)

    def shingle_sets(self, k: int) -> Iterator[np.ndarray]:
        """Each text's sorted distinct k-word shingles; with fewer words, the whole sequence as one."""
        all_, first = self.windows(k, SHINGLE_BASE), self.first
        for d in range(self.hi - self.lo):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= k:
                yield np.unique(all_[a : b - k + 1])
            elif b > a:
                acc = U(b - a)
                with np.errstate(over="ignore"):
                    for h in self.hashes[a:b]:
                        acc = acc * U(SHORT_BASE) + h
                yield mix(np.array([acc], np.uint64))
            else:
                yield np.empty(0, np.uint64)


SHINGLE_BASE = 0xD6E8FEB86659FD93
SHORT_BASE = 0xA3B195354A39B70D


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, without a copy of its bytes where it has no nulls; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return off.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of a string column, slice by slice."""
    if len(column) == 0:
        return
    off, raw = text_buffers(column)
    for lo, hi in slices(off):
        data = raw[off[lo] : off[hi]]
        n = len(data)
        if lower:
            data = LOWER[data]
        bounds = off[lo : hi + 1] - off[lo]
        word = ~SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        before = np.concatenate([[False], word[:-1]]) if n else word
        after = np.concatenate([word[1:], [False]]) if n else word
        starts = np.flatnonzero(word & (~before | cut[:n]))
        ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts] + U(0x632BE59BD9B4E019) * (ends - starts).astype(np.uint64))
        yield Words(lo, hi, data, starts, ends, np.searchsorted(starts, bounds), hashes)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
