"""Periodic runs of words, and texts with their repeated periods cut.

Words of one text are symbols, told apart by 64-bit hashes. Suffixes of all texts of a
slice are sorted together by prefix doubling; the ranks of every doubling stay, so that
the longest common extension of two places, forwards or backwards, takes one look a
level. The suffix array and its LCPs give the longest previous factor of every place and
so the LZ blocks. Runs that touch a block's ends come from Main's extensions around the
boundaries; runs strictly inside a block are copies of earlier ones, found in the
buckets of their starts at the block's source.

A run of length L >= least has at its second period a previous factor of L/2 words or
more, so texts in which no window of so many words occurs twice have no runs and are
passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm._shared import give_back
from meridia.llm._words import Words, mix, words_of

_WINDOW_BASE = 0xB5297A4D3F84D5B5
#: Pairs of a boundary and a period that are looked at together.
_PAIRS = 1 << 18


class Extensions:
    """Suffix order of several texts laid end to end, and longest common extensions of two places of one text.

    levels[k][i] tells apart the 2^k words from i on; it decides for places that have so
    many words left, others are unlike all.
    """

    def __init__(self, symbols: np.ndarray, text: np.ndarray) -> None:
        n = len(symbols)
        self.n, self.text = n, text
        order = np.lexsort((symbols, text))
        fresh = np.ones(n, bool)
        fresh[1:] = (symbols[order][1:] != symbols[order][:-1]) | (text[order][1:] != text[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        self.levels, span = [rank.astype(np.int32)], 1
        while True:
            # Only the places whose rank others share are sorted further; a rank is its group's first place in the order.
            open_ = ~(fresh & np.append(fresh[1:], True))
            at = order[open_]
            if not len(at):
                break
            after = np.full(len(at), -1, np.int64)
            inside = at + span < n
            after[inside] = np.where(text[at[inside] + span] == text[at[inside]], rank[at[inside] + span], -1)
            by = np.lexsort((after, rank[at]))
            at, after = at[by], after[by]
            order[open_] = at
            own = rank[at]
            new = np.ones(len(at), bool)
            new[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
            slots = np.flatnonzero(open_)
            fresh[slots] = new
            rank = rank.copy()
            rank[at] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
            span *= 2
            self.levels.append(rank.astype(np.int32))
        self.order, self.rank = order, rank

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on and from j on are alike; none where a place is outside."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            live = (np.maximum(i, j) < self.n) & (np.minimum(i, j) >= 0)
            x, y = np.where(live, i, 0), np.where(live, j, 0)
            step = np.where(live & (level[x] == level[y]) & (x != y), 1 << k, 0)
            out += step
            i += step
            j += step
        return out

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i and up to j are alike, i and j included."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, back = self.levels[k], (1 << k) - 1
            live = (np.minimum(i, j) >= back) & (np.maximum(i, j) < self.n)
            x, y = np.where(live, i - back, 0), np.where(live, j - back, 0)
            step = np.where(live & (level[x] == level[y]) & (x != y), 1 << k, 0)
            out += step
            i -= step
            j -= step
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(LPF, source) of every place: the longest factor from it on that also starts earlier in its text, and where.

        Of the suffixes, in their order, the nearest earlier-starting ones to either side
        share most; they are found for all places at once by following the finds of others.
        """
        n, sa = self.n, self.order
        best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for side in (-1, 1):
            near = np.arange(n) + side
            hop = np.arange(n)
            while len(hop):
                to = near[hop]
                inside = (to >= 0) & (to < n)
                hop, to = hop[inside], to[inside]
                later = sa[to] > sa[hop]
                hop, to = hop[later], to[later]
                near[hop] = near[to]
            valid = np.flatnonzero((near >= 0) & (near < n))
            here, there = sa[valid], sa[near[valid]]
            shared = self.forwards(here, there)
            better = shared > best[here]
            best[here[better]], source[here[better]] = shared[better], there[better]
        return best, source


@dataclass
class Runs:
    """Runs of several texts laid end to end: first words, lengths, smallest periods, in the order of start and period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def blocks_of(lpf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The starts of the LZ blocks: each is the longest factor that also starts earlier, or one new word."""
    steps, starts = np.maximum(lpf, 1).tolist(), []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        at = lo
        while at < hi:
            starts.append(at)
            at += steps[at]
    return np.array(starts, np.int64)


def runs_of(symbols: np.ndarray, first: np.ndarray, least: int) -> Runs:
    """All runs of at least `least` words, and twice their period, in texts laid end to end; text d has first[d] <= word < first[d + 1]."""
    none = np.empty(0, np.int64)
    if not len(symbols):
        return Runs(none, none, none)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ext = Extensions(symbols, text)
    lpf, source = ext.previous_factors()
    begin = blocks_of(lpf, first)
    size = np.diff(np.append(begin, len(symbols)))
    start, end, period = _around(ext, begin, size, first, text, least)
    return _copied(start, end, period, begin, size, source, least)


def _around(ext: Extensions, begin: np.ndarray, size: np.ndarray, first: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs that cross, begin at or end before a boundary of blocks.

    A run that ends in a block and starts before it starts less than its period before
    the previous block, else that block would be longer; so periods are less than both
    blocks together, and its length less than twice that.
    """
    opens = text[begin]
    before = np.where(np.concatenate([[False], opens[1:] == opens[:-1]]), np.concatenate([[0], size[:-1]]), 0)
    last = np.flatnonzero(np.append(opens[1:] != opens[:-1], True))
    at, most = np.concatenate([begin, first[opens[last] + 1]]), np.concatenate([before + size, size[last]])
    of = np.concatenate([opens, opens[last]])
    wide = 2 * most >= least
    at, most, of = at[wide], most[wide], of[wide]
    out, cuts = [], np.concatenate([[0], np.cumsum(most)])
    # Boundaries go in parts of a bounded number of pairs; a boundary of more of them is a part of its own, and is cut by periods.
    for lo, hi in _parts(cuts):
        for shift in range(0, int(most[lo:hi].max(initial=0)), _PAIRS):
            n = np.clip(most[lo:hi] - shift, 0, _PAIRS)
            c = np.repeat(at[lo:hi], n)
            q = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n) + 1 + shift
            d = np.repeat(of[lo:hi], n)
            for left in (True, False):
                i, j = (c - q, c) if left else (c, c + q)
                ok = (i >= first[d]) & (j <= first[d + 1])
                i, j, p, e = i[ok], j[ok], q[ok], d[ok]
                inner = j < first[e + 1]
                fore = np.zeros(len(i), np.int64)
                fore[inner] = ext.forwards(i[inner], j[inner])
                back = np.zeros(len(i), np.int64)
                inner = i > first[e]
                back[inner] = ext.backwards(i[inner] - 1, j[inner] - 1)
                full = (fore + back >= p) & (fore + back + p >= least)
                out.append((i[full] - back[full], j[full] + fore[full], p[full]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parts(cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(cuts) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + _PAIRS, side="right")) - 1))
        yield lo, hi
        lo = hi


def _copied(start: np.ndarray, end: np.ndarray, period: np.ndarray, begin: np.ndarray, size: np.ndarray, source: np.ndarray, least: int) -> Runs:
    """The runs around boundaries, each once by its smallest period, and their copies strictly inside later blocks."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[once].tolist(), end[once].tolist(), period[once].tolist()
    buckets: dict[int, list[tuple[int, int]]] = {}
    for s, e, q in zip(start, end, period, strict=True):
        buckets.setdefault(s, []).append((e, q))
    for b in np.flatnonzero(size >= least + 2).tolist():
        to = int(begin[b])
        move = to - int(source[to])
        stop = to + int(size[b]) - move
        if not buckets:
            break
        for x in range(to - move + 1, stop - least):
            for e, q in buckets.get(x, ()):
                if e < stop:
                    start.append(x + move)
                    end.append(e + move)
                    period.append(q)
                    buckets.setdefault(x + move, []).append((e + move, q))
    start, end, period = (np.array(v, np.int64) for v in (start, end, period))
    order = np.lexsort((period, start))
    return Runs(start[order], (end - start)[order], period[order])


def _with_repeats(w: Words, window: int) -> np.ndarray:
    """The texts of a slice in which some window of so many words occurs twice."""
    n = len(w.hashes)
    if not n:
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(w.hi - w.lo), w.counts)
    whole = w.left() >= window
    with np.errstate(over="ignore"):
        keys = mix(w.windows(window, _WINDOW_BASE) ^ mix(text.astype(np.uint64) + np.uint64(1)))[whole]
    text = text[whole]
    order = np.argsort(keys)
    twice = keys[order][1:] == keys[order][:-1]
    return np.unique(text[order][1:][twice])


def _slice_runs(w: Words, least: int) -> Runs:
    """The runs of a slice's texts; starts are words of the slice."""
    texts = _with_repeats(w, (least + 1) // 2)
    counts = w.counts[texts]
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    place = np.arange(int(first[-1])) + np.repeat(w.first[texts] - first[:-1], counts)
    runs = runs_of(w.hashes[place], first, least)
    return Runs(place[runs.start] if len(place) else runs.start, runs.length, runs.period)


def _collapsed(w: Words, runs: Runs) -> pa.Array:
    """The texts, one space between words, without the words that a run has after its first period."""
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(edge, runs.start + runs.period, 1)
    np.add.at(edge, runs.start + runs.length, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    text = np.searchsorted(w.first, kept, side="right") - 1
    inside = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(inside, w.starts[kept], 1)
    np.add.at(inside, w.ends[kept], -1)
    keep = np.cumsum(inside[:-1]) > 0
    gap = w.ends[kept[:-1][text[1:] == text[:-1]]]  # after a kept word that another one of its text follows stands some space
    keep[gap] = True
    data = w.data.copy()
    data[gap] = 0x20
    length = np.zeros(w.hi - w.lo, np.int64)
    np.add.at(length, text, w.ends[kept] - w.starts[kept])
    np.add.at(length, text[1:][text[1:] == text[:-1]], 1)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(w.hi - w.lo, pa.py_buffer(offsets), pa.py_buffer(data[keep]))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text_col: str = "text", carry: dict[str, Column] | None = None, least: int = 12) -> DataFrame:
    """(carried columns, n_words, runs, collapsed) of each row.

    Words are maximal stretches without 0x20 and 0x09-0x0D. A run is a stretch of words
    with smallest period q, at least max(least, 2 q) words long, that no neighbouring
    word extends keeping period q; `runs` lists (start, length, period) of every run, by
    start and then period. `collapsed` has the words, joined by one space, without those
    that any run contains after its first q words. Null and empty texts, and texts
    without words, have 0 words, no runs and an empty `collapsed`. Whole texts count; a
    text's tables stay in its task, some 40 bytes a word and 4 more for each doubling of its
    longest repeat. Only the text and the carried columns are read, so other columns
    cannot clash. Repeated rows give repeated rows; an empty table gives none.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    carry = carry or {}
    source = docs.select(F.col(text_col).alias("text"), *[c.alias(n) for n, c in carry.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(0)):
                found = _slice_runs(w, least)
                at = np.searchsorted(found.start, w.first).astype(np.int32)
                text = np.searchsorted(w.first, found.start, side="right") - 1
                lists = pa.StructArray.from_arrays([pa.array(v) for v in (found.start - w.first[text], found.length, found.period)], fields=list(_RUN))
                rest = [batch.column(i).slice(w.lo, w.hi - w.lo) for i in range(1, batch.num_columns)]
                columns = [*rest, pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), lists), _collapsed(w, found)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "n_words", "runs", "collapsed"])
        give_back()

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    return source.mapInArrow(run, ", ".join([*kinds, "n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"]))
