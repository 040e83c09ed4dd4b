"""Substring dedup by level-wise doubling of repeated word windows.

The target window is reached through shorter ones: every target window nominates the
least-hashed window of the current length inside it, so equal target windows nominate
equal ones. Target windows whose nominee starts at one place only are dropped; the others
nominate at twice the length, until the length is the target's own and what repeats is
known exactly, or no candidate survives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm._shared import written
from meridia.llm._words import MAX, U, Words, mix, signed, words_of

#: No level is shorter than this many words.
BASE = 16
_FIRST, _SECOND = 0xC2B2AE3D27D4EB4F, 0x9E6C63D0876A9A47
_ROWS = 200_000
#: Rows of one batch and key that are dealt together; two at least, so that each still sees another.
PACK = 500


def levels(window: int) -> list[int]:
    """Window lengths, each at most twice the one before; the last is the target. Short targets are looked at twice."""
    found = [window]
    while (found[-1] + 1) // 2 >= BASE:
        found.append((found[-1] + 1) // 2)
    return found[::-1] if len(found) > 1 else [window, window]


def _texts(w: Words) -> Iterator[list[bytes]]:
    raw = w.data.tobytes()
    s, e = w.starts.tolist(), w.ends.tolist()
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        yield [raw[x:y] for x, y in zip(s[a:b], e[a:b], strict=True)]


def _nominees(w: Words, window: int, length: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the length-word window at each word, which of them an open target window nominates)."""
    h = np.where(w.left() >= length, w.windows(length, _FIRST), MAX)
    n, span = len(h), window - length + 1
    padded = np.concatenate([h, np.full(span, MAX)])
    least = padded[:n].copy()
    for j in range(1, span):
        np.minimum(least, padded[j : j + n], out=least)
    chosen = np.zeros(n + span, bool)
    for j in range(span):
        chosen[j : j + n] |= open_ & (padded[j : j + n] == least)
    return h, chosen[:n]


def _opened(w: Words, window: int, length: int, repeated: list[np.ndarray]) -> np.ndarray:
    """The target windows whose nominee of that length is among their text's repeated ones."""
    h, chosen = _nominees(w, window, length, w.left() >= window)
    n, span = len(h), window - length + 1
    padded = np.concatenate([h, np.full(span, MAX)])
    least = padded[:n].copy()
    for j in range(1, span):
        np.minimum(least, padded[j : j + n], out=least)
    hit = np.zeros(n, bool)
    for d, known in enumerate(repeated):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if len(known) and b > a:
            at = np.minimum(np.searchsorted(known, least[a:b]), len(known) - 1)
            hit[a:b] = known[at] == least[a:b]
    return hit & (w.left() >= window)


def _once_a_batch(key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row order, key to deal by): the first row of a key keeps it; if the batch has more, all of them
    take keys of their own, PACK rows or more to each, so that a hot key meets its task once a batch."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    of = np.cumsum(fresh) - 1
    size = np.bincount(of, minlength=int(fresh.sum()))[of] if len(k) else k
    many = size > 1
    heads = np.flatnonzero(fresh)
    pack = np.minimum((np.arange(len(k)) - heads[of]) // PACK, np.maximum(size // PACK - 1, 0)).astype(np.uint64) if len(k) else k
    tag = mix(k + pack + U(0x27D4EB2F165667C5)) ^ mix(more[0][order[heads]][of].view(np.uint64)) if len(k) else k
    return np.concatenate([order[fresh], order[many]]), np.concatenate([k[fresh], tag[many]])


def _emit(arrays: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(arrays[0]), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + _ROWS]) for a in arrays], names)


def _profile(window: int, length: int):
    """Per text: words, digest of the joined words, and the nominees of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(2)):
                h, chosen = _nominees(w, window, length, w.left() >= window)
                at = np.flatnonzero(chosen)
                cuts = np.searchsorted(at, w.first).astype(np.int32)
                shas = [hashlib.sha256(b" ".join(t)).hexdigest() for t in _texts(w)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(w.lo, w.hi - w.lo) for i in range(2)] + [pa.array(w.counts.astype(np.int64)), pa.array(shas), pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(h[at])))],
                    ["id", "ref", "n_words", "sha", "nominees"],
                )

    return run


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        ref = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
        h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.lexsort((ref, h))  # of a nominee's places in one text two tell as much as all
        third = np.zeros(len(h), bool)
        third[2:] = (h[order][2:] == h[order][:-2]) & (ref[order][2:] == ref[order][:-2])
        h, ref = h[order][~third], ref[order][~third]
        order, key = _once_a_batch(h, ref)
        yield from _emit([signed(key), ref[order], signed(h[order])], ["key", "ref", "h"])


def _candidates(window: int, done: list[int], length: int):
    """From (text, ref, sha, r0, r1 ..): the repeated nominees of the levels done, the rows of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [batch.column(i) for i in range(2, 2 + len(done))]
            refs = batch.column(1).to_numpy(zero_copy_only=False)
            parts: list[list[np.ndarray]] = []
            for w in words_of(batch.column(0)):
                open_ = w.left() >= window
                for level, lists in zip(done, known, strict=True):
                    repeated = [np.unique(np.array(lists[i].as_py() or [], np.int64).view(np.uint64)) for i in range(w.lo, w.hi)]
                    open_ &= _opened(w, window, level, repeated)
                ref = np.repeat(refs[w.lo : w.hi], w.counts)
                place = (np.arange(len(w.hashes)) - np.repeat(w.first[:-1], w.counts)).astype(np.int32)
                h, chosen = _nominees(w, window, length, open_)
                at = np.flatnonzero(chosen)
                second = w.windows(length, _SECOND)[at] if length == window else h[at]
                parts.append([h[at], second, ref[at], place[at]])
                if sum(len(p[0]) for p in parts) > 2_000_000:
                    yield from _level_rows(parts)
                    parts = []
            if parts:
                yield from _level_rows(parts)

    return run


def _level_rows(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    h, second, ref, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, key = _once_a_batch(mix(h) ^ second, ref)
    yield from _emit([signed(key), signed(h[order] if len(h) else h), signed(second[order]), ref[order], place[order]], ["key", "h", "second", "ref", "place"])


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            for w in words_of(batch.column(0)):
                gone, shas = [], []
                for d, words in enumerate(_texts(w)):
                    edge = np.zeros(len(words) + window + 1, np.int64)
                    at = np.unique(np.array(places[w.lo + d].as_py(), np.int64))
                    edge[at] += 1
                    edge[at + window] -= 1
                    covered = np.cumsum(edge)[: len(words)] > 0
                    gone.append(int(covered.sum()))
                    shas.append(hashlib.sha256(b" ".join([x for x, c in zip(words, covered.tolist(), strict=True) if not c])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(w.lo, w.hi - w.lo), pa.array(gone, pa.int64()), pa.array(shas)], ["sha", "n_removed", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each row, once repeated windows are cut.

    A word goes if a window of `window` words over it also starts at another place, of
    the same text or another; windows are judged on the input. Equal texts, repeated
    rows too, are one another's copies, so all their windows repeat. Null and empty
    texts, and texts without words, keep nothing of nothing. Only the id and text
    columns are read. An empty table gives no rows.
    """
    steps = levels(window)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("ref"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    profile = written(source.mapInArrow(_profile(window, steps[0]), f"id {kind}, ref long, n_words long, sha string, nominees array<long>"), "profile")
    classes = profile.groupBy("sha").agg(F.count("*").alias("copies"), F.min(F.struct("ref", "id")).alias("rep"))
    reps = classes.select("sha", F.col("rep.ref").alias("ref"), F.col("rep.id").alias("id"))
    once = reps.select(F.col("ref").alias("rep_ref"), F.col("id").alias("rep_id"), F.col("sha").alias("rep_sha"))
    first = profile.where("size(nominees) > 0").join(once, (F.col("ref") == F.col("rep_ref")) & F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("sha") == F.col("rep_sha")), "left_semi")
    first = first.select("ref", "nominees").mapInArrow(_first_rows, "key long, ref long, h long")
    work = reps.join(_repeated(first, "key").groupBy("ref").agg(F.collect_set("h").alias("r0")), "ref")
    texts = source.withColumnsRenamed({"ref": "ref0", "id": "id0"})
    work = written(texts.join(work, (F.col("ref0") == F.col("ref")) & F.col("id0").eqNullSafe(F.col("id"))).select("text", "sha", F.xxhash64("sha").alias("ref"), "r0"), "survivors")
    for i, length in enumerate(steps[1:], 1):
        known = [f"r{j}" for j in range(i)]
        rows = work.select("text", "ref", *known).mapInArrow(_candidates(window, steps[:i], length), "key long, h long, second long, ref long, place int")
        if length < window:
            found = _repeated(rows, "key").groupBy("ref").agg(F.collect_set("h").alias(f"r{i}"))
            work = written(work.join(found, "ref"), "survivors")
        else:
            found = _repeated(rows, "key", "h", "second").groupBy("ref").agg(F.collect_list("place").alias("places"))
    cut = work.select("text", "sha", "ref").join(found, "ref").select("text", "sha", "places").mapInArrow(_removed(window), "sha string, n_removed long, kept_sha256 string").dropDuplicates(["sha"])
    whole = F.col("copies") > 1
    nothing = F.sha2(F.lit(""), 256)
    decided = classes.select("sha", "copies").join(cut, "sha", "left")
    long_ = F.col("n_words") >= window
    return profile.select("id", "n_words", "sha").join(decided, "sha").select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(whole & long_, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole & long_, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys occur more than once."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1")
