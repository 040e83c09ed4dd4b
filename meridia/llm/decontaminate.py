"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets. An item's sketch holds its
least MinHash values, as many as a document can lack at the containment threshold plus
one: a document that contains enough of the item holds a value of its sketch, however
long the document is. Documents look their own MinHash values up among the sketches of
the partitions whose items are small enough to be inside them; each candidate pair is
verified by the exact containment of the item's shingles in the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridia.llm._shared import give_back
from meridia.llm._words import SHINGLE_BASE, U, Words, mix, words_of

#: Characters of item texts that one pass over the documents searches for; more items take more passes.
BLOCK_CHARS = 16 << 20
_MINHASH = U(0x8CB92BA72F3D8DD7)


@dataclass
class ItemIndex:
    """Sketches of one block of items, by size partition, and the items' exact sets."""

    ids: list
    sets: list[np.ndarray]
    #: Of each partition: its least count of shared shingles, sorted sketch values, their items.
    partitions: list[tuple[int, np.ndarray, np.ndarray]]
    need: np.ndarray
    #: Of each length under k words: the items' whole sequences, sorted, and the items of each.
    short: dict[int, tuple[np.ndarray, list[list[int]]]]

    @classmethod
    def build(cls, rows: list[tuple], k: int, num: int, den: int) -> ItemIndex:
        ids, sets, words = [], [], []
        for w in words_of(pa.array([t for _, t in rows], pa.large_string()), True):
            for (i, _), s, n in zip(rows[w.lo : w.hi], w.shingle_sets(k), w.counts.tolist(), strict=True):
                if len(s):
                    ids.append(i)
                    sets.append(s)
                    words.append(n)
        need = np.array([-(-num * len(s) // den) for s in sets], np.int64)
        by_class: dict[int, list[int]] = {}
        by_length: dict[int, dict[int, list[int]]] = {}
        for i, (s, n) in enumerate(zip(sets, words, strict=True)):
            if n < k:
                by_length.setdefault(n, {}).setdefault(int(s[0]), []).append(i)
            else:
                by_class.setdefault(len(s).bit_length(), []).append(i)
        short = {n: (np.array(sorted(of), np.uint64), [of[v] for v in sorted(of)]) for n, of in by_length.items()}
        partitions = []
        for members in by_class.values():
            values, owner = [], []
            for i in members:
                sketch = np.sort(mix(sets[i] ^ _MINHASH))[: len(sets[i]) - need[i] + 1]
                values.append(sketch)
                owner.append(np.full(len(sketch), i))
            v, o = np.concatenate(values), np.concatenate(owner)
            order = np.argsort(v, kind="stable")
            partitions.append((int(need[members].min()), v[order], o[order]))
        return cls(ids, sets, partitions, need, short)

    def search(self, column: pa.Array, k: int) -> Iterator[tuple[int, int, int]]:
        """(row, item number, shared shingles) of the pairs of a text column that reach the threshold."""
        for w in words_of(column, True):
            counts = w.counts
            shingles = w.windows(k, SHINGLE_BASE)
            valid = np.flatnonzero(w.left() >= k)
            text = np.repeat(np.arange(w.hi - w.lo), counts)[valid]
            value = mix(shingles[valid] ^ _MINHASH)
            pairs: set[tuple[int, int]] = set()
            for least, sketch, owner in self.partitions:
                low = np.flatnonzero((value <= sketch[-1]) & (counts[text] - k + 1 >= least))
                a = np.searchsorted(sketch, value[low], side="left")
                hit = sketch[np.minimum(a, len(sketch) - 1)] == value[low]
                low, a = low[hit], a[hit]
                b = np.searchsorted(sketch, value[low], side="right")
                for t, x, y in zip(text[low].tolist(), a.tolist(), b.tolist(), strict=True):
                    pairs.update((t, int(o)) for o in owner[x:y])
            sets = {}
            for n, (sequence, owner) in self.short.items():
                at = np.flatnonzero(w.left() >= n)
                value = w.sequences(n)[at]
                a = np.minimum(np.searchsorted(sequence, value), len(sequence) - 1)
                hit = sequence[a] == value
                found = {(t, int(i)) for t, x in zip(np.repeat(np.arange(w.hi - w.lo), counts)[at][hit].tolist(), a[hit].tolist(), strict=True) for i in owner[x]}
                yield from ((w.lo + t, i, 1) for t, i in sorted(found))
            for t, i in sorted(pairs):
                if t not in sets:
                    a, b = int(w.first[t]), int(w.first[t + 1])
                    sets[t] = np.unique(shingles[a : b - k + 1])
                shared = int(np.isin(self.sets[i], sets[t], assume_unique=True).sum())
                if shared >= self.need[i]:
                    yield w.lo + t, i, shared


def item_blocks(items: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> Iterator:
    """Broadcast indexes of the items, block by block; a block holds BLOCK_CHARS characters or so."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("id").collect()
        index = ItemIndex.build([(r.id, r.text) for r in block], k, num, den)
        if index.ids:
            yield items.sparkSession.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc id, item id, n_shared, n_item, containment) of every document that holds enough of an item.

    Enough: at least threshold (numerator, denominator) of the item's distinct k-word
    shingles, in lower case A-Z, anywhere in the whole document. An item with fewer words
    than k is one shingle, its whole sequence, and is held wherever that stands. Null and
    empty texts hold nothing and are in nothing. Repeated rows and ids give a row each;
    repeated items count once. Only id and text columns are read. Empty tables give no rows.
    """
    num, den = threshold
    left, right = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType
    kind = to_arrow_type(right)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {left}, item {right.simpleString()}, n_shared long, n_item long"
    found = docs.sparkSession.createDataFrame([], schema)
    for shared_index in item_blocks(items, item_id, item_text, k, num, den):
        found = found.unionByName(source.mapInArrow(_pairs(shared_index, k, kind), schema))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _pairs(shared_index, k: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared_index.value
        for batch in batches:
            hits = list(index.search(batch.column(1), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                    pa.array([index.ids[h[1]] for h in hits], kind),
                    pa.array([h[2] for h in hits], pa.int64()),
                    pa.array([len(index.sets[h[1]]) for h in hits], pa.int64()),
                ],
                ["id", "item", "n_shared", "n_item"],
            )

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs without the rows that contaminated() would report; columns and other rows as they are."""
    num, den = threshold
    at = docs.columns.index(text_col)
    kept = docs
    for shared_index in item_blocks(items, item_id, item_text, k, num, den):
        kept = kept.mapInArrow(_clean(shared_index, at, k), docs.schema)
    return kept


def _clean(shared_index, at: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[h[0] for h in shared_index.value.search(batch.column(at), k)]] = False
            yield batch.filter(pa.array(keep))
        give_back()

    return run
