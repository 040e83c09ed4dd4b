"""Language ID by language-bitmask n-gram filters.

The frequent byte n-grams of each language go into one bit-sliced Bloom filter whose
slots are bitmasks of languages: the AND of an n-gram's slots gives every language that
has it in one look. A text's n-grams are looked up, each language's bits are counted,
the hits that the filter's fill makes by chance are taken off, and the largest rest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm._shared import give_back, written
from meridia.llm._words import LOWER, slices, text_buffers

GRAM = 4
#: Defaults: labelled rows that the fit samples at most, n-grams kept for a language, log2 of slots.
SAMPLE, GRAMS, SLOT_BITS = 20_000, 20_000, 20
#: An n-gram counts as a language's own if at least this share of its sampled texts has it.
LEAST_SHARE = 0.01
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _grams(data: np.ndarray) -> np.ndarray:
    """The n-gram at each byte as a 32-bit number, lower-case A-Z; the last ones are padded."""
    d = np.concatenate([LOWER[data], np.full(GRAM - 1, 0x20, np.uint8)]).astype(np.uint32)
    n = len(data)
    return d[:n] | d[1 : n + 1] << 8 | d[2 : n + 2] << 16 | d[3 : n + 3] << 24


@dataclass
class BitmaskFilter:
    """Languages (most common first) and the slots of their n-grams; 64 languages a word."""

    languages: list[str]
    slot_bits: int = SLOT_BITS
    words: list[np.ndarray] = field(default_factory=list)
    chance: np.ndarray | None = None

    @classmethod
    def build(cls, languages: list[str], grams: dict[str, np.ndarray], slot_bits: int = SLOT_BITS) -> BitmaskFilter:
        self = cls(languages, slot_bits)
        for w in range(0, len(languages), 64):
            group = languages[w : w + 64]
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= len(group))
            word = np.zeros(1 << slot_bits, kind)
            for bit, language in enumerate(group):
                for slots in self._slots(grams.get(language, np.empty(0, np.uint32))):
                    word[slots] |= kind(1 << bit)
            self.words.append(word)
        fill = [float((self.words[i // 64] >> self.words[i // 64].dtype.type(i % 64) & self.words[i // 64].dtype.type(1)).mean()) for i in range(len(languages))]
        self.chance = np.array(fill) ** len(_MULTIPLIERS)
        return self

    def _slots(self, grams: np.ndarray) -> list[np.ndarray]:
        return [(grams * np.uint32(m)) >> np.uint32(32 - self.slot_bits) for m in _MULTIPLIERS]

    def scores(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last + 1, corrected share of n-grams by row and language, rows with a letter)."""
        off, raw = text_buffers(column)
        for lo, hi in slices(off):
            data, bounds = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            a, b = self._slots(_grams(data))
            inside = np.ones(len(data), bool)
            for back in range(1, GRAM):
                at = bounds[1:] - back
                inside[at[(at >= bounds[:-1]) & (bounds[1:] - bounds[:-1] >= GRAM)]] = False
            total = np.add.reduceat(np.append(inside, False), bounds[:-1], dtype=np.int64) * (np.diff(bounds) > 0)
            shares = np.zeros((hi - lo, len(self.languages)))
            for w, word in enumerate(self.words):
                mask = np.append(np.where(inside, word[a] & word[b], word.dtype.type(0)), word.dtype.type(0))
                for bit in range(min(64, len(self.languages) - 64 * w)):
                    one = (mask >> word.dtype.type(bit)) & word.dtype.type(1)
                    hits = np.add.reduceat(one, bounds[:-1], dtype=np.int64) * (np.diff(bounds) > 0)
                    chance = self.chance[64 * w + bit]
                    shares[:, 64 * w + bit] = np.clip((hits / np.maximum(total, 1) - chance) / max(1e-9, 1 - chance), 0, 1)
            letters = (np.add.reduceat(np.append(_LETTER[data], False), bounds[:-1], dtype=np.int64) > 0) & (np.diff(bounds) > 0)
            for i in np.flatnonzero(~letters & (np.diff(bounds) > 0)):
                letters[i] = any(c.isalpha() for c in data[bounds[i] : bounds[i + 1]].tobytes().decode())
            yield lo, hi, shares, letters

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        """(language or und, score) of each text; ties go to the more common language."""
        names, scores = [], []
        if len(column) == 0:
            return names, scores
        for lo, hi, shares, letters in self.scores(column):
            best = shares.argmax(axis=1) if self.languages else np.zeros(hi - lo, int)
            for i in range(hi - lo):
                known = bool(letters[i]) and bool(self.languages)
                names.append(self.languages[best[i]] if known else "und")
                scores.append(float(shares[i, best[i]]) if known else 0.0)
        return names, scores


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, texts) partial counts of (text, lang) batches."""
    for batch in batches:
        seen: dict[str, list[np.ndarray]] = {}
        off, raw = text_buffers(batch.column(0))
        for i, lang in enumerate(batch.column(1).to_pylist()):
            data = raw[off[i] : off[i + 1]]
            seen.setdefault(lang, []).append(np.unique(_grams(data)[: max(0, len(data) - GRAM + 1)]))
        for lang, parts in seen.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "texts"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", seed_col: str = "doc_id", sample: int = SAMPLE, grams: int = GRAMS, slot_bits: int = SLOT_BITS) -> BitmaskFilter:
    """A filter from the rows with a text and a language.

    Each language has an equal share of about `sample` rows, or all its rows if they are
    fewer, chosen by a hash of seed_col and so the same on every run; it keeps its `grams`
    most frequent n-grams. Both bounds hold whatever the size of the table. Without
    labelled rows the filter knows no language.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(seed_col)).alias("seed")).where("text IS NOT NULL AND lang IS NOT NULL")
    texts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(texts, key=lambda x: (-texts[x], x))
    if not languages:
        return BitmaskFilter.build([], {}, slot_bits)
    share = max(1, sample // len(texts))
    bounds = F.create_map(*[F.lit(x) for lang, n in texts.items() for x in (lang, (share << 62) // max(n, share))])
    rows = written(rows.where(F.shiftrightunsigned("seed", 2) < bounds[F.col("lang")]).select("text", "lang"), "language-sample")
    counts = rows.mapInArrow(_frequencies, "lang string, gram long, texts long").groupBy("lang", "gram").agg(F.sum("texts").alias("texts"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("sampled"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("texts"), "gram"))
    top = counts.join(sizes, "lang").where(F.col("texts") >= F.greatest(F.lit(1.0), LEAST_SHARE * F.col("sampled"))).withColumn("place", place).where(F.col("place") <= grams)
    found = {lang: part.to_numpy(np.int64).astype(np.uint32) for lang, part in top.select("lang", "gram").toPandas().groupby("lang")["gram"]}
    return BitmaskFilter.build(languages, found, slot_bits)


def identify(docs: DataFrame, model: BitmaskFilter, text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(carried columns, lang_pred, score) of each row.

    lang_pred is a language of the model, or und for null texts and texts without a
    letter; score, from 0 to 1, is the share of the text's n-grams that are the
    language's beyond chance. Whole texts count. Ties go to the language with more
    labelled rows. Only the text and the carried columns are read. Repeated rows give
    repeated rows; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = carry or {}
    source = docs.select(F.col(text_col).alias("text"), *[c.alias(n) for n, c in carry.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    return source.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double"]))


def keep_identified(docs: DataFrame, model: BitmaskFilter, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """docs without the rows whose language is und or has a score under `least`; the rest as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at))
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
