"""Byte-level BPE by longest matches and backtracking.

The vocabulary's byte strings, mapped byte by byte to Latin-1, form an Aho-Corasick
automaton that gives the longest token at a place. The encoder takes the longest match
and, where it must, goes back to the next shorter one whenever the last two tokens could not stand side
by side in any BPE output; whether two tokens can is found once by undoing their merges
and remembered. What comes out is the sequence that the merges in order of rank give.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._shared import give_back

#: Bytes of a generation of what a task remembers of pieces, and of token pairs; there are two generations of each.
PIECE_BYTES, PAIR_BYTES = 32 << 20, 12 << 20
_NONE = -1


class _Remembered(dict):
    """Values worked out on demand, in two generations: when the younger is full it becomes the older, which goes."""

    def __init__(self, find, most: int, size):
        self.find, self.most, self.size, self.held, self.older = find, most, size, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        self.held += self.size(key, value)
        if self.held > self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = value
        return value

    def forget(self):
        self.older, self.held = {}, 0
        self.clear()


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}


class BytePairEncoder:
    """Encoder of one vocabulary; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, piece_bytes: int = PIECE_BYTES):
        self.pieces = regex.compile(pattern)
        self.rank = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, r in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.length = {r: len(t) for t, r in ranks.items()}
        self._shorter = _Remembered(self.shorter, 1 << 40, lambda token, other: 0)
        self._split: dict[int, tuple[int, int]] = {}
        #: Whether BPE can leave two tokens, (left << 32) + right, as neighbours.
        self.beside = _Remembered(lambda pair: self._fit(pair >> 32, pair & 0xFFFFFFFF), PAIR_BYTES, lambda pair, fits: 140)
        self._known = _Remembered(self._packed, piece_bytes, lambda piece, ids: 220 + 2 * len(piece) + len(ids))

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        t = self.bytes[token]
        return next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), _NONE)

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens that merge into this one last; a token never merged stands for itself."""
        if token not in self._split:
            self._split[token] = self._last_merge(self.bytes[token], token)
        return self._split[token]

    def _last_merge(self, t: bytes, token: int) -> tuple[int, int]:
        parts = [self.rank[t[i : i + 1]] for i in range(len(t))]
        while len(parts) > 2:
            best = min(((self._merged(a, b), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if 0 <= self._merged(a, b) < token), default=None)
            if best is None:
                return token, token
            parts[best[1] : best[1] + 2] = [best[0]]
        return (parts[0], parts[1]) if len(parts) == 2 else (token, token)

    def _merged(self, a: int, b: int) -> int:
        return self.rank.get(self.bytes[a] + self.bytes[b], _NONE)

    def _fit(self, left: int, right: int) -> bool:
        """Whether BPE can leave left and right as neighbours.

        Both are undone merge by merge, the later merge first. If at some time the two ends
        that face each other would merge sooner than what was just undone, BPE would have
        merged them; of equal ranks the one further left goes first.
        """
        a, b, sooner = left, right, 1 << 62
        while not 0 <= self._merged(a, b) < sooner:
            inner_a, inner_b = self.split(a)[1], self.split(b)[0]
            if inner_a == a and inner_b == b:
                return True
            if inner_b == b or (inner_a != a and a > b):
                sooner, a = a, inner_a
            else:
                sooner, b = b + 1, inner_b
        return False

    def encode_piece(self, piece: bytes) -> list[int]:
        """The token ids of one piece of text.

        The longest matches from the left, if each fits beside the next, are the answer;
        the search goes back only where one does not.
        """
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        text, length, beside, out, at = piece.decode("latin-1"), self.length, self.beside, [], 0
        for _, token in self.automaton.iter_long(text):
            if out and not beside[out[-1] << 32 | token]:
                return self._backtracked(text, out, at, token)
            out.append(token)
            at += length[token]
        return out

    def _backtracked(self, text: str, out: list[int], at: int, token: int) -> list[int]:
        """The ids of text, where out, up to at, is found and token, which starts there, doesn't fit."""
        n, length, beside, shorter, dead = len(text), self.length, self.beside, self._shorter, set()
        while True:
            end = at + length[token]
            if end not in dead and (not out or beside[out[-1] << 32 | token]):
                out.append(token)
                if end == n:
                    return out
                at, token = end, next(self.automaton.iter_long(text, end))[1]
                continue
            token = shorter[token]
            while token == _NONE:  # nothing fits here: the token before must be a shorter one
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def _packed(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def forget(self) -> None:
        """Gives back the memory of what was remembered of texts."""
        self._known.forget()
        self.beside.forget()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._known.__getitem__, self.pieces.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a run of such integers."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, BytePairEncoder] = {}


def _encoder(rank_file: bytes, pattern: str, piece_bytes: int) -> BytePairEncoder:
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest() + str(piece_bytes)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BytePairEncoder(read_ranks(rank_file), pattern, piece_bytes)
    return _ENCODERS[key]


#: Output bytes after which a batch is handed on.
BATCH_BYTES = 8 << 20


def tokenize(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(id, ids binary, decoded binary) of each row: token ids as little-endian 32-bit integers, and their bytes.

    rank_file is a path on the driver; its bytes, of a fixed size, are broadcast. Special
    tokens in a text are ordinary text. Null and empty texts have no ids and decode to
    no bytes. Only the id and text columns are read, so other columns cannot clash;
    repeated rows give repeated rows; an empty table gives none. decoded=False leaves that column null. piece_bytes bounds what a task
    remembers of pieces; a smaller bound costs time.
    """
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern, piece_bytes)
        for batch in batches:
            ids, back, lo, size = [], [], 0, 0
            for i, text in enumerate(batch.column(1)):
                row = encoder.encode(text.as_py() or "")
                ids.append(row)
                back.append(encoder.decode(row) if decoded else None)
                size += 2 * len(row)
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, i + 1 - lo), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["id", "ids", "decoded"])
                    ids, back, lo, size = [], [], i + 1, 0
        encoder.forget()
        give_back()

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)
