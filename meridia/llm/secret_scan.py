"""Secret scans: fixed patterns, and dictionary-primed compression novelty.

Beyond the patterns, a candidate is a long run of key-like characters in a sensitive
context: a word of CONTEXT among the AROUND characters before it, on any line, or a PEM
block whose header has one. The text around it is compressed with and without it, by
zstandard primed with a dictionary of the corpus's own identifiers; what it adds, in
bytes a character, is its novelty. Other copies of a candidate, whole or in part, are first taken out of
that text, so that a repeated key is as novel as a single one.
A candidate is reported if its novelty reaches LEAST of the entropy of random characters
of its own alphabet, which keys cost at any length, and if its letters do not follow one
another as those of the text around do, which tells new names and words from keys.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._shared import give_back

# The base patterns, (kind, pattern, group, least length).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive.
CONTEXT = re.compile(r"password|passwd|pwd|secret|token|api_?key|credential|private|auth|bearer|access|signature", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)
PEM = re.compile(r"-----BEGIN [^\n-]*-----", re.ASCII)
#: Identifiers of version 4 and the like name things and open none.
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", re.ASCII)
#: Words of one case, joined by underscores, are names of code; a key that has underscores has digits or both cases too.
NAME = re.compile(r"_*([a-z]+|[A-Z]+)(_+([a-z]+|[A-Z]+))+_*", re.ASCII)
#: What the corpus's identifiers follow in the dictionary: identifiers and phrases of code that surround secrets without being any.
IDENTIFIERS = (
    "password passwd username user_name secret secret_key client_secret token access_token refresh_token api_key apikey "
    "authorization bearer credential credentials private_key public_key signature session_id config configuration "
    "environment production development localhost example.com https:// http:// application/json content-type "
    "import from return function class public static void string const default settings database connection "
    "get_ set_ is_ has_ create_ update_ delete_ request response header cookie certificate BEGIN END "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 "
).encode()
#: Characters around a candidate that prime its compression, and at which context words are looked for.
AROUND = 256
WORD = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])")
#: Share of its alphabet's entropy from which a candidate is reported.
LEAST = 0.9
#: Bits a letter, after the letter before it, under which a candidate reads as words; random letters have log2(26) = 4.7 or more on average.
WORDLIKE = 4.4
#: Two candidates that share so many characters in a row hold a copy of one another.
SHARED = 12


#: Texts that must have an identifier; bytes of the dictionary.
LEAST_ROWS, DICTIONARY_BYTES = 3, 32 << 10


def identifiers(docs: DataFrame, text_col: str = "text") -> bytes:
    """A dictionary of the identifiers of a corpus, the most frequent last, in front of IDENTIFIERS.

    An identifier is a run of 4 to 24 letters and underscores that LEAST_ROWS different
    texts of all rows have. Texts are told apart by a hash, and of each only its
    identifiers travel, as one text. The dictionary is bounded at every size of the table.
    """
    found = F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_]{4,24}(?![A-Za-z0-9_])"), 0))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("hash"), F.array_join(found, " ").alias("words"))
    words = texts.dropDuplicates(["hash"]).where("words <> ''").select(F.explode(F.split("words", " ")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    found, size = [], 0
    for r in counted.orderBy(F.desc("n"), "word").limit(DICTIONARY_BYTES // 5).collect():
        size += len(r.word) + 1
        if size > DICTIONARY_BYTES:
            break
        found.append(r.word.encode())
    return b" ".join([*reversed(found), IDENTIFIERS])


class NoveltyScorer:
    """Marginal compressed bytes against a primed dictionary."""

    def __init__(self, identifiers: bytes = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=17, chain_log=17, hash_log=17)
        primed.precompute_compress(compression_params=params)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, compression_params=params)

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes a character that the candidate adds between what stands around it."""
        cost = lambda text: len(self.compressor.compress(text.encode()))
        return max(0, cost(before + candidate + after) - cost(before + after)) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns; by start, then kind as listed."""
    found = []
    for kind, pattern, group, least in BASE:
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def least_novelty(candidate: str) -> float:
    """Bytes a character of random characters of the candidate's alphabet: digits, hex digits, or the kinds of letters, digits and signs it has."""
    if re.fullmatch(r"[0-9]+|[0-9A-F]+|[0-9a-f]+", candidate):
        size = 10 if candidate.isdigit() else 16
    else:
        size = sum(n for n, kind in ((10, r"[0-9]"), (26, r"[a-z]"), (26, r"[A-Z]")) if re.search(kind, candidate)) + len(set(candidate) & set("+/_=-"))
    return LEAST * math.log2(max(size, 10)) / 8


def letter_pairs(text: str) -> list[tuple[str, str]]:
    """(letter, next letter) in lower case, of each word of text; a capital begins a word unless capitals go on."""
    words = [w.lower() for w in WORD.findall(text)]
    return [p for w in words for p in zip(w, w[1:], strict=False)]


def reads_as_words(candidate: str, known: Counter, firsts: Counter) -> bool:
    """Whether three fifths of the candidate are letters that follow one another as the known pairs do."""
    pairs = letter_pairs(candidate)
    bits = sum(math.log2((firsts[a] + 26) / (known[a, b] + 1)) for a, b in pairs)
    return 5 * len(pairs) >= 3 * len(candidate) and bits < WORDLIKE * len(pairs)


def sensitive_starts(text: str, starts: list[int], around: int = AROUND) -> list[bool]:
    """Whether each start, ascending, has a context word within the `around` characters before it, or lies in a PEM block whose header has one."""
    contexts = [c.span() for c in CONTEXT.finditer(text)]
    ends = [e for _, e in contexts]
    blocks = [(h.end(), len(text) if (end := text.find("-----", h.end())) < 0 else end) for h in PEM.finditer(text) if CONTEXT.search(h.group())]
    opened = [a for a, _ in blocks]
    found = []
    for a in starts:
        last, block = bisect_right(ends, a) - 1, bisect_right(opened, a) - 1
        found.append((last >= 0 and contexts[last][0] >= a - around) or (block >= 0 and a < blocks[block][1]))
    return found


def _surroundings(text: str, runs: list[tuple[int, int]], i: int, around: int) -> tuple[str, str]:
    """`around` characters on either side of the i-th run; other runs that hold a copy of it, or of a part, are a blank there."""
    a, b = runs[i]
    low, high = max(0, a - around), min(len(text), b + around)
    grams = None

    def copies(run: tuple[int, int]) -> bool:
        nonlocal grams
        grams = grams or {text[x : x + SHARED] for x in range(a, b - SHARED + 1)}
        return any(text[x : x + SHARED] in grams for x in range(run[0], run[1] - SHARED + 1))

    before, after, at = [], [], a
    for j in range(i - 1, -1, -1):
        if runs[j][1] <= low:
            break
        if copies(runs[j]):
            before += [text[min(runs[j][1], at) : at], " "]
            at = runs[j][0]
    before.append(text[min(low, at) : at] if at > low else "")
    at = b
    for j in range(i + 1, len(runs)):
        if runs[j][0] >= high:
            break
        if copies(runs[j]):
            after += [text[at : runs[j][0]], " "]
            at = runs[j][1]
    after.append(text[at:high] if at < high else "")
    return "".join(reversed(before)), "".join(after)


def _covered(starts: list[int], ends: list[int], a: int, b: int) -> int:
    """How many of the characters a to b-1 lie in the intervals, which are apart and ascend."""
    total = 0
    for i in range(bisect_right(ends, a), len(starts)):
        if starts[i] >= b:
            break
        total += min(b, ends[i]) - max(a, starts[i])
    return total


def novel_spans(text: str, taken: list[tuple[int, int, str]], scorer: NoveltyScorer, around: int = AROUND) -> list[tuple[int, int, str]]:
    """Incompressible candidates in a sensitive context, less than half of which base spans cover."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    if not runs:
        return []
    found, known, firsts, starts, ends = [], None, None, [], []
    for s, e, _ in taken:  # as intervals apart from each other
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for i, sensitive in enumerate(sensitive_starts(text, [a for a, _ in runs], around)):
        a, b = runs[i]
        if not sensitive or 2 * _covered(starts, ends, a, b) >= b - a or UUID.fullmatch(text, a, b) or NAME.fullmatch(text, a, b):
            continue
        before, after = _surroundings(text, runs, i, around)
        if scorer.novelty(before, text[a:b], after) >= least_novelty(text[a:b]):
            if known is None:
                known = Counter(letter_pairs(CANDIDATE.sub(" ", text)) + letter_pairs(IDENTIFIERS.decode()))
                firsts = Counter()
                for (letter, _), n in known.items():
                    firsts[letter] += n
            if not reads_as_words(text[a:b], known, firsts):
                found.append((a, b, "novel"))
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes | None = None, around: int = AROUND) -> DataFrame:
    """(id, spans) of each row; spans is an array of (kind, start, end, matched) by start, then kind.

    Positions are code points, the end exclusive. Null and empty texts have no spans.
    Whole texts are scanned, of any length. The dictionary is that of identifiers(docs) if
    none is given; a context word counts within `around` characters. Repeated rows give repeated rows; only the id and text columns are
    read, so other columns cannot clash; an empty table gives no rows.
    """
    dictionary = identifiers(docs, text_col) if dictionary is None else dictionary
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = NoveltyScorer(dictionary)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, scorer, around), key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"kind": k, "start": a, "end": b, "matched": text[a:b]} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["id", "spans"])
        give_back()

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind string, start long, end long, matched string>>")
    return out.withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes | None = None, around: int = AROUND) -> DataFrame:
    """docs with each secret of the text column replaced by [SECRET:kind]; overlapping spans become one.

    The dictionary and `around` are as for scan_secrets. All other columns stay as they are, whatever
    their names. Null texts stay null.
    """
    dictionary = identifiers(docs, text_col) if dictionary is None else dictionary
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = NoveltyScorer(dictionary)
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    out, done = [], 0
                    for a, b, k in sorted(base + novel_spans(text, base, scorer, around)):
                        if a >= done:
                            out += [text[done:a], f"[SECRET:{k}]"]
                        done = max(done, b)
                    text = "".join([*out, text[done:]])
                texts.append(text)
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)
        give_back()

    return docs.mapInArrow(run, docs.schema)
