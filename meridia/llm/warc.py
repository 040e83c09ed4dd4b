"""WARC archives as Zstandard files: one frame a record, the dictionary in front.

An archive starts with a skippable frame that holds its dictionary; every record is a
frame of its own, primed with it. Archives are rows of a binary column, as the
binaryFile source gives them, so they go wherever Spark reads and writes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: magic numbers of the dictionary's frame and of any frame.
DICTIONARY_MAGIC, FRAME_MAGIC, SKIPPABLE = 0x184D2A5D, 0xFD2FB528, b"\x2a\x4d\x18"
#: Compressed bytes that the reader looks at in one go.
PIECE = 16 << 10
#: Record bytes after which an archive ends, sample records and bytes of its dictionary.
ARCHIVE_BYTES, SAMPLES, DICTIONARY_BYTES = 8 << 20, 64, 16 << 10
_CRLF = b"\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, url: str, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the payload's digest and reference and no block."""
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def dictionary_of(records: list[bytes]) -> bytes:
    """A trained dictionary, or, of too few records to train on, their first bytes as raw content."""
    sample = [r[: 64 << 10] for r in records[:SAMPLES]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1"


def pack_archive(records: list[bytes]) -> bytes:
    """Records as one archive."""
    raw = dictionary_of(records)
    packed = zstandard.ZstdCompressor().compress(raw)
    primed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed, *map(primed.compress, records)])


def _dictionary(archive: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    if len(archive) < 8 or struct.unpack_from("<I", archive)[0] != DICTIONARY_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", archive, 4)[0]
    raw = archive[8 : 8 + size]
    if len(raw) < size:
        raise ValueError("the dictionary's frame is cut off")
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), 8 + size


def _frame(dictionary: zstandard.ZstdCompressionDict | None, view: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the frame at a byte, and where the next one starts; fed bit by bit, so that no more than a piece is copied beyond it."""
    frame = (zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()).decompressobj()
    start, parts = at, []
    try:
        while not frame.eof and at < len(view):
            parts.append(frame.decompress(view[at : at + PIECE]))
            at = min(at + PIECE, len(view))
    except zstandard.ZstdError as e:
        raise ValueError(f"no frame at byte {start}: {e}") from e
    if not frame.eof:
        raise ValueError(f"the frame at byte {start} is cut off")
    return b"".join(parts), at - len(frame.unused_data)


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive; raises ValueError where it is not valid."""
    dictionary, at = _dictionary(archive)
    view = memoryview(archive)
    while at < len(archive):
        if archive[at + 1 : at + 4] == SKIPPABLE and archive[at] >> 4 == 5:  # a frame of no concern here
            at += 8 + int.from_bytes(archive[at + 4 : at + 8], "little")
            if at > len(archive):
                raise ValueError("a skippable frame is cut off")
            continue
        start = at
        record, at = _frame(dictionary, view, at)
        try:
            yield parse_record(record)
        except ValueError as e:
            raise ValueError(f"the record at byte {start}: {e}") from e


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, checked for version, needed headers, length and digest."""
    head, gap, rest = record.partition(_CRLF * 2)
    lines = head.split(_CRLF)
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and headers:  # goes on from the line before
            headers[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        name = name.strip().lower()
        headers[name] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ValueError(f"without {', '.join(sorted(missing))}")
    if not headers["content-length"].isdecimal():
        raise ValueError(f"Content-Length is {headers['content-length'][:80]!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != _CRLF * 2:
        raise ValueError(f"{len(rest) - 4} bytes where Content-Length says {length}")
    block = rest[:length]
    if _differs(headers.get("warc-block-digest"), block):
        raise ValueError("the block's digest differs")
    return headers, block


def _differs(digest: str | None, content: bytes) -> bool:
    """Whether a digest header is a SHA-1, in base 32 or 16, of something else; other digests are not looked into."""
    name, _, value = (digest or "").partition(":")
    return name.lower() == "sha1" and value.upper() not in (sha1_base32(content), hashlib.sha1(content).hexdigest().upper())


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block, less the HTTP header where the record holds an HTTP message."""
    if headers.get("content-type", "").lower().startswith("application/http"):
        return block.partition(_CRLF * 2)[2]
    return block


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: datetime = datetime(2024, 1, 1, tzinfo=timezone.utc)) -> DataFrame:
    """(archive binary, records long) rows that hold a record for every row of pages.

    Of rows with equal payloads of at least `least` bytes the one with the largest id is
    a response and the others revisit it; shorter ones are all responses. Rows that share
    that id and payload are the same page and all responses. A null payload is empty, a
    null url too, a null id is smaller than any. An empty table has no archives.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("same"))
    latest = rows.groupBy("same").agg(F.max("id").alias("latest"))
    stamp = date.strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            ids, urls, payloads, latests = batch.columns
            for i in range(batch.num_rows):
                page, last, body = ids[i].as_py(), latests[i].as_py(), payloads[i].as_py().encode()
                refers = None if page == last or len(body) < least else f"urn:page:{last}"
                url = urls[i].as_py().replace("\r", "%0D").replace("\n", "%0A")
                held.append(record_bytes(f"urn:page:{'' if page is None else page}", url, stamp, body, refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield _archive(held)
                    held, size = [], 0
        if held:
            yield _archive(held)

    return rows.join(latest, "same").select("id", "url", "payload", "latest").mapInArrow(run, "archive binary, records long")


def _archive(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pack_archive(records)], pa.binary()), pa.array([len(records)], pa.int64())], ["archive", "records"])


def read_archives(archives: DataFrame, content_col: str = "archive") -> DataFrame:
    """(record_id, record_type, url, payload_bytes, payload_digest, refers_to, block) of every record, of any type and writer.

    record_id and refers_to are the URIs without brackets; page_of turns those of
    write_archives into page ids. payload_bytes and payload_digest (bare, without the
    name of a SHA-1) are the full payload's. A revisit's come from its headers, and are
    null where it has none; other records' are counted from the block if no header says
    them. A record or a payload digest that is not valid, or an archive cut off, fails the
    job with a message that says where. Null archives hold nothing; an empty table gives
    no rows; repeated archives repeat their records. Only the content column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in read_records(content.as_py() or b""):
                    rows.append(_row(headers, block))
                    size += len(block)
                    if size > ARCHIVE_BYTES:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return archives.select(F.col(content_col).alias("content")).mapInArrow(run, "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, block binary")


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind, digest, length = headers["warc-type"], headers.get("warc-payload-digest"), headers.get("x-payload-length", "")
    size = int(length) if length.isdecimal() else None
    if kind != "revisit":
        payload = payload_of(headers, block)
        if kind in ("response", "resource") and _differs(digest, payload):
            raise ValueError(f"the payload's digest differs in {headers['warc-record-id']}")
        digest, size = digest or sha1_base32(payload), len(payload)
    refers = headers.get("warc-refers-to")
    return headers["warc-record-id"].strip("<>"), kind, headers.get("warc-target-uri"), size, digest and digest.removeprefix("sha1:"), refers and refers.strip("<>"), block


def page_of(uri: Column) -> Column:
    """The page id in a URI of write_archives; null for a page without one, and for other URIs."""
    number = F.regexp_extract(uri, r"^urn:page:(-?[0-9]+)$", 1)
    return F.when(number != "", number).cast("long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "block"])
