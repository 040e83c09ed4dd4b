from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meridia.llm import chat_format, sharding, warc
from meridia.llm.queries import QUERIES

RECORDS = [
    ({"messages": [{"role": "user", "content": "a</s>"}, {"role": "assistant", "content": "b\\[INST]"}], "id": 3}, "messages", [("user", "a</s>"), ("assistant", "b\\[INST]")]),
    ({"messages": [{"role": "user", "content": None}], "system": "be kind"}, "messages", [("system", "be kind"), ("user", "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "from_value", [("user", "hi"), ("assistant", "yo")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "response": "r", "turns": 9, "layout": "x"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "r"}, "prompt_completion", [("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": "<|end|>"}, "question_answer", [("user", "q"), ("assistant", "<|end|>")]),
    ({"messages": [{"role": "user", "content": "x"}], "input": "y", "meta": {"a": [{"b": 1}]}}, "messages", [("user", "x")]),
    ({"prompt": '{"question": "q", "answer": "a"}', "response": "[1]", "output": None}, "prompt_response", [("user", '{"question": "q", "answer": "a"}'), ("assistant", "[1]")]),
    ({"prompt": "p", "response": "r", "completion": "c"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"question": "q"}, None, []),
    ({}, None, []),
]


def test_layouts_are_told_by_their_paths(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, None), (91, "not json"), (92, "[1]")]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in chat_format.canonical_turns(df, "record", ["conv_id"]).collect()}
    assert got == {**{i: (layout, turns) for i, (_, layout, turns) in enumerate(RECORDS)}, 90: (None, []), 91: (None, []), 92: (None, [])}


def test_fingerprints_tell_nested_paths_apart(spark):
    records = [{"a": [{"b": 1}, {"c": {"d": "x"}}], "e": None}, {"a": [{"c": {"d": 2.5}}, {"b": "y"}]}, {"a": {"b": 1}}, {"a": '{"b": 1}'}, {"a": [[{"b": 1}]]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, None), (8, "x")], "conv_id long, record string")
    paths = {r.conv_id: r.p for r in df.select("conv_id", chat_format.nested_paths(F.col("record")).alias("p")).collect()}
    assert paths == {0: ["a", "a[].b", "a[].c", "a[].c.d"], 1: ["a", "a[].b", "a[].c", "a[].c.d"], 2: ["a", "a.b"], 3: ["a"], 4: ["a"], 7: [], 8: []}
    prints = {r.conv_id: r.fingerprint for r in chat_format.canonical_turns(df, "record", ["conv_id"]).collect()}
    assert prints[0] == prints[1] and prints[3] == prints[4] and len({prints[i] for i in (0, 2, 3, 7)}) == 4


def test_records_beyond_a_variant_keep_their_turns(spark):
    long_ = F.expr("repeat('0123456789abcdef', 9000000)")
    rows = spark.range(1).select(F.lit(1).alias("conv_id"), F.to_json(F.struct(F.lit("p").alias("prompt"), long_.alias("response"))).alias("record"))
    rows = rows.union(spark.range(1).select(F.lit(2), F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), long_.alias("content"))).alias("messages"), F.lit(1).alias("more")))))
    out = chat_format.canonical_turns(rows, "record", ["conv_id"])
    got = out.select("conv_id", "layout", F.transform("turns", lambda t: F.struct(t["role"], F.char_length(t["text"]))).alias("t")).collect()
    assert {r.conv_id: (r.layout, [tuple(x) for x in r.t]) for r in got} == {1: ("prompt_response", [("user", 1), ("assistant", 144_000_000)]), 2: ("messages", [("user", 144_000_000)])}


def test_paths_of_records_equal_those_of_variants(spark):
    known = [(i, json.dumps(r)) for i, (r, layout, _) in enumerate(RECORDS) if layout and "meta" not in r]
    df = spark.createDataFrame(known, "conv_id long, record string")
    record = F.from_json("record", chat_format.RECORD)
    got = df.select(chat_format._record_paths(record, F.col("record")).alias("a"), chat_format.nested_paths(F.col("record")).alias("b")).collect()
    assert got and all(r.a == r.b for r in got)


TEXTS = ["", "\\", "\\\\", "<|end|>", "<|en\\d|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>", "é\n\n<s>", "[[INST]]", "<<<SYS>>", "\\<s>", "$1", "<|turn|", "<<|end|>|end|>"]


def test_format_is_reversible(spark):
    turns = [[(r, t), ("assistant", t + u)] for t in TEXTS for u in TEXTS for r in ("user", "<|text|>\n")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "conv_id long, turns array<struct<role: string, text: string>>")
    out = chat_format.format_turns(df)
    rows = out.select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in rows:
        assert [tuple(t) for t in r.turns] == turns[r.conv_id]
        assert r.loss == turns[r.conv_id][1][1]
        assert r.formatted.count("<|end|>") == 2 and "</s>" not in r.formatted and "[INST]" not in r.formatted
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_conversations_of_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, None, None, "n"), (2, 5, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.canonical_turns(chat_format.conversation_records(df), "record", ["conv_id"])
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out.collect()} == {1: [("user", "x"), ("user", "x"), ("assistant", "")], None: [("", "n")], 2: [("", "")]}
    assert chat_format.conversation_records(df.where("false")).collect() == []


def test_chat_query_equals_brute_force(spark, sf_dir):
    conv = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        conv[r.conv_id].append((r.role, r.text or ""))
    conv[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {c: "".join(t for r, t in v if r == "assistant") for c, v in conv.items()}
    expected = {c: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), len(loss[c]), sha(loss[c])) for c, v in conv.items()}
    got = QUERIES["op6_chat_format"](spark, sf_dir).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected


@pytest.mark.parametrize("bucket", [3, 20_000])
def test_shards_match_the_mixture(docs, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    got = sharding.stratified_shards(docs, 7, seed=3).collect()
    assert len(got) == docs.count()
    rows = Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert rows == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    assert sorted(by_shard) == list(range(7))
    sizes = [len(v) for v in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    for v in by_shard.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    for source in {r.stratum for r in got}:
        each = [sum(r.stratum == source for r in v) for v in by_shard.values()]
        assert max(each) - min(each) <= 2
    order = lambda seed: [(r.shard, r.slot, r.doc_id) for r in sharding.stratified_shards(docs, 7, seed=seed).orderBy("shard", "slot").collect()]
    assert order(3) == order(3) != order(4)


def test_shards_of_few_rows(docs, empty):
    assert sharding.stratified_shards(empty, 5).collect() == []
    assert len(sharding.stratified_shards(docs.where("doc_id < 2"), 5).collect()) == 2


PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (5, "http://b/\r\nX: y", "<p>x</p>"), (3, "u", None), (4, "u", ""), (6, "é", "é" * 2000), (7, "v", "\r\n\r\nWARC/1.1"), (7, "v", "\r\n\r\nWARC/1.1"), (None, "w", "z")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "n") for p in PAGES], "page_id long, url string, html string, latest string").repartition(2)


@pytest.mark.parametrize("least", [0, 5, 10_000])
def test_archives_read_back(pages, least):
    got = warc.read_archives(warc.write_archives(pages, least=least))
    got = got.withColumns({c: warc.page_of(F.col(c)) for c in ("record_id", "refers_to")}).collect()
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max([x for x in (last.get(h or ""), i) if x is not None], default=None)
    expected = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        first = last[h or ""] == i or len(body) < least
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        expected.append((i, "response" if first else "revisit", len(body), digest, None if first else last[h or ""], body if first else b""))
    assert sorted(map(str, ((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.block)) for r in got))) == sorted(map(str, expected))


def test_archives_of_nothing(pages):
    assert warc.write_archives(pages.where("false")).collect() == []


def archive(n=30):
    return warc.pack_archive([warc.record_bytes(f"urn:page:{i}", "http://x/", "2024-01-01T00:00:00Z", b"<html>%d</html>" % i * 50, None) for i in range(n)])


def test_archive_has_its_dictionary_in_front_and_a_frame_a_record():
    import struct

    import zstandard

    data = archive()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert first.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n") and first.eof
    assert len(list(warc.read_records(data))) == 30


def test_raw_dictionaries_and_plain_archives_are_read():
    import struct

    import zstandard

    record = warc.record_bytes("urn:page:1", "u", "2024-01-01T00:00:00Z", b"abc", None)
    raw = b"WARC/1.1 WARC-Type: response Content-Length" * 4
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(record)
    for data in (struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw + frame, zstandard.ZstdCompressor().compress(record)):
        assert [b for _, b in warc.read_records(data)] == [b"abc"]


@pytest.mark.parametrize("cut", [3, 5, 40, -1, -20])
def test_cut_archives_are_refused(cut):
    data = archive()
    with pytest.raises(ValueError):
        list(warc.read_records(data[:cut] if cut > 0 else data[: len(data) + cut]))


def test_wrong_records_are_refused():
    good = warc.record_bytes("urn:page:1", "u", "2024-01-01T00:00:00Z", b"abc", None)
    assert warc.parse_record(good)[1] == b"abc"
    for bad in (good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"WARC/1.1", b"XARC/1.1"), good.replace(b"\r\nabc", b"\r\nabd"), good.replace(b"WARC-Date", b"WARC-Dote"), good[:-1], b""):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def foreign(kind, headers, block):
    head = [f"WARC-Type: {kind}", "WARC-Date: 2020-02-02T02:02:02Z", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.0", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark):
    import struct

    import zstandard

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello</p>"
    hexa = hashlib.sha1(b"<p>hello</p>").hexdigest()
    records = [
        foreign("warcinfo", ["WARC-Record-ID: <urn:uuid:0>", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        foreign("response", ["WARC-Record-ID: <urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8>", "WARC-Target-URI: http://x/", "Content-Type: application/http;", " msgtype=response", f"WARC-Payload-Digest: sha1:{hexa}"], http),
        foreign("request", ["WARC-Record-ID: <urn:uuid:2>", "Content-Type: application/http", "WARC-Block-Digest: md5:00"], b"GET / HTTP/1.1\r\n\r\n"),
        foreign("revisit", ["WARC-Record-ID: <urn:uuid:3>", "WARC-Refers-To: <urn:uuid:1>"], b""),
    ]
    pack = zstandard.ZstdCompressor().compress
    data = pack(records[0]) + struct.pack("<II", 0x184D2A50, 5) + b"12345" + b"".join(map(pack, records[1:]))
    got = warc.read_archives(spark.createDataFrame([(bytearray(data),), (None,)], "archive binary")).collect()
    assert [(r.record_type, r.record_id, r.payload_bytes, r.refers_to) for r in got] == [
        ("warcinfo", "urn:uuid:0", 13, None),
        ("response", "urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8", 12, None),
        ("request", "urn:uuid:2", 0, None),
        ("revisit", "urn:uuid:3", None, "urn:uuid:1"),
    ]
    assert got[1].payload_digest == hexa and got[2].payload_digest == warc.sha1_base32(b"") and got[3].payload_digest is None
    with pytest.raises(ValueError, match="byte 0: Content-Length"):
        list(warc.read_records(pack(records[3].replace(b"Content-Length: 0", b"Content-Length: x"))))


def test_large_archives_are_read_in_linear_time():
    import time

    block = bytes(range(256)) * 40

    def seconds(n):
        data = warc.pack_archive([warc.record_bytes(f"urn:page:{i}", "u", "2024-01-01T00:00:00Z", i.to_bytes(4, "little") + hashlib.sha256(b"%d" % i).digest() * 60 + block, None) for i in range(n)])
        start = time.perf_counter()
        assert sum(1 for _ in warc.read_records(data)) == n
        return time.perf_counter() - start

    seconds(200)
    assert seconds(16_000) < 16 * 4 * max(seconds(1000), 0.02)


def test_warc_query_equals_brute_force(spark, sf_dir):
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    last = {}
    for i, body in rows:
        last[body] = max(i, last.get(body, i))
    expected = sorted((i, len(b), warc.sha1_base32(b), *(("response", "") if last[b] == i else ("revisit", last[b]))) for i, b in rows)
    got = QUERIES["op8_warc"](spark, sf_dir).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, "" if r.refers_to is None else r.refers_to) for r in got) == expected


def test_archive_query_with_equal_payloads(spark, tmp_path):
    """A table of pages with repeated, empty and null payloads: of equal ones the largest id is the response."""
    html = [None, "", "<p>a</p>", "<p>b</p>", "<p>a</p>", "é" * 2000, "<p>a</p>", "é" * 2000]
    rows = [(i, f"http://x.com/{i}", h) for i, h in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    payload = [(h or "").encode() for h in html]
    expected = {}
    for i, p in enumerate(payload):
        latest = max(j for j, q in enumerate(payload) if q == p)
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        expected[i] = (len(p), digest, "response" if latest == i else "revisit", None if latest == i else latest)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op8_warc"](spark, str(tmp_path)).collect()}
    assert got == expected


def test_sharding_equals_brute_force(spark, sf_dir):
    """Of the fractional ranks, as the operator gives them: shards cut their order into near equal counts, slots are gapless."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_sharding"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots, mixture = defaultdict(list), defaultdict(Counter)
    for r in rows:
        text = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
        slots[r.shard].append(r.slot)
        mixture[r.shard][docs[r.doc_id].source] += 1
    counts = [len(slots[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = Counter(d.source for d in docs.values())
    for source, n in total.items():  # interleaved by fractional rank, a source's rows in a shard differ from its share by few
        assert all(abs(mixture[s][source] - n * counts[s] / len(docs)) <= 1 + len(total) for s in range(40))
