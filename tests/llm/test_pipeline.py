from __future__ import annotations

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from meridia.llm import bpe, language_id, secret_scan
from meridia.llm.queries import QUERIES
from tests.llm.test_pairs_and_windows import components_by_force, shingle_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "tokens"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows that go into and come out of each stage, on the smallest tables and odd rows besides."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = [(None, "Thanthe ereinth of anthe and onthe inth erthe", "en", "x", 1), (900_001, None, None, None, None), (900_002, "", "en", None, 0), (900_003, "12 34 !", "en", "x", 7), tuple(first), (900_004, first.text + " ", first.lang, "x", 5)]
    df = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        rows = df.collect()
        df = spark.createDataFrame((out := stage(spark, df, sf_dir)).collect(), out.schema)
        seen.append((name, rows, df))
    return {name: (rows, out) for name, rows, out in seen}


def test_language_stage_drops_texts_without_letters_only(stages):
    before, out = stages["language_id"]
    kept = out.collect()
    gone = {r.doc_id for r in before} - {r.doc_id for r in kept}
    assert gone == {900_001, 900_002, 900_003}
    assert out.columns == COLUMNS and set(kept) <= set(before)


def test_duplicate_stage_equals_brute_force(stages):
    before, out = stages["near_duplicates"]
    rows = sorted(set(before), key=lambda r: (r.doc_id is None, r.doc_id or 0))  # the kept one of a group is its first
    groups = components_by_force([(i, r.text) for i, r in enumerate(rows)], 5, 4, 5)
    expected = {r for i, r in enumerate(rows) if groups[i][1] == i}
    kept = out.collect()
    assert out.columns == COLUMNS and len(kept) == len(expected) and set(kept) == expected
    assert len(kept) < len(before)


def test_duplicate_stage_tells_rows_apart(spark):
    text, clean = " ".join(f"word{i}" for i in range(40)), " ".join(f"other{i}" for i in range(40))
    rows = [(None, text, "a", "s", 1), (None, text, "b", "s", 1), (7, text + " end", "a", "s", 1), (7, clean, "a", "s", 1), (9, None, None, None, None), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[2], rows[3], rows[4]], key=str)


def test_leak_stage_equals_brute_force(stages, spark, sf_dir):
    items = [shingle_set(r.text, 5) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, out = stages["decontamination"]
    leaks = lambda text: any(s and 5 * len(s & have) >= 4 * len(s) for have in [shingle_set(text, 5)] for s in items)
    expected = {r for r in before if not leaks(r.text)}
    assert set(out.collect()) == expected and len(expected) < len(before)


def test_secret_stage_leaves_no_base_secret(stages):
    before, out = stages["secrets"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(before) and out.columns == COLUMNS
    for r in before:
        after = rows[r.doc_id]
        assert secret_scan.base_spans(after.text) == [] and after.n_chars == len(after.text)
        spans = secret_scan.base_spans(r.text)
        if not spans and "[SECRET" not in after.text:
            assert after.text == r.text
    assert any("[SECRET:" in r.text for r in rows.values())


def test_token_stage_equals_the_library(stages):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    before, out = stages["tokens"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(before)
    for r in before:
        ids = bytes(got[r.doc_id].ids)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == encoding.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids) // 4


def test_run_gives_the_last_stage(spark, sf_dir):
    df = corpus_pipeline.run(spark, sf_dir)
    assert df.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and df.count() > 0


def test_language_query_on_held_out_rows(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op5_language_id"](spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and held
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_model_does_not_see_held_out_rows(spark, sf_dir):
    """Held-out texts changed in every way leave the fitted filter as it is."""
    from pyspark.sql import functions as F

    from meridia.llm.queries import _learnable

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spoilt = docs.withColumn("text", F.when(_learnable(), F.col("text")).otherwise("zzzz qqqq"))
    a, b = (language_id.fit(d.where(_learnable())) for d in (docs, spoilt))
    assert a.languages == b.languages and all((x == y).all() for x, y in zip(a.words, b.words, strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_read_whole_tables(spark, sf_dir, name):
    if name == "op9_decontamination":
        pytest.skip("its rows are leaks")
    table, extra = {"op6_chat_format": ("conversations", 1), "op8_warc": ("pages", 0), "op11_url_filter": ("pages", 0)}.get(name, ("documents", 0))
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    n = rows.select("conv_id").distinct().count() if name == "op6_chat_format" else rows.count()
    assert QUERIES[name](spark, sf_dir).count() == n + extra
