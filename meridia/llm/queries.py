"""The queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import bpe, chat_format, decontaminate, importance_sampling, jaccard_join, language_id, periodic_runs, quality_rules, secret_scan, sharding, substring_dedup, url_filter, warc
from meridia.llm._shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"), k=3, threshold=(90, 100))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(_joined(of("assign", "access", "hex")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(_table(spark, sf_dir, "documents"), shards=40, seed=42)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.fit(quality_rules.labelled_statistics(docs, _table(spark, sf_dir, "labels")))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return quality_rules.judge(docs, rules).select(*columns)


def _learnable() -> Column:
    """Rows that the language model may learn from; the others are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(_learnable()))
    return language_id.identify(docs, model, carry={"doc_id": F.col("doc_id"), "held_out": F.coalesce(~_learnable(), F.lit(False))})


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(json.dumps({"conversations": [{"from": "human", "value": control}, {"from": "gpt", "value": control}]})).alias("record"))
    records = chat_format.conversation_records(_table(spark, sf_dir, "conversations")).unionByName(more)
    formatted = chat_format.format_turns(chat_format.canonical_turns(records, "record", ["conv_id"]))
    back = formatted.select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.tokenize(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(warc.write_archives(_table(spark, sf_dir, "pages")), "archives")
    page = lambda c: warc.page_of(F.col(c))
    return warc.read_archives(archives).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), window=35)


#: The rules of op11, and the words of its labelled URLs: hosts of gambling, advertising, adult and fraud sites, and ordinary ones.
URL_RULES = [
    url_filter.Rule("allow", "com"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
BLOCKED_WORDS = "casino poker bets betting slots jackpot roulette lottery ads adserver track tracker clicks popup banner xxx porn adult escort pills viagra loans payday warez crack torrent replica spam".split()
ALLOWED_WORDS = "news blog docs wiki library school city garden music science weather travel health history museum forum shop mail maps photo recipes sports theatre university council river bridge letters nation station other thing there with another ration tension handle table".split()
_ENDS = ("com", "net", "org")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, block): a small labelled table, three URLs a word, as no given table has labels of URLs."""
    shapes = ("https://{w}-{n}.site.{end}/{lang}/{n}00", "http://www.{w}.{end}/{lang}/{n}.html", "https://best-{w}.online.{end}/{n}/{lang}/?id={n}")
    plain = ("https://{w}.site.{end}/{lang}/{n}00", "http://www.{w}{w}.{end}/{lang}/{n}.html", "https://m.my{w}.online.{end}/{n}/{lang}/?id={n}")
    rows = []
    for block, words, forms in ((1, BLOCKED_WORDS, shapes), (0, ALLOWED_WORDS, plain)):
        rows += [(f.format(w=w, n=11 + i, end=_ENDS[(i + j) % 3], lang=("en", "de", "fr", "es")[(i + j) % 4]), block) for i, w in enumerate(words) for j, f in enumerate(forms)]
    return spark.createDataFrame(rows, "url string, block int")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(labelled_urls(spark))
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES, model, carry={"page_id": F.col("page_id")})


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sampling.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), buckets=10_000, most=1, share=(10, 100), least=20, seed=2024)


def with_planted_periods(text: Column, id_: Column) -> Column:
    """The texts of op13: where crc32 of the id is a multiple of 10, the words from some place on repeat with some period."""
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        body = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(body, times)), F.lit(1), (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    # transform() over a list of one binds the words, so that they are split once.
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.transform(F.array(words), repeated)[0]).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", with_planted_periods(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.periodic_runs(docs, carry={"doc_id": F.col("doc_id")}, least=12)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    shown = found.withColumn("longest", longest)
    return shown.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.l")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("(-1000 * longest.l) div longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_sharding": op3_sharding,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_chat_format": op6_chat_format,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_url_filter": op11_url_filter,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}

#: CRC-32 is computed here for each distinct word, a byte a round, from a table that a recursion makes.
_OP12_SQL = r"""
WITH RECURSIVE
bits(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS row, doc_id AS id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
listed AS (
  SELECT kind, row, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts),
words AS (SELECT kind, row, unnest(ws) AS w FROM listed),
step(w, h, pos, c) AS (
  SELECT w, hex(encode(w)), 0, 4294967295::BIGINT FROM (SELECT DISTINCT w FROM words)
  UNION ALL
  SELECT w, h, pos + 1, xor((SELECT t FROM crc)[1 + (xor(c, ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT) & 255)], c >> 8)
  FROM step WHERE 2 * pos < length(h)),
bucketed AS (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM step WHERE 2 * pos = length(h)),
counts AS (SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM words JOIN bucketed USING (w) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM words JOIN bucketed USING (w) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row),
scored AS (
  SELECT id, row, len(ws) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM listed LEFT JOIN weights USING (row) WHERE kind = 0),
placed AS (
  SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, id NULLS LAST, row) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT id AS doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""

ORACLE = {"op12_importance_resampling": _OP12_SQL}
