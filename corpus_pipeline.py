"""A corpus pipeline over documents: language, near duplicates, test leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import bpe, decontaminate, jaccard_join, language_id, secret_scan
from meridia.llm._shared import written


#: Rows of a batch that goes to Python: texts are long, and Spark's own 10,000 of them take tens of MB in every task.
BATCH_ROWS = 1_000


def _in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or with a score under 0.3 in every language of the corpus."""
    _in_small_batches(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near copies (5 words, 0.8) the document with the smallest id; one without an id only where none has one.

    Rows are told apart by a hash of all their columns, so that rows without an id, or of
    one id, are documents of their own. Repeated rows, equal in every column, become one.
    """
    _in_small_batches(spark)
    columns = docs.columns
    row = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]).alias("row")
    groups = written(jaccard_join.jaccard_components(docs.select(row, "text"), id_col="row", k=5, threshold=(4, 5)), "groups")
    if not groups.groupBy("row").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates()
    several = groups.where("component_id <> row").select("component_id").distinct()
    members = groups.join(several, "component_id").distinct().join(docs.select(row, "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    members = written(members.select("row", "component_id", "doc_id"), "members")
    kept = members.groupBy("component_id").agg(first).select("component_id", F.col("first.row").alias("kept"))
    copies = written(members.join(kept, "component_id").where("row <> kept").select(F.col("row").alias("copy")), "copies")
    return docs.join(copies, row == F.col("copy"), "left_anti").select(*columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold four fifths of a test item's shingles."""
    _in_small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; n_chars follows."""
    _in_small_batches(spark)
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids as little-endian 32-bit integers, and what they decode to."""
    _in_small_batches(spark)
    ids = bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, piece_bytes=10 << 20)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

#: Signature trees, compression and merges have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
