"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; the rank over the
source's count is a fraction between 0 and 1. Sorted by that fraction the sources
interleave in proportion, and cuts at equal counts give shards with the mixture of the
whole. Ranks come from counts of small hash buckets, so no source, however large, and
not the whole table either, is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one ranking task sorts, or so.
BUCKET_ROWS = 20_000


def _ranked(df: DataFrame, groups: list[str], bucket: str, order: list[Column], rank: str) -> DataFrame:
    """df with each row's 0-based place in its group, by bucket and order: counts of the buckets
    before it, which are few, and its place in its bucket."""
    counts = df.groupBy(*groups, bucket).agg(F.count("*").alias("in_bucket"))
    if groups:
        before = F.sum("in_bucket").over(Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.select(*groups, bucket, F.coalesce(before, F.lit(0)).alias("offset"))
    else:
        high = counts.withColumn("high", F.shiftright(bucket, 10))
        outer = high.groupBy("high").agg(F.sum("in_bucket").alias("rows"))
        outer = outer.select("high", F.coalesce(F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("high").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer_offset"))
        inner = F.sum("in_bucket").over(Window.partitionBy("high").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
        offsets = high.withColumn("inner_offset", F.coalesce(inner, F.lit(0))).join(outer, "high").select(bucket, (F.col("inner_offset") + F.col("outer_offset")).alias("offset"))
    place = F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order)) - 1
    return df.withColumn("place", place).join(offsets, [*groups, bucket]).withColumn(rank, F.col("place") + F.col("offset")).drop("place", "offset")


def stratified_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row; law is `rows`.

    Shard counts differ by one row at most, and each source's rows are spread over the
    shards in proportion. slot is the place in the shard, from 0, without gaps. size is
    the text's UTF-8 bytes plus 16, null texts counting none; text_crc32 of a null text
    is that of the empty one. A null source is a source of its own. The order follows
    the seed, id and text only; repeated rows, which those do not tell apart, take
    neighbouring places. grown_shard is null. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(source_col).isNull().alias("no_source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(text.cast("binary"))).alias("shuffled"),
    ).withColumn("bucket", F.pmod(F.shiftright("shuffled", 20), F.lit(buckets)))
    sources = rows.groupBy("source", "no_source").agg(F.count("*").alias("in_source"))
    ties = [F.col("shuffled"), F.col("id"), F.col("text_crc32"), F.col("size")]
    ranked = _ranked(rows, ["source", "no_source"], "bucket", ties, "rank").join(sources, ["source", "no_source"])
    fraction = (F.col("rank") + 0.5) / F.col("in_source")
    placed = ranked.withColumn("fraction", fraction).withColumn("bucket", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    ordered = _ranked(placed, [], "bucket", [F.col("fraction"), F.col("source"), F.col("no_source"), *ties], "position")
    # Shard s holds the positions from ceil(s * total / shards) to before ceil((s + 1) * total / shards).
    shard = F.expr(f"(position * {shards}L) div {max(1, total)}L")
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ordered.withColumn("shard", shard).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("source").alias("stratum"),
    )
