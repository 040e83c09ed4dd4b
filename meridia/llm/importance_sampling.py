"""Importance resampling towards a target distribution of hashed n-grams.

Both tables' n-grams are exploded and counted in buckets of their CRC-32; a bucket's gain
is the logarithm of how much more of the target falls into it. A document's weight is the
sum of the gains of its n-grams, noise of a Gumbel distribution makes the draw a sample
without replacement, and the documents are sorted in ranges across the cluster: a rank is
a row's place in its range after the counts of the ranges before it.

Everything is DataFrame functions; of the tables only a row a range reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm._shared import written

#: The bound on the gain table, which every executor gets: rows of 16 bytes, one a bucket.
MOST_BUCKETS = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ngrams(text: Column, most: int = 1) -> Column:
    """The runs of 1 to `most` consecutive words, joined by one space, repeats included; null texts have none.

    A-Z are lower-cased; words are stretches of a-z, 0-9 and characters beyond ASCII.
    """
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), lambda w: w != "")
    if most == 1:
        return words
    # The outer transform binds the words once; inside, every n-gram is a slice of them.
    run = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(w, *[run(w, F.lit(n)) for n in range(2, most + 1)])))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.crc32(gram.cast("binary")) % F.lit(buckets)


def _counted(texts: DataFrame, buckets: int, most: int, name: str) -> DataFrame:
    return texts.select(F.explode(ngrams(F.col("text"), most)).alias("gram")).groupBy(_bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = 10_000, most: int = 1, scale: int = 1000) -> DataFrame:
    """(bucket, gain): floor(scale * ln of the smoothed share of the target over that of docs), one row for each bucket.

    Counts cover all rows of both tables. A bucket that neither has gets its gain too;
    with both tables empty all gains are 0.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets are possible, not {buckets}")
    rows = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for source, column, name in ((docs, text_col, "s"), (target, target_col, "t")):
        rows = rows.join(_counted(source.select(F.col(column).alias("text")), buckets, most, name), "bucket", "left").fillna(0, [name])
    totals = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    over = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return rows.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(float(scale)) * F.log(over)).alias("gain"))


def gumbel(id_: Column, seed: str | int, scale: int = 1000) -> Column:
    """Noise of a document: of the first 32 bits of sha256(`seed:id`), taken as a share of 1, floor(-scale * ln(-ln(share)))."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, gains: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, most: int = 1) -> DataFrame:
    """(id, row, n_features, weight) of each row: how many n-grams, and the sum of their gains (none: 0).

    `row` tells rows apart within the table, repeated ones too. gains has a row for each
    bucket, so its size is bounded by MOST_BUCKETS and it is broadcast. A task adds up its
    own documents before they are shuffled, a row each.
    """
    # The row number comes first and on its own: beside explode it would number the n-grams.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    grams = rows.select("id", "row", F.explode_outer(ngrams(F.col("text"), most)).alias("gram"))
    scored = grams.select("id", "row", _bucket(F.col("gram"), buckets).alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    return scored.groupBy("row", "id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight")).select("id", "row", "n_features", "weight")


def ranked(rows: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, in the order of `by`, which should be total; equal rows take the places in any order.

    The rows are sorted in ranges and written; the counts of the ranges, a row each, give
    the offsets.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(rows.orderBy(*by).select("*", F.spark_partition_id().alias("__range"), inside.alias("__place")), "ranges")
    before, offsets = 0, []
    for r in placed.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        offsets.append((r["__range"], before))
        before += r.n
    table = rows.sparkSession.createDataFrame(offsets, "__range int, __offset long")
    return placed.join(F.broadcast(table), "__range").withColumn(name, F.col("__offset") + F.col("__place") + 1).drop("__range", "__place", "__offset")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = 10_000,
    most: int = 1,
    share: tuple[int, int] = (10, 100),
    least: int = 20,
    seed: str | int = 2024,
    scale: int = 1000,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of docs.

    Of the N documents with `least` words or more, the floor(N * share) with the highest
    scores are drawn, ties to the smaller id; rank counts them from 1 and is null for the
    others. weight is the sum of the gains of a document's n-grams, score adds the noise
    of its id. n_features counts its n-grams, repeats included. Null and empty texts,
    and texts without words, have 0 features and weight 0 and are not drawn. A null id
    has the noise of an empty one and comes last among ties. Repeated rows are rows of
    their own. An empty target leaves the smoothed shares of docs alone; empty docs give no
    rows. Only the id and text columns are read, so other columns cannot clash.
    """
    gains = written(bucket_gains(docs, target, text_col, target_col, buckets, most, scale), "gains")
    weighed = weigh(docs, gains, id_col, text_col, buckets, most)
    words = F.col("n_features") if most == 1 else _words_of(F.col("n_features"), most)
    scored = weighed.select("*", (F.col("weight") + gumbel(F.col("id"), seed, scale)).alias("score"), (words >= least).alias("__fits"))
    order = [F.desc("__fits"), F.desc("score"), F.col("id").asc_nulls_last(), F.col("row")]
    table = ranked(scored, order)
    drawn = table.agg(F.floor(F.count_if("__fits") * F.lit(share[0]) / F.lit(share[1])).alias("__drawn"))
    drawn_rank = F.when(F.col("__fits") & (F.col("rank") <= F.col("__drawn")), F.col("rank"))
    return table.crossJoin(F.broadcast(drawn)).select(F.col("id").alias(id_col), "n_features", "weight", "score", drawn_rank.alias("rank"))


def _words_of(n_features: Column, most: int) -> Column:
    """The number of words that a text with so many n-grams of 1 to `most` words has."""
    # With n >= most words there are most * n - most * (most - 1) / 2 n-grams, with fewer n * (n + 1) / 2.
    few = F.floor((F.sqrt(8.0 * n_features + 1.0) - 1.0) / 2.0)
    return F.when(n_features <= most * (most + 1) // 2, few).otherwise(F.floor((n_features + most * (most - 1) // 2) / F.lit(most)))
