"""The tables seen as measurements, tracks, points and pairs; each view also as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.plans import rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steady(value: Column | str, digits: int) -> Column:
    """value rounded, borders first moved by a thousandth of the last digit: means of short decimals lie on borders, and sums differ in their last bits with the order of rows."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 10.0 ** -(digits + 3), digits)


def measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, group, case_id, metric, t, value, event_id) from events; 30 days span 60 units of t."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = e.agg(F.min("us")).first()[0] or 0
    model = F.col("user_id") % 27
    return e.select(
        model.alias("model"),
        F.when(model % 3 == 0, "ti2v").otherwise("world").alias("group"),
        F.col("user_id").alias("case_id"),
        F.col("event_type").alias("metric"),
        ((F.col("us") - first) / 43200000000.0).alias("t"),
        "value",
        "event_id",
    )


MEASUREMENT = """measurement AS (
  SELECT user_id % 27 AS model, CASE WHEN (user_id % 27) % 3 = 0 THEN 'ti2v' ELSE 'world' END AS "group", user_id AS case_id,
         event_type AS metric, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 43200000000.0 AS t, value, event_id
  FROM events)"""


def measurement_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """measurement with nulls where event_id % 17 = 0, NaN where % 19 = 0 and rows gone where % 29 = 0."""
    m = measurement(spark, sf_dir).where("event_id % 29 <> 0")
    return m.withColumn("value", F.when(F.col("event_id") % 17 == 0, F.lit(None)).when(F.col("event_id") % 19 == 0, float("nan")).otherwise(F.col("value")))


MISSING = MEASUREMENT + """, measurement_missing AS (
  SELECT * REPLACE (CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN NULL ELSE value END AS value) FROM measurement WHERE event_id % 29 <> 0)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, frame_index, t, x, y, z, yaw): each user's events in order as a sparse track."""
    m = measurement(spark, sf_dir)
    index = F.floor(F.col("t") * 16).cast("long")
    return m.groupBy("case_id", index.alias("frame_index")).agg(
        F.min("t").alias("t"), F.avg("value").alias("x"), F.max("value").alias("y"), F.min("value").alias("z"), ((F.sum("event_id") % 360) - 180).cast("double").alias("yaw")
    )


FRAMES = MEASUREMENT + """, frames AS (
  SELECT case_id, CAST(floor(t * 16) AS BIGINT) AS frame_index, min(t) AS t, avg(value) AS x, max(value) AS y, min(value) AS z, CAST(sum(event_id) % 360 - 180 AS DOUBLE) AS yaw
  FROM measurement GROUP BY ALL)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, x, y, z, l_orderkey, l_linenumber): lineitem as a point cloud; -0.0 becomes 0.0."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 10).alias("part"), F.col("l_quantity").alias("x"), (F.round(F.col("l_discount") * 100, 6) + 0.0).alias("y"), (F.round(F.col("l_tax") * 100, 6) + 0.0).alias("z"), "l_orderkey", "l_linenumber"
    )


POINTS = """points AS (
  SELECT l_partkey % 10 AS part, l_quantity AS x, round(l_discount * 100, 6) + 0.0 AS y, round(l_tax * 100, 6) + 0.0 AS z, l_orderkey, l_linenumber FROM lineitem)"""


def leaf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, group, case_id, leaf, value): 37 leaves a case, spread over each rule's range, with gaps."""
    base = measurement(spark, sf_dir).groupBy("model", "group", "case_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))
    items = []
    for k, (leaf, _, _, mode, lo, hi, _) in enumerate(rules.RULES):
        lo, hi = (0.0, 1.0) if mode == "unit" else (lo, hi)
        share = ((F.col("s") + 7919 * (k + 1)) % 1009) / 1009.0 * 1.2 - 0.1
        value = F.when((F.col("case_id") + k) % 97 == 0, F.lit(None)).otherwise(lo + (hi - lo) * share)
        items.append(F.struct(F.lit(leaf).alias("leaf"), value.cast("double").alias("value")))
    return base.select("model", "group", "case_id", F.explode(F.array(*items)).alias("e")).select("model", "group", "case_id", "e.*")


_RULE_ROWS = ", ".join(f"({k}, '{leaf}', '{mode}', {0.0 if lo is None else lo!r}, {1.0 if hi is None else hi!r}, {d})" for k, (leaf, _, _, mode, lo, hi, d) in enumerate(rules.RULES))
LEAVES = MEASUREMENT + f""", rule(k, leaf, mode, lo, hi, direction) AS (VALUES {_RULE_ROWS}),
base AS (SELECT model, "group", case_id, sum(event_id) AS s FROM measurement GROUP BY ALL),
leaf_values AS (
  SELECT model, "group", case_id, leaf, mode, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, direction,
         CASE WHEN (case_id + k) % 97 = 0 THEN NULL ELSE CAST(lo AS DOUBLE) + (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) * (((s + 7919 * (k + 1)) % 1009) / CAST(1009 AS DOUBLE) * CAST(1.2 AS DOUBLE) - CAST(0.1 AS DOUBLE)) END AS value
  FROM base, rule),
leaf_scores AS (
  SELECT *, CASE WHEN mode = 'unit' THEN 100 * greatest(0, least(1, value))
                 WHEN direction = 1 THEN 100 * greatest(0, least(1, (value - lo) / (hi - lo)))
                 ELSE 100 * (1 - greatest(0, least(1, (value - lo) / (hi - lo)))) END AS raw_score FROM leaf_values),
scored AS (SELECT *, CASE WHEN value IS NULL THEN NULL ELSE raw_score END AS score FROM leaf_scores)"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
