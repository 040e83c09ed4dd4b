"""Queries of image patches: embeddings, 25 at a time, as images of five by five patches, each against the next image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import patches
from meridia.plans.fixtures import descriptors, steady, table
from meridia.plans.registry import query

_GRID = """g AS (SELECT vec_id // 25 AS image, vec_id % 25 // 5 AS r, vec_id % 5 AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
_COSINE = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("vec_id")
    grid = descriptors(spark, sf_dir).select(F.floor(k / 25).alias("image"), F.floor(k % 25 / 5).cast("int").alias("row"), (k % 5).cast("int").alias("col"), "embedding")
    return grid, grid.withColumn("image", F.col("image") - 1)


@query(
    "patch_similarity",
    f"""WITH {_GRID}, best AS (SELECT a.image, a.r, a.c, max({_COSINE.format("a.v", "b.v")}) AS s FROM g a JOIN g b ON b.image = a.image + 1 AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL)
    SELECT image, count(*) AS patches, round(avg(s) + 1e-9, 6) AS similarity FROM best GROUP BY image""",
)
def patch_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image against the next, with a patch of tolerance."""
    return patches.local_similarity(*_images(spark, sf_dir), ["image"], "embedding").withColumn("similarity", steady("similarity", 6))


@query(
    "matched_patches",
    f"""WITH {_GRID}, n AS (SELECT CAST(max(vec_id) // 25 AS BIGINT) AS n FROM embeddings),
    pair AS (SELECT DISTINCT l_partkey % n AS image, l_orderkey % 60 * 5 // 60 AS r, l_suppkey % 80 * 5 // 80 AS c, CAST(l_quantity AS INT) * 5 // 60 AS r2, l_linenumber * 9 * 5 // 80 AS c2 FROM lineitem, n WHERE n > 0),
    told AS (SELECT pair.*, {_COSINE.format("a.v", "b.v")} AS s FROM pair JOIN g a ON a.image = pair.image AND a.r = pair.r AND a.c = pair.c JOIN g b ON b.image = pair.image + 1 AND b.r = r2 AND b.c = c2)
    SELECT image, count(*) AS pairs, round(avg(s) + 1e-9, 6) AS similarity, count(DISTINCT (r, c)) AS source_patches, count(DISTINCT (r2, c2)) AS target_patches, count(DISTINCT (r, c)) / 25 AS source_coverage, count(DISTINCT (r2, c2)) / 25 AS target_coverage
    FROM told GROUP BY image""",
)
def matched_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as corresponding pixels of an image and the next one, both of 60 x 80 pixels."""
    source, target = _images(spark, sf_dir)
    last = source.agg(F.max("image").alias("n"))
    items = table(spark, sf_dir, "lineitem").join(F.broadcast(last), F.lit(True)).where("n > 0")
    pairs = items.select((F.col("l_partkey") % F.col("n")).alias("image"), (F.col("l_orderkey") % 60).alias("source_row"), (F.col("l_suppkey") % 80).alias("source_col"), F.col("l_quantity").cast("int").alias("target_row"), (F.col("l_linenumber") * 9).alias("target_col"))
    size = F.struct(*[F.lit(v).alias(n) for n, v in (("height", 60), ("width", 80), ("rows", 5), ("cols", 5))])
    sizes = source.select("image").distinct().select("image", size.alias("source"), size.alias("target"))
    return patches.matched_similarity(pairs, source, target, sizes, ["image"], "embedding").withColumn("similarity", steady("similarity", 6))


@query(
    "triangle_votes",
    """WITH v AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 > 0 THEN p_size % 5 ELSE 0 END AS o FROM part)
    SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(a.o, 0) <> coalesce(b.o, 0) AND coalesce(b.o, 0) = coalesce(c.o, 0) THEN coalesce(b.o, 0) ELSE coalesce(a.o, 0) END AS object
    FROM lineitem LEFT JOIN v a ON a.k = l_partkey LEFT JOIN v b ON b.k = l_partkey + 1 LEFT JOIN v c ON c.k = l_partkey + 2""",
)
def triangle_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as triangles of three parts in a row, which are part of an object by their size."""
    vertices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vertex"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 5).alias("object"))
    k = F.col("l_partkey")
    triangles = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.alias("a"), (k + 1).alias("b"), (k + 2).alias("c"))
    return patches.triangle_objects(triangles, vertices, [], "vertex", "a", "b", "c").drop("a", "b", "c")
