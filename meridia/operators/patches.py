"""Descriptors of image patches compared: with tolerance for small shifts, and where geometry says that they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.vectors import cosine


def covered(mask: DataFrame, keys: list[str], height: int, width: int, rows: int, cols: int) -> DataFrame:
    """(keys, row, col): the patches of a grid of rows x cols that hold a pixel of a mask, of images height x width."""
    part = lambda at, n, size: F.floor(((F.col(at) + 1) * n - 1) / size).cast("int").alias(at)
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return mask.where(inside).select(*keys, part("row", rows, height), part("col", cols, width)).distinct()


def local_similarity(left: DataFrame, right: DataFrame, keys: list[str], vector: str, selected: DataFrame | None = None, radius: int = 1) -> DataFrame:
    """(keys, patches, similarity): the mean, over patches of the left image, of the best cosine among the right patches within radius rows and columns.

    Both have (keys, row, col, vector), a row a patch; selected keeps the left patches that it
    lists (keys, row, col). Patches without any right one near them don't count; a key
    without patches that count has no row. A null vector matches nothing.
    """
    left = left.where(F.col(vector).isNotNull())
    left = left if selected is None else left.join(selected.select(*keys, "row", "col").distinct(), [*keys, "row", "col"], "left_semi")
    near = lambda at: F.explode(F.sequence(F.col(at) - radius, F.col(at) + radius))
    asked = left.select(*keys, "row", "col", F.col(vector).alias("_a")).withColumn("_row", near("row")).withColumn("_col", near("col"))
    there = right.where(F.col(vector).isNotNull()).select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(vector).alias("_b"))
    best = asked.join(there, [*keys, "_row", "_col"]).groupBy(*keys, "row", "col").agg(F.max(cosine(F.col("_a"), F.col("_b"))).alias("_best"))
    return best.groupBy(*keys).agg(F.count("*").alias("patches"), F.avg("_best").alias("similarity"))


def patch_of(at: Column, size: Column, patches: Column) -> Column:
    """The patch of a grid that a pixel row or column lies in."""
    return F.least(F.floor(at * patches / size), patches - 1).cast("int")


def matched_similarity(pairs: DataFrame, source: DataFrame, target: DataFrame, sizes: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, pairs, similarity, source_patches, target_patches, source_coverage, target_coverage) of patches that corresponding pixels lie in.

    pairs has (keys, source_row, source_col, target_row, target_col) in pixels; source and
    target have (keys, row, col, vector), a row a patch; sizes has one row a key with
    structs source and target of height, width, rows and cols (of patches). A pair of patches counts
    once, however many pixels share it; pairs of patches without a descriptor are left out.
    """
    e = pairs.join(sizes.select(*keys, F.struct("source", "target").alias("_s")), keys)
    cell = lambda side, at, size, n: patch_of(F.col(f"{side}_{at}"), F.col(f"_s.{side}.{size}"), F.col(f"_s.{side}.{n}")).alias(f"_{side}_{at}")
    places = [cell(side, at, size, n) for side in ("source", "target") for at, size, n in (("row", "height", "rows"), ("col", "width", "cols"))]
    e = e.select(*keys, *places, *[(F.col(f"_s.{s}.rows") * F.col(f"_s.{s}.cols")).alias(f"_{s}_all") for s in ("source", "target")]).distinct()
    for side, table in (("source", source), ("target", target)):
        e = e.join(table.where(F.col(vector).isNotNull()).select(*keys, F.col("row").alias(f"_{side}_row"), F.col("col").alias(f"_{side}_col"), F.col(vector).alias(f"_{side}")), [*keys, f"_{side}_row", f"_{side}_col"])
    seen = {s: F.count_distinct(f"_{s}_row", f"_{s}_col") for s in ("source", "target")}
    counts = [seen[s].alias(f"{s}_patches") for s in seen] + [(seen[s] / F.first(f"_{s}_all")).alias(f"{s}_coverage") for s in seen]
    return e.groupBy(*keys).agg(F.count("*").alias("pairs"), F.avg(cosine(F.col("_source"), F.col("_target"))).alias("similarity"), *counts)


def triangle_objects(triangles: DataFrame, vertices: DataFrame, keys: list[str], vertex: str, a: str, b: str, c: str) -> DataFrame:
    """triangles with object: what two of its three vertices are part of, else what the first is.

    vertices has (keys, vertex, object), a row a vertex; one that is missing or null is background, 0.
    """
    e = triangles
    for i, corner in enumerate((a, b, c)):
        e = e.join(vertices.select(*keys, F.col(vertex).alias(corner), F.col("object").alias(f"_o{i}")), [*keys, corner], "left")
    first, second, third = (F.coalesce(f"_o{i}", F.lit(0)) for i in range(3))
    voted = F.when((first != second) & (second == third), second).otherwise(first)
    return e.withColumn("object", voted).select(*triangles.columns, "object")


def intrinsics_matrix(values: Column) -> Column:
    """Nine numbers by rows of a pinhole camera, from those nine or from fx, fy, cx, cy; null unless finite, with positive focal lengths and 0, 0, 1 last."""
    v = F.transform(values, lambda x: x.cast("double"))
    g = lambda i: F.get(v, F.lit(i))
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.when(F.size(v) == 4, F.array(g(0), zero, g(2), zero, g(1), g(3), zero, zero, one)).when(F.size(v) == 9, v)
    last = (F.abs(F.get(m, F.lit(6))) <= 1e-8) & (F.abs(F.get(m, F.lit(7))) <= 1e-8) & (F.abs(F.get(m, F.lit(8)) - 1) <= 1e-8 + 1e-5)
    return F.when(F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.get(m, F.lit(0)) > 0) & (F.get(m, F.lit(4)) > 0) & last, m)
