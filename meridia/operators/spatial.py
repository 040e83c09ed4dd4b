"""Pixels, voxels and point sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frontmost(points: DataFrame, pixel: list[str], depth: str, ordinal: list[str], carry: list[str]) -> DataFrame:
    """(pixel, depth, ordinal, carried): the nearest point of each pixel, ties to the first in order."""
    best = F.min(F.struct(depth, *ordinal, *carry)).alias("m")
    return points.groupBy(*pixel).agg(best).select(*pixel, "m.*")


def voxel(value: Column, size: float) -> Column:
    """Cell of a coordinate, rounded with a small bias so that cell borders are stable."""
    return F.floor(value / size + 0.5 + 5e-5)


def voxels(points: DataFrame, coordinates: list[str], size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """The distinct cells of points, of each key."""
    return points.select(*keys, *[voxel(F.col(c), size).alias(c) for c in coordinates]).distinct()


def first_in_cell(points: DataFrame, coordinates: list[str], size: float, ordinal: list[str]) -> DataFrame:
    """(cells, ordinal): the first point of each cell, by order."""
    cells = [F.floor(F.col(c) / size).alias(f"cell_{c}") for c in coordinates]
    return points.groupBy(*cells).agg(F.min(F.struct(*ordinal)).alias("m")).select(*[f"cell_{c}" for c in coordinates], "m.*")


def f_score(left_near: Column, left: Column, right_near: Column, right: Column) -> Column:
    """Harmonic mean of the shares of points with a near one on the other side; 0 where both are 0."""
    p, r = left_near / left, right_near / right
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def median_scale_error(pairs: DataFrame, keys: list[str], reference: str, estimate: str) -> DataFrame:
    """(keys, n, scale, abs_rel): the median of reference / estimate, and the mean relative error once it is applied.

    Pairs with a value that isn't positive are left out.
    """
    rows = pairs.where((F.col(reference) > 0) & (F.col(estimate) > 0)).withColumn("_ratio", F.col(reference) / F.col(estimate))
    scales = rows.groupBy(*keys).agg(F.expr("percentile(_ratio, 0.5)").alias("scale"))
    error = F.abs(F.col(estimate) * F.col("scale") - F.col(reference)) / F.col(reference)
    return rows.join(scales, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.first("scale").alias("scale"), F.avg(error).alias("abs_rel"))


def regional_scale(pixels: DataFrame, keys: list[str], row: str, col: str, ratio: str, height: float, width: float, grid: int = 4, least: int = 16) -> DataFrame:
    """(keys, cells, inconsistency): median absolute deviation of the log median ratios of a grid's cells.

    Cells with fewer than `least` pixels don't count; with fewer than two cells it is null.
    """
    at = lambda c, size: F.floor(F.col(c) * grid / size)
    inside = pixels.where((F.col(row) >= 0) & (F.col(row) < height) & (F.col(col) >= 0) & (F.col(col) < width))
    cells = inside.groupBy(*keys, at(row, height).alias("_r"), at(col, width).alias("_c")).agg(F.count("*").alias("_n"), F.expr(f"percentile({ratio}, 0.5)").alias("_m"))
    logs = cells.where(F.col("_n") >= least).withColumn("_log", F.log(F.greatest(F.col("_m"), F.lit(1e-8))))
    middle = logs.groupBy(*keys).agg(F.expr("percentile(_log, 0.5)").alias("_middle"))
    spread = logs.join(middle, keys).withColumn("_off", F.abs(F.col("_log") - F.col("_middle"))).groupBy(*keys).agg(F.count("*").alias("cells"), F.expr("percentile(_off, 0.5)").alias("_mad"))
    return spread.select(*keys, "cells", F.when(F.col("cells") >= 2, F.col("_mad")).alias("inconsistency"))


def painted(points: DataFrame, pixel: list[str], depth: str, ordinal: list[str]) -> DataFrame:
    """points with hidden = whether another of its pixel lies in front of it."""
    w = Window.partitionBy(*pixel).orderBy(depth, *ordinal)
    return points.withColumn("hidden", F.row_number().over(w) > 1)


def image_statistics(pixels: DataFrame, keys: list[str], a: str, b: str, peak: float = 255.0) -> DataFrame:
    """(keys, n, psnr, ssim, l1) of two aligned images as pixel rows, with global moments; psnr is 100 at no error."""
    d = F.col(a) - F.col(b)
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    agg = pixels.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("l1"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("vab")
    )
    ssim = (2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("vab") + c2) / ((F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb") + c1) * (F.col("va") + F.col("vb") + c2))
    psnr = F.when(F.col("mse") > 0, 10 * F.log10(peak * peak / F.col("mse"))).otherwise(100.0)
    return agg.select(*keys, "n", psnr.alias("psnr"), ssim.alias("ssim"), "l1")
