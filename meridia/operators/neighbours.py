"""The k nearest right points of every left point, by a descent through nested cells.

Right points are counted in cells of several widths, each level four times as wide on
every axis, with the box that their points fill. A left point goes down level by level
and keeps the cells that may still hold one of its k nearest: those whose box begins no
farther away than the boxes that hold k points surely end. So neither a crowded place nor
clouds that lie far apart make points meet all others of their key, and every step is a join
by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.session import cut_lineage

FAN_BITS = 2


def _square(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [p * p for p in parts])


def cells_of(right: DataFrame, keys: list[str], coordinates: list[str], width: float, levels: int) -> DataFrame:
    """(keys, level, cell, above, n, lo, hi): the filled cells of every level, their number of points and the box of those."""
    base = F.array(*[F.floor(F.col(c) / width) for c in coordinates])
    shifted = lambda by: F.transform("_base", lambda i: F.shiftright(i, by))
    steps = F.array(*[F.struct(F.lit(lv).alias("level"), shifted(FAN_BITS * lv).alias("cell"), shifted(FAN_BITS * (lv + 1)).alias("above")) for lv in range(levels)])
    every = right.select(*keys, *coordinates, base.alias("_base")).select(*keys, *coordinates, F.explode(steps).alias("s")).select(*keys, *coordinates, "s.*")
    ends = [F.array(*[f(c) for c in coordinates]).alias(n) for n, f in (("lo", F.min), ("hi", F.max))]
    return every.groupBy(*keys, "level", "cell", "above").agg(F.count("*").alias("n"), *ends)


def nearest_k(left: DataFrame, right: DataFrame, keys: list[str], coordinates: list[str], k: int, width: float) -> DataFrame:
    """(keys, coordinates, near, place, distance): for every distinct left place its k nearest distinct right places of the key, place 1 the nearest.

    `near` is an array of coordinates; ties go to the smaller array. A key with fewer than
    k right places gives all of them; one without any gives no rows. Rows with a null or
    NaN coordinate, or a null key, are left out. `width` is that of the narrowest cells and changes
    only the work, not the result.
    """
    known = lambda df: reduce(lambda d, c: d.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))), coordinates, df)
    plain = lambda df: known(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in coordinates]).dropna(subset=list(keys))).distinct()
    there = cut_lineage(plain(right))
    extent = there.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in coordinates], F.lit(0.0)))).first()[0] or 0.0
    levels = 1
    while width * 2.0 ** (FAN_BITS * (levels - 1)) < extent:
        levels += 1
    cells = cut_lineage(cells_of(there, keys, coordinates, width, levels))
    # At the top every key has two cells an axis at most, one to either side of 0.
    point = F.struct(*coordinates)
    at = plain(left).withColumn("_p", point)
    open_ = None
    for level in range(levels - 1, -1, -1):
        here = cells.where(F.col("level") == level).select(*keys, "cell", "above", "n", "lo", "hi")
        if open_ is None:
            met = at.select(*keys, "_p").join(here, keys)
        else:
            met = open_.select(*keys, "_p", F.col("cell").alias("above")).join(here, [*keys, "above"])
        away = lambda c, i: F.greatest(F.get("lo", F.lit(i)) - F.col(f"_p.{c}"), F.col(f"_p.{c}") - F.get("hi", F.lit(i)), F.lit(0.0))
        across = lambda c, i: F.greatest(F.abs(F.get("lo", F.lit(i)) - F.col(f"_p.{c}")), F.abs(F.get("hi", F.lit(i)) - F.col(f"_p.{c}")))
        met = met.withColumns({"_least": _square([away(c, i) for i, c in enumerate(coordinates)]), "_most": _square([across(c, i) for i, c in enumerate(coordinates)])})
        w = Window.partitionBy(*keys, "_p")
        so_far = F.sum("n").over(w.orderBy("_most").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        met = met.withColumn("_held", so_far)
        enough = F.min(F.when(F.col("_held") >= k, F.col("_most"))).over(w)
        open_ = met.withColumn("_enough", enough).where(F.col("_enough").isNull() | (F.col("_least") <= F.col("_enough") * (1 + 1e-9))).select(*keys, "_p", "cell")
    near = F.array(*coordinates)
    leaves = there.select(*keys, F.array(*[F.floor(F.col(c) / width) for c in coordinates]).alias("cell"), near.alias("near"))
    pairs = open_.join(leaves, [*keys, "cell"])
    square = _square([F.get("near", F.lit(i)) - F.col(f"_p.{c}") for i, c in enumerate(coordinates)])
    ranked = pairs.withColumn("_d", square).withColumn("place", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_d", "near")))
    return ranked.where(F.col("place") <= k).select(*keys, "_p.*", "near", "place", F.sqrt("_d").alias("distance"))


def box_clearance(points: DataFrame, centres: DataFrame, keys: list[str], coordinates: list[str], size: float, k: int = 16) -> DataFrame:
    """(keys, coordinates, clearance): the least distance of each distinct point to the boxes of its k nearest voxel centres, 0 inside one.

    Points of a key without voxels have no row; a caller that wants them joins them as unbounded.
    """
    near = nearest_k(points, centres, keys, coordinates, k, 2 * size)
    gaps = [F.greatest(F.abs(F.get("near", F.lit(i)) - F.col(c)) - size / 2, F.lit(0.0)) for i, c in enumerate(coordinates)]
    return near.groupBy(*keys, *coordinates).agg(F.min(F.sqrt(_square(gaps))).alias("clearance"))
