"""Search for the revisit pair of a path: aligned candidates, scored coarsely and then round the best."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mirrored_pairs(frames: DataFrame, turns: DataFrame, keys: list[str], index: str, coordinates: list[str], angle: str, least_gap: int, most_distance: float | None = 1.0, most_angle: float = 15.0) -> DataFrame:
    """(keys, first, revisit, distance, angle_error) of the frames before a turning point and those mirrored behind it.

    turns has (keys, turn, stop): a frame `first` before the turn, other than the 0th, is revisited at turn +
    round((turn - first) / turn * (stop - turn)), half to even, if that is before the stop. Kept are
    pairs at least least_gap frames apart whose positions and angles (degrees, compared round the circle)
    agree within the bounds; a null bound on the distance is none.
    """
    left = frames.select(*keys, F.col(index).alias("first"), *[F.col(c).alias(f"_a_{c}") for c in (*coordinates, angle)])
    right = frames.select(*keys, F.col(index).alias("revisit"), *[F.col(c).alias(f"_b_{c}") for c in (*coordinates, angle)])
    back = F.rint((F.col("turn") - F.col("first")) / F.col("turn").cast("double") * (F.col("stop") - F.col("turn"))).cast("long")
    ahead = left.join(turns, keys).where((F.col("first") < F.col("turn")) & (F.col("first") > 0)).withColumn("revisit", F.col("turn") + back)
    pairs = ahead.where((F.col("revisit") > F.col("turn")) & (F.col("revisit") < F.col("stop")) & (F.col("revisit") - F.col("first") >= least_gap)).join(right, [*keys, "revisit"])
    apart = F.sqrt(sum(((F.col(f"_b_{c}") - F.col(f"_a_{c}")) * (F.col(f"_b_{c}") - F.col(f"_a_{c}")) for c in coordinates), F.lit(0.0)))
    turned = F.abs(F.pmod(F.col(f"_b_{angle}") - F.col(f"_a_{angle}") + 180.0, F.lit(360.0)) - 180.0)
    out = pairs.withColumns({"distance": apart, "angle_error": turned}).where(F.col("angle_error") <= most_angle)
    return (out if most_distance is None else out.where(F.col("distance") <= most_distance)).select(*keys, "first", "revisit", "distance", "angle_error")


def coarse_to_fine(candidates: DataFrame, keys: list[str], position: str, score: Callable[[DataFrame], DataFrame], by: list[Column], stride: int = 4, descending: bool = True) -> DataFrame:
    """The best candidate of each key, with the columns of score(candidates).

    Candidates of a key are taken in the order of `position`, from the largest down if
    descending. Every stride-th is scored; those within stride - 1 of the best one's
    position are scored too, and the best of both is the result. Best is the greatest in
    the order of `by`, expressions over scored columns, and then of position. score is
    only given the candidates that the search asks for, so it may be dear; it keeps their columns and
    rows. A key without candidates has no row.
    """
    order = F.desc(position) if descending else F.asc(position)
    numbered = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    best = lambda df: df.groupBy(*keys).agg(F.max(F.struct(*[b.alias(f"_k{i}") for i, b in enumerate(by)], F.col(position).alias("_at"))).alias("_best"))
    coarse = score(numbered.where(F.col("_n") % stride == 0))
    centre = best(coarse).select(*keys, F.col("_best._at").alias("_centre"))
    fine = score(numbered.where(F.col("_n") % stride != 0).join(centre, keys).where(F.abs(F.col(position) - F.col("_centre")) <= stride - 1).drop("_centre"))
    both = coarse.unionByName(fine)
    top = best(both).select(*keys, F.col("_best._at").alias(position))
    return both.join(top, [*keys, position]).drop("_n")
