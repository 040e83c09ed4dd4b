"""Dense projection of one view's pixels into another, by joins on pixel keys.

Views are tables of pixels; cameras are pinholes. A pixel of the target view is lifted by its measured depth, moved
into the source camera and looked up there by the pixel that it falls into, so both
directions and any number of pixels are equality joins on (keys, row, column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAMERA = "struct<fx: double, fy: double, cx: double, cy: double>"


def _cell(value: Column) -> Column:
    """The pixel that a coordinate falls into; null where it isn't finite or beyond an int."""
    return F.when(F.abs(value) < 2.0**31, F.floor(value).cast("int"))


def moved(point: list[Column], pose_from: Column, pose_to: Column) -> list[Column]:
    """The point in the camera of pose_to, given in that of pose_from; poses are camera-to-world, 16 numbers by rows."""
    m = lambda p, r, c: F.get(p, F.lit(4 * r + c))
    world = [m(pose_from, r, 0) * point[0] + m(pose_from, r, 1) * point[1] + m(pose_from, r, 2) * point[2] + m(pose_from, r, 3) for r in range(3)]
    rest = [world[r] - m(pose_to, r, 3) for r in range(3)]
    return [m(pose_to, 0, c) * rest[0] + m(pose_to, 1, c) * rest[1] + m(pose_to, 2, c) * rest[2] for c in range(3)]


def dense_projection(target: DataFrame, target_depth: DataFrame, source: DataFrame, source_depth: DataFrame, cameras: DataFrame, keys: list[str], relative: float = 0.10, absolute: float = 0.02) -> DataFrame:
    """(keys, row, col, candidate, support, depth_absrel, rgb_mae, source_row, source_col) of every target pixel.

    target and source have (keys, row, col, rgb), rgb an array of three numbers from 0 to 255; the depth
    tables have (keys, row, col, depth, valid), on grids of their own. cameras has one row
    a key: rgb and depth cameras (CAMERA) and 16-number poses `target_rgb, target_depth,
    source_rgb, source_depth, target_pose, source_pose`. Pixel centres lie at halves. A pixel is a
    candidate if its depth and that of the source pixel it falls into are valid and it lies
    before the source camera; it is supported if both depths agree to
    max(absolute, relative * source depth). Errors are null where there is no candidate,
    rgb_mae also where it falls outside the source image. source_row and source_col are null behind the source camera.
    """
    cam = lambda c, f: F.col(f"_cam.{c}.{f}")
    t = target.select(*keys, "row", "col", F.col("rgb").alias("_rgb")).join(cameras.select(*keys, F.struct("target_rgb", "target_depth", "source_rgb", "source_depth", "target_pose", "source_pose").alias("_cam")), keys)
    ray = [(F.col("col") + 0.5 - cam("target_rgb", "cx")) / cam("target_rgb", "fx"), (F.col("row") + 0.5 - cam("target_rgb", "cy")) / cam("target_rgb", "fy")]
    t = t.withColumns({"_x": ray[0], "_y": ray[1]})
    t = t.withColumns({"_dcol": _cell(cam("target_depth", "fx") * F.col("_x") + cam("target_depth", "cx")), "_drow": _cell(cam("target_depth", "fy") * F.col("_y") + cam("target_depth", "cy"))})
    own = target_depth.select(*keys, F.col("row").alias("_drow"), F.col("col").alias("_dcol"), F.col("depth").alias("_z"), F.col("valid").alias("_ok"))
    t = t.join(own, [*keys, "_drow", "_dcol"], "left")
    at = moved([F.col("_x") * F.col("_z"), F.col("_y") * F.col("_z"), F.col("_z")], F.col("_cam.target_pose"), F.col("_cam.source_pose"))
    t = t.withColumns({f"_p{i}": v for i, v in enumerate(at)})
    seen = lambda camera, f, c, i: _cell(F.when(F.col("_p2") > 0, cam(camera, f) * F.col(f"_p{i}") / F.col("_p2") + cam(camera, c)))
    t = t.withColumns({"_scol": seen("source_depth", "fx", "cx", 0), "_srow": seen("source_depth", "fy", "cy", 1), "source_col": seen("source_rgb", "fx", "cx", 0), "source_row": seen("source_rgb", "fy", "cy", 1)})
    measured = source_depth.select(*keys, F.col("row").alias("_srow"), F.col("col").alias("_scol"), F.col("depth").alias("_zs"), F.col("valid").alias("_oks"))
    colours = source.select(*keys, F.col("row").alias("source_row"), F.col("col").alias("source_col"), F.col("rgb").alias("_rgbs"))
    t = t.join(measured, [*keys, "_srow", "_scol"], "left").join(colours, [*keys, "source_row", "source_col"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    candidate = yes(F.col("_ok")) & yes(F.col("_oks")) & yes(F.col("_p2") > 0)
    gap = F.abs(F.col("_p2") - F.col("_zs"))
    mean_gap = sum((F.abs(F.get("_rgbs", F.lit(i)) - F.get("_rgb", F.lit(i))).cast("double") for i in range(3)), F.lit(0.0)) / 3.0 / 255.0
    return t.select(
        *keys,
        "row",
        "col",
        candidate.alias("candidate"),
        (candidate & yes(gap <= F.greatest(F.lit(absolute), relative * F.col("_zs")))).alias("support"),
        F.when(candidate, gap / F.col("_zs")).alias("depth_absrel"),
        F.when(candidate, mean_gap).alias("rgb_mae"),
        "source_row",
        "source_col",
    )


def anchor_support(projection: DataFrame, target_mask: DataFrame, source_mask: DataFrame, keys: list[str], anchor: str) -> DataFrame:
    """(keys, anchor, mask_pixels, support_pixels, supported_fraction, depth_absrel, rgb_mae): how much of an anchor's mask the other view bears out.

    The masks have (keys, anchor, row, col), one row a pixel. A target pixel counts if it falls into the
    anchor's mask in the source view: the depth error is the median of candidates, the
    colour error that of supported pixels, null without any.
    """
    there = source_mask.select(*keys, anchor, F.col("row").alias("source_row"), F.col("col").alias("source_col"), F.lit(True).alias("_in"))
    pixels = target_mask.select(*keys, anchor, "row", "col").join(projection, [*keys, "row", "col"], "left").join(there, [*keys, anchor, "source_row", "source_col"], "left")
    inside = F.coalesce("_in", F.lit(False))
    supported, comparable = inside & F.coalesce("support", F.lit(False)), inside & F.coalesce("candidate", F.lit(False))
    n, held = F.count("*"), F.count_if(supported)
    sums = [n.alias("mask_pixels"), held.alias("support_pixels"), (held / n).alias("supported_fraction")]
    return pixels.groupBy(*keys, anchor).agg(*sums, F.median(F.when(comparable, F.col("depth_absrel"))).alias("depth_absrel"), F.median(F.when(supported, F.col("rgb_mae"))).alias("rgb_mae"))


def anchor_diagnostics(forward: DataFrame, reverse: DataFrame, target_mask: DataFrame, source_mask: DataFrame, keys: list[str], anchor: str, least_coverage: float = 0.10, most_depth: float = 0.10, most_rgb: float = 0.20) -> DataFrame:
    """The support of each anchor both ways, the reverse one with the prefix reverse_, and whether the forward one passes."""
    f = anchor_support(forward, target_mask, source_mask, keys, anchor)
    r = anchor_support(reverse, source_mask, target_mask, keys, anchor)
    r = r.select(*keys, anchor, *[F.col(c).alias(f"reverse_{c}") for c in r.columns if c not in (*keys, anchor)])
    passed = (F.col("supported_fraction") >= least_coverage) & (F.col("depth_absrel") <= most_depth) & (F.col("rgb_mae") <= most_rgb)
    return f.join(r, [*keys, anchor], "left").withColumn("passed", F.coalesce(passed, F.lit(False)))
