"""Images, masks and depths moved between cameras and by homographies, as keyed rows.

Images are tables (keys, row, col, ..); pixel centres of camera images lie at halves, homographies
take whole numbers as centres. Forward maps are aggregations by target pixel, backward
ones equality joins from target pixels, so any number of images runs at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.tables import settled
from meridia.functions.vectors import distort, undistort

#: Reach of the Lanczos kernel, parts of a pixel that its positions are rounded to.
REACH, PARTS = 4, 32
#: Rows and columns of the source that a task of the smooth warp takes at once.
BLOCK = 32
LENS = ("k1", "k2", "p1", "p2")


def _landed(pixels: DataFrame, cameras: DataFrame, keys: list[str]) -> DataFrame:
    """pixels with row and col in the camera `target`; those outside its image are left out."""
    a, b = (lambda f: F.col(f"_cam.source.{f}")), (lambda f: F.col(f"_cam.target.{f}"))
    e = pixels.join(cameras.select(*keys, F.struct("source", "target").alias("_cam")), keys)
    e = settled(e).withColumns({"_x": (F.col("col") + 0.5 - a("cx")) / a("fx"), "_y": (F.col("row") + 0.5 - a("cy")) / a("fy")})
    lens = lambda cam: [F.coalesce(cam(f), F.lit(0.0)) for f in LENS]
    same = F.lit(True)
    for p, q in zip(lens(a), lens(b), strict=True):
        same = same & (p == q)
    free = undistort(F.col("_x"), F.col("_y"), *lens(a))
    e = settled(settled(e).withColumn("_ray", F.when(~same, free)))
    bent = distort(F.col("_ray.x"), F.col("_ray.y"), *lens(b))
    e = e.withColumn("_bent", F.when(same, F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))).otherwise(bent))
    e = settled(e)
    col, row = F.rint(b("fx") * F.col("_bent.x") + b("cx") - 0.5), F.rint(b("fy") * F.col("_bent.y") + b("cy") - 0.5)
    e = settled(e.withColumns({"_row": row, "_col": col}))
    row, col = F.col("_row"), F.col("_col")
    inside = (row >= 0) & (row < b("height")) & (col >= 0) & (col < b("width"))
    return e.where(inside).withColumns({"row": row.cast("int"), "col": col.cast("int"), "_height": b("height"), "_width": b("width")}).drop("_x", "_y", "_ray", "_bent", "_cam", "_row", "_col")


def depth_to_view(depths: DataFrame, cameras: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, depth): the nearest of the depths that land in each pixel of another camera at the same place.

    depths has (keys, row, col, depth, valid); depths that are not valid, not finite or not
    positive count for nothing. cameras has one row a key with structs source and target of
    fx, fy, cx, cy, height, width and the lens k1, k2, p1, p2 (null: none). Lenses that are
    alike on both sides cancel; a point at which the source's can't be inverted is left out.
    """
    sound = F.coalesce(F.col("valid") & (F.col("depth") > 0) & (F.col("depth") < float("inf")), F.lit(False))
    return _landed(depths.where(sound).select(*keys, "row", "col", "depth"), cameras, keys).groupBy(*keys, "row", "col").agg(F.min("depth").alias("depth"))


def mask_to_view(mask: DataFrame, cameras: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col): the pixels that a mask covers in another camera at the same place, widened by one each way.

    mask has a row a pixel of it; the columns of an image's row are one array, rows are
    widened by copies of those arrays and columns within them.
    """
    found = _landed(mask.select(*keys, "row", "col"), cameras, keys)
    lines = found.groupBy(*keys, "row").agg(F.collect_set("col").alias("_cols"), F.first("_height").alias("_height"), F.first("_width").alias("_width"))
    near = F.explode(F.sequence(F.greatest(F.col("row") - 1, F.lit(0)), F.least(F.col("row") + 1, F.col("_height").cast("int") - 1)))
    lines = lines.withColumn("row", near).groupBy(*keys, "row").agg(F.array_distinct(F.flatten(F.collect_list("_cols"))).alias("_cols"), F.first("_width").cast("int").alias("_width"))
    wide = F.filter(F.flatten(F.transform("_cols", lambda c: F.array(c - 1, c, c + 1))), lambda c: (c >= 0) & (c < F.col("_width")))
    return lines.select(*keys, "row", F.explode(F.array_distinct(wide)).alias("col"))


def inverse(m: Column) -> Column:
    """The inverse of a 3x3 matrix of nine numbers by rows; null if it has none."""
    g = lambda i: F.get(m, F.lit(i))
    minor = lambda a, b, c, d: g(a) * g(d) - g(b) * g(c)
    parts = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
    det = g(0) * parts[0] + g(1) * parts[3] + g(2) * parts[6]
    return F.when(det != 0, F.array(*[p / det for p in parts]))


def _asked(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, _x, _y): every pixel of the target images, and where it comes from."""
    e = settled(frames.select(*keys, "height", "width", inverse(F.col("homography")).alias("_m"))).where("_m IS NOT NULL AND height > 0 AND width > 0")
    e = e.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)))
    line = lambda i: F.get("_m", F.lit(i)) * F.col("col") + F.get("_m", F.lit(i + 1)) * F.col("row") + F.get("_m", F.lit(i + 2))
    w = F.when(line(6) != 0, 1 / line(6)).otherwise(0.0)
    return e.select(*keys, "row", "col", (line(0) * w).alias("_x"), (line(3) * w).alias("_y"))


def warped_nearest(image: DataFrame, frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, row, col, value): images moved by a homography, each target pixel taking the source pixel nearest to where it comes from.

    frames has one row a key with homography (nine numbers by rows, source to target),
    height and width of the target. Outside the source, value is null; a homography without
    an inverse gives no rows. image has one row a pixel.
    """
    e = _asked(frames, keys).withColumns({"_row": F.rint("_y").cast("int"), "_col": F.rint("_x").cast("int")})
    source = image.select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias(value))
    return e.join(source, [*keys, "_row", "_col"], "left").select(*keys, "row", "col", value)


def _weights(share: np.ndarray) -> np.ndarray:
    """The eight weights of a Lanczos kernel of reach 4 for positions `share` of a pixel past their fourth tap; they add up to 1."""
    a = (share[:, None] + (REACH - 1 - np.arange(2 * REACH))) * math.pi
    near = np.abs(a) < 1e-9 * math.pi
    a = np.where(near, 1.0, a)
    raw = np.where(near, 1.0, REACH * np.sin(a) * np.sin(a / REACH) / (a * a))
    return raw / raw.sum(axis=1, keepdims=True)


def warped_smooth(image: DataFrame, frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, row, col, value): as warped_nearest, but from 8 x 8 source pixels by Lanczos weights; 0 outside the source.

    Positions are rounded to 1/32 of a pixel. Target pixels meet the source in blocks of
    BLOCK x BLOCK of its pixels and those that the kernel reaches around them, so a source
    pixel is copied to four blocks at most and taps are never rows. Sums are not rounded or clipped to colours.
    """
    e = settled(_asked(frames, keys).withColumns({"_gx": F.rint(F.col("_x") * PARTS) / PARTS, "_gy": F.rint(F.col("_y") * PARTS) / PARTS}))
    block = lambda at: F.floor(at / BLOCK)
    asked = e.select(*[F.col(k).alias(k) for k in keys], block(F.col("_gy")).alias("_br"), block(F.col("_gx")).alias("_bc"), "row", "col", "_gy", "_gx")
    reached = lambda at: F.explode(F.array_distinct(F.array(block(F.col(at) - REACH), block(F.col(at) + REACH - 1))))
    source = image.where(F.col(value).isNotNull()).select(*[F.col(k).alias(k) for k in keys], F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).cast("double").alias("_v"), reached("row").alias("_br"))
    source = source.select(*keys, "_br", reached("_col").alias("_bc"), "_row", "_col", "_v")
    kinds = dict(asked.dtypes)

    def gather(x: pa.Table, y: pa.Table) -> pa.Table:
        gy, gx = (x.column(c).to_numpy() for c in ("_gy", "_gx"))
        total = np.zeros(x.num_rows)
        if x.num_rows and y.num_rows:
            edge = [x.column(c)[0].as_py() * BLOCK - (REACH - 1) for c in ("_br", "_bc")]
            pixels = np.zeros((BLOCK + 2 * REACH - 1, BLOCK + 2 * REACH - 1))
            np.add.at(pixels, (y.column("_row").to_numpy() - edge[0], y.column("_col").to_numpy() - edge[1]), y.column("_v").to_numpy())
            r, c = ((np.floor(g).astype(int) - (REACH - 1) - o)[:, None] + np.arange(2 * REACH) for g, o in ((gy, edge[0]), (gx, edge[1])))
            taps = pixels[r[:, :, None], c[:, None, :]]
            total = np.einsum("ni,nj,nij->n", _weights(gy - np.floor(gy)), _weights(gx - np.floor(gx)), taps)
        return x.select([*keys, "row", "col"]).append_column(value, pa.array(total, pa.float64()))

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`row` {kinds['row']}", f"`col` {kinds['col']}", f"`{value}` double"])
    at = [*keys, "_br", "_bc"]
    return asked.groupBy(*at).cogroup(source.groupBy(*at)).applyInArrow(gather, schema)
