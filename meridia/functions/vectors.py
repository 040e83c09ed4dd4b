"""Arrays as vectors, and rigid poses as 16 numbers by rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def pooled(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """(keys, dim, value): the weighted sum of a key's vectors, scaled to length 1; 0 where it has none."""
    parts = rows.select(*keys, weight, F.posexplode(vector).alias("dim", "v"))
    sums = parts.groupBy(*keys, "dim").agg(F.sum(F.col(weight) * F.col("v")).alias("value"))
    norms = sums.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return sums.join(norms, keys).select(*keys, "dim", F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(0.0).alias("value"))


def _r(m: Column, i: int, j: int) -> Column:
    return m[4 * i + j]


def rigid_inverse(m: Column) -> Column:
    """Inverse of a rigid 4x4 pose: transposed rotation, and the translation taken back through it."""
    t = [-(_r(m, 0, i) * _r(m, 0, 3) + _r(m, 1, i) * _r(m, 1, 3) + _r(m, 2, i) * _r(m, 2, 3)) for i in range(3)]
    rows = [x for i in range(3) for x in (_r(m, 0, i), _r(m, 1, i), _r(m, 2, i), t[i])]
    return F.array(*rows, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def product(a: Column, b: Column) -> Column:
    """Product of two 4x4 matrices."""
    return F.array(*[_r(a, i, 0) * _r(b, 0, j) + _r(a, i, 1) * _r(b, 1, j) + _r(a, i, 2) * _r(b, 2, j) + _r(a, i, 3) * _r(b, 3, j) for i in range(4) for j in range(4)])


def relative(a: Column, b: Column) -> Column:
    """Pose of b seen from a."""
    return product(rigid_inverse(a), b)


def rotation_degrees(m: Column, stable: bool = True) -> Column:
    """Angle of a pose's rotation; stable near 0 by atan2 of its skew part, else by the arc cosine of its trace."""
    cos = (_r(m, 0, 0) + _r(m, 1, 1) + _r(m, 2, 2) - 1) / 2
    if not stable:
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    x, y, z = _r(m, 2, 1) - _r(m, 1, 2), _r(m, 0, 2) - _r(m, 2, 0), _r(m, 1, 0) - _r(m, 0, 1)
    return F.degrees(F.atan2(F.sqrt(x * x + y * y + z * z) / 2, cos))


def translation_norm(m: Column) -> Column:
    return F.sqrt(_r(m, 0, 3) * _r(m, 0, 3) + _r(m, 1, 3) * _r(m, 1, 3) + _r(m, 2, 3) * _r(m, 2, 3))


def yaw_pose(yaw: Column, x: Column, y: Column, z: Column) -> Column:
    """Pose at (x, y, z), turned by yaw in degrees about the vertical axis."""
    c, s = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, zero, s, x, zero, one, zero, y, -s, zero, c, z, zero, zero, zero, one)


def rigid_problems(m: Column, tolerance: float = 1e-4) -> Column:
    """What keeps a 4x4 matrix from being a rigid pose: size, finite, bottom_row, orthonormal, handed."""
    dots = [sum((_r(m, i, k) * _r(m, j, k) for k in range(3)), F.lit(0.0)) - (1.0 if i == j else 0.0) for i in range(3) for j in range(i, 3)]
    det = _r(m, 0, 0) * (_r(m, 1, 1) * _r(m, 2, 2) - _r(m, 1, 2) * _r(m, 2, 1)) - _r(m, 0, 1) * (_r(m, 1, 0) * _r(m, 2, 2) - _r(m, 1, 2) * _r(m, 2, 0)) + _r(m, 0, 2) * (_r(m, 1, 0) * _r(m, 2, 1) - _r(m, 1, 1) * _r(m, 2, 0))
    off = F.greatest(*[F.abs(d) for d in dots])
    bottom = F.abs(_r(m, 3, 0)) + F.abs(_r(m, 3, 1)) + F.abs(_r(m, 3, 2)) + F.abs(_r(m, 3, 3) - 1.0)
    odd = F.exists(m, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.size(m) == 16
    fine = whole & ~odd
    return F.array_compact(F.array(F.when(~whole, F.lit("size")), F.when(whole & odd, F.lit("finite")), F.when(fine & (bottom > tolerance), F.lit("bottom_row")), F.when(fine & (off > tolerance), F.lit("orthonormal")), F.when(fine & (det < 0), F.lit("handed"))))


def backproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column, centre: float = 0.0) -> Column:
    """Camera point (x, y, z) of a pixel; centre is 0.5 where pixels are addressed by their corner."""
    return F.struct(((u + centre - cx) / fx * depth).alias("x"), ((v + centre - cy) / fy * depth).alias("y"), depth.alias("z"))


def project(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel (u, v) of a camera point; null behind the camera."""
    front = z > 1e-8
    return F.struct(F.when(front, F.try_divide(x, z) * fx + cx).alias("u"), F.when(front, F.try_divide(y, z) * fy + cy).alias("v"))


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Rotation by rows of a quaternion of any length but 0."""
    n = x * x + y * y + z * z + w * w
    two = lambda a, b: 2 * a * b / n
    return F.array(
        1 - two(y, y) - two(z, z), two(x, y) - two(z, w), two(x, z) + two(y, w),
        two(x, y) + two(z, w), 1 - two(x, x) - two(z, z), two(y, z) - two(x, w),
        two(x, z) - two(y, w), two(y, z) + two(x, w), 1 - two(x, x) - two(y, y),
    )


def smoothstep(t: Column) -> Column:
    """Quintic step from 0 to 1 with no speed or acceleration at its ends."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return s * s * s * (s * (s * 6 - 15) + 10)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def slerp(a: list[Column], b: list[Column], share: Column) -> Column:
    """The quaternion, an array of four, at a share of the way from a to b along the shorter arc."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))

    def weights(d: Column, angle: Column) -> Column:
        close = angle < 1e-6  # sines of such angles are no better than the straight line
        low = F.when(close, 1 - share).otherwise(F.try_divide(F.sin((1 - share) * angle), F.sin(angle)))
        high = F.when(close, share).otherwise(F.try_divide(F.sin(share * angle), F.sin(angle)))
        return F.array(low, F.when(d < 0, -high).otherwise(high))

    scaled = let(dot, lambda d: let(F.acos(F.least(F.lit(1.0), F.abs(d))), lambda angle: weights(d, angle)))
    raw = let(scaled, lambda w: F.array(*[w[0] * x + w[1] * y for x, y in zip(a, b, strict=True)]))
    return let(raw, lambda q: let(F.sqrt(F.aggregate(q, F.lit(0.0), lambda total, v: total + v * v)), lambda norm: F.transform(q, lambda v: v / norm)))


def distort(x: Column, y: Column, k1: Column, k2: Column, p1: Column, p2: Column) -> Column:
    """Normalised image point (x, y) under radial and tangential lens distortion."""
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2
    return F.struct((x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)).alias("x"), (y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y).alias("y"))


def undistort(x: Column, y: Column, k1: Column, k2: Column, p1: Column, p2: Column, steps: int = 12) -> Column:
    """The point that distort() takes to (x, y), by so many Newton steps from there; null where a step has no inverse."""

    def newton(*columns: pa.Array) -> pa.Array:
        x, y, k1, k2, p1, p2 = (np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in columns)
        u, v = x, y
        with np.errstate(all="ignore"):
            for _ in range(steps):
                r2 = u * u + v * v
                radial, slope = 1 + k1 * r2 + k2 * r2 * r2, 2 * (k1 + 2 * k2 * r2)
                dx = u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u) - x
                dy = v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v - y
                # The Jacobian is symmetric: both mixed terms are the same.
                uu = radial + slope * u * u + 2 * p1 * v + 6 * p2 * u
                vv = radial + slope * v * v + 6 * p1 * v + 2 * p2 * u
                uv = slope * u * v + 2 * p1 * u + 2 * p2 * v
                det = uu * vv - uv * uv
                det = np.where(np.abs(det) >= 1e-14, det, np.nan)
                u, v = u - (vv * dx - uv * dy) / det, v - (uu * dy - uv * dx) / det
        return pa.StructArray.from_arrays([pa.array(c, mask=np.isnan(c)) for c in (u, v)], ["x", "y"])

    return F.arrow_udf(newton, "struct<x:double,y:double>")(*[c.cast("double") for c in (x, y, k1, k2, p1, p2)])
