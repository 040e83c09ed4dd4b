from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from meridia.operators import warps

CAMERA = "struct<fx: double, fy: double, cx: double, cy: double, height: int, width: int, k1: double, k2: double, p1: double, p2: double>"
PIXEL = "k int, row int, col int, depth double, valid boolean"


def cameras(spark, source, target, k=1):
    return spark.createDataFrame([(k, source, target)], f"k int, source {CAMERA}, target {CAMERA}")


PLAIN = (10.0, 10.0, 5.0, 5.0, 10, 10, None, None, None, None)
FINE = (20.0, 20.0, 10.0, 10.0, 20, 20, None, None, None, None)


def test_the_nearest_depth_wins_and_unsound_ones_count_for_nothing(spark):
    half = (5.0, 5.0, 2.5, 2.5, 5, 5, None, None, None, None)
    rows = [(1, 1, 1, 4.0, True), (1, 1, 1, 3.0, True), (1, 2, 2, 1.0, False), (1, 3, 3, float("nan"), True), (1, 3, 3, float("inf"), True), (1, 3, 3, -1.0, True), (1, 3, 3, None, True), (1, 5, 5, 2.0, None), (2, 1, 1, 1.0, True)]
    got = warps.depth_to_view(spark.createDataFrame(rows, PIXEL), cameras(spark, PLAIN, half), ["k"]).collect()
    # Pixel 1 has its centre at 1.5, which is 0.75 there and so 0.25 past the first centre.
    assert [tuple(r) for r in got] == [(1, 0, 0, 3.0)]


def test_halves_go_to_the_even_pixel(spark):
    rows = [(1, 2, c, 1.0, True) for c in (1, 2)]
    got = warps.depth_to_view(spark.createDataFrame(rows, PIXEL), cameras(spark, PLAIN, FINE), ["k"]).collect()
    assert sorted((r.row, r.col) for r in got) == [(4, 2), (4, 4)]


def test_masks_widen_by_one_and_stay_inside(spark):
    mask = spark.createDataFrame([(1, 0, 0), (1, 5, 5), (1, 5, 5)], "k int, row int, col int")
    got = {(r.row, r.col) for r in warps.mask_to_view(mask, cameras(spark, PLAIN, PLAIN), ["k"]).collect()}
    assert got == {(r, c) for r in (0, 1) for c in (0, 1)} | {(r, c) for r in (4, 5, 6) for c in (4, 5, 6)}
    assert warps.mask_to_view(mask.where("false"), cameras(spark, PLAIN, PLAIN), ["k"]).count() == 0


def test_a_lens_is_undone_and_another_applied(spark):
    lens = (0.1, 0.02, 0.003, -0.002)
    source, target = (10.0, 11.0, 5.0, 5.0, 10, 10, *lens), (20.0, 21.0, 10.0, 10.0, 20, 20, None, None, None, None)
    rows = [(1, r, c, 1.0 + r * 10 + c, True) for r in range(10) for c in range(10)]
    expected = {}
    for _, r, c, depth, _ in rows:
        x, y = xd, yd = (c + 0.5 - 5) / 10, (r + 0.5 - 5) / 11
        for _ in range(200):  # plain fixed point, other than the operator's Newton steps
            r2 = x * x + y * y
            radial = 1 + lens[0] * r2 + lens[1] * r2 * r2
            x, y = (xd - 2 * lens[2] * x * y - lens[3] * (r2 + 2 * x * x)) / radial, (yd - lens[2] * (r2 + 2 * y * y) - 2 * lens[3] * x * y) / radial
        at = round(21 * y + 10 - 0.5), round(20 * x + 10 - 0.5)
        if 0 <= at[0] < 20 and 0 <= at[1] < 20:
            expected[at] = min(depth, expected.get(at, math.inf))
    got = {(r.row, r.col): r.depth for r in warps.depth_to_view(spark.createDataFrame(rows, PIXEL), cameras(spark, source, target), ["k"]).collect()}
    assert got == expected and len(got) > 80
    same = warps.depth_to_view(spark.createDataFrame(rows, PIXEL), cameras(spark, source, source), ["k"])
    assert {(r.row, r.col): r.depth for r in same.collect()} == {(r, c): d for _, r, c, d, _ in rows}


@pytest.fixture(scope="module")
def image(spark):
    return spark.createDataFrame([(1, r, c, float((r * 7 + c * 3) % 11)) for r in range(12) for c in range(12)], "k int, row int, col int, v double")


def frames(spark, matrix, height=6, width=6):
    return spark.createDataFrame([(1, [float(m) for m in matrix], height, width)], "k int, homography array<double>, height int, width int")


def values(df):
    return {(r.row, r.col): r.v for r in df.collect()}


def test_whole_steps_take_the_pixels_themselves(spark, image):
    f = frames(spark, (1, 0, -3, 0, 1, -2, 0, 0, 1))
    expected = {(r, c): float(((r + 2) * 7 + (c + 3) * 3) % 11) for r in range(6) for c in range(6)}
    assert values(warps.warped_nearest(image, f, ["k"], "v")) == expected
    assert values(warps.warped_smooth(image, f, ["k"], "v")) == pytest.approx(expected, abs=1e-9)


def test_nothing_lies_outside_the_source(spark, image):
    f = frames(spark, (1, 0, 11, 0, 1, 0, 0, 0, 1), 1, 13)
    near, smooth = values(warps.warped_nearest(image, f, ["k"], "v")), values(warps.warped_smooth(image, f, ["k"], "v"))
    assert all(near[0, c] is None for c in range(11)) and near[0, 11] == 0.0 and near[0, 12] == 3.0
    assert smooth[0, 0] == 0.0 and smooth[0, 12] == pytest.approx(3.0)


def test_smooth_values_equal_a_loop(spark, image):
    m = (1.1, 0.2, -1.3, -0.1, 0.9, 0.4, 0.01, -0.005, 1.0)
    source = values(image)
    i = [r[0] for r in spark.createDataFrame([(list(m),)], "m array<double>").select(F.explode(warps.inverse(F.col("m")))).collect()]

    def kernel(t):
        return 1.0 if abs(t) < 1e-9 else math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 4) / (math.pi * t / 4)

    expected = {}
    for r in range(6):
        for c in range(6):
            w = i[6] * c + i[7] * r + i[8]
            x, y = (round((i[k] * c + i[k + 1] * r + i[k + 2]) / w * 32) / 32 for k in (0, 3))
            fx, fy = math.floor(x), math.floor(y)
            wx, wy = ([kernel(p - f - d) for d in range(-3, 5)] for p, f in ((x, fx), (y, fy)))
            expected[r, c] = sum(a / sum(wx) * b / sum(wy) * source.get((fy + e, fx + d), 0.0) for a, d in zip(wx, range(-3, 5), strict=True) for b, e in zip(wy, range(-3, 5), strict=True))
    assert values(warps.warped_smooth(image, frames(spark, m), ["k"], "v")) == pytest.approx(expected, abs=1e-9)


def test_a_flat_homography_and_no_images_give_no_rows(spark, image):
    assert warps.warped_nearest(image, frames(spark, (1, 0, 0, 2, 0, 0, 0, 0, 1)), ["k"], "v").count() == 0
    assert warps.warped_smooth(image, frames(spark, (1, 0, 0, 0, 1, 0, 0, 0, 1)).where("false"), ["k"], "v").count() == 0
