from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from meridia.operators import patches

PATCH = "k int, row int, col int, v array<double>"


def grid(spark, of, n=3, k=1):
    return spark.createDataFrame([(k, r, c, of(r, c)) for r in range(n) for c in range(n)], PATCH)


def test_masks_cover_the_patches_they_touch(spark):
    h, w, rows, cols = 7, 10, 3, 4
    pixels = [(1, r, c) for r in range(h) for c in range(w)]
    expected = {(r, c): (i, j) for i in range(rows) for j in range(cols) for r in range(i * h // rows, (i + 1) * h // rows) for c in range(j * w // cols, (j + 1) * w // cols)}
    for p in (pixels[0], pixels[23], pixels[46], pixels[-1]):
        got = patches.covered(spark.createDataFrame([p, (1, -1, 2), (1, 7, 0)], "k int, row int, col int"), ["k"], h, w, rows, cols)
        assert [(r.row, r.col) for r in got.collect()] == [expected[p[1:]]]


def test_a_shift_of_one_patch_is_forgiven_and_of_two_is_not(spark):
    turn = lambda r, c: [math.cos(r * 3 + c), math.sin(r * 3 + c)]
    left, one = grid(spark, turn), grid(spark, lambda r, c: turn(r, (c + 1) % 3))
    got = patches.local_similarity(left, one, ["k"], "v").first()
    best = [max(math.cos(r * 3 + c - (i * 3 + (j + 1) % 3)) for i in range(max(0, r - 1), min(3, r + 2)) for j in range(max(0, c - 1), min(3, c + 2))) for r in range(3) for c in range(3)]
    assert got.patches == 9 and got.similarity == pytest.approx(sum(best) / 9)
    assert patches.local_similarity(left, left, ["k"], "v", radius=0).first().similarity == pytest.approx(1.0)
    corner = spark.createDataFrame([(1, 0, 0), (1, 0, 0)], "k int, row int, col int")
    assert tuple(patches.local_similarity(left, one, ["k"], "v", corner).first()) == (1, 1, pytest.approx(best[0]))


def test_missing_and_empty_patches_match_nothing(spark):
    left = spark.createDataFrame([(1, 0, 0, None), (1, 2, 2, [1.0, 0.0]), (2, 0, 0, [1.0])], PATCH)
    right = spark.createDataFrame([(1, 1, 1, [0.0, 0.0]), (1, 2, 1, None)], PATCH)
    assert [tuple(r) for r in patches.local_similarity(left, right, ["k"], "v").collect()] == [(1, 1, 0.0)]
    assert patches.local_similarity(left.where("false"), right, ["k"], "v").count() == 0


def test_pairs_of_patches_count_once(spark):
    source, target = grid(spark, lambda r, c: [1.0, float(r)], 2), grid(spark, lambda r, c: [1.0, float(c)] if (r, c) != (1, 1) else None, 2)
    size = F.struct(*[F.lit(v).alias(n) for n, v in (("height", 10), ("width", 10), ("rows", 2), ("cols", 2))])
    sizes = spark.range(1).select(F.lit(1).alias("k"), size.alias("source"), size.alias("target"))
    pairs = [(1, 0, 0, 9, 0), (1, 4, 4, 5, 4), (1, 5, 0, 0, 9), (1, 9, 9, 9, 9), (1, 5, 0, 0, 9)]
    got = patches.matched_similarity(spark.createDataFrame(pairs, "k int, source_row int, source_col int, target_row int, target_col int"), source, target, sizes, ["k"], "v").collect()
    assert [tuple(r) for r in got] == [(1, 2, pytest.approx(1.0), 2, 2, 0.5, 0.5)]


def test_two_of_three_vertices_decide(spark):
    vertices = spark.createDataFrame([(i, o) for i, o in enumerate((1, 1, 2, 3, None))], "v int, object int")
    rows = [(0, 1, 2), (2, 0, 1), (0, 2, 1), (0, 2, 3), (4, 9, 0), (0, 4, 9), (None, 0, 1)]
    got = patches.triangle_objects(spark.createDataFrame(rows, "a int, b int, c int"), vertices, [], "v", "a", "b", "c").collect()
    assert {(r.a, r.b, r.c): r.object for r in got} == dict(zip(rows, (1, 1, 1, 1, 0, 0, 1), strict=True))


def test_cameras_become_matrices(spark):
    good = [2.0, 0.0, 5.0, 0.0, 3.0, 6.0, 0.0, 0.0, 1.0]
    cases = [[2.0, 3.0, 5.0, 6.0], good, [0.0, 3.0, 5.0, 6.0], [2.0, float("nan"), 5.0, 6.0], [2.0, 3.0, float("inf"), 6.0], [2.0, None, 5.0, 6.0], good[:8] + [2.0], good[:5], [], None]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, v array<double>").select("i", patches.intrinsics_matrix(F.col("v")).alias("m"))
    assert [r.m for r in df.orderBy("i").collect()] == [good, good] + [None] * 8
