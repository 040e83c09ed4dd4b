"""Nearest neighbours, revisit search, dense projection, nested records and temporal dimensions against loops and by hand."""

from __future__ import annotations

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from meridia.operators import diagnostics, evaluation, neighbours, pairing, projection, revisits, timewindows


def clouds(seed):
    """(key, left, right): scattered, clustered, far apart, repeated, alone and missing points."""
    rng = random.Random(seed)
    cloud = lambda n, spread, shift: [tuple(rng.gauss(0, spread) + shift for _ in range(3)) for _ in range(n)]
    yield "mixed", cloud(40, 5, 0), cloud(150, 1, 0) + cloud(20, 40, 0)
    yield "far", cloud(60, 1, 0), cloud(200, 1, 500)
    yield "grid", [(x + 0.5, float(y), 0.0) for x in range(-3, 4) for y in range(3)], [(float(x), float(y), float(z)) for x in range(-3, 4) for y in range(-3, 4) for z in range(2)] * 2
    yield "few", cloud(5, 2, 0), cloud(2, 2, 0)
    yield "none", cloud(3, 1, 0), []


@pytest.mark.parametrize(("k", "width"), [(1, 0.5), (4, 3.0), (16, 1.0)])
def test_nearest_k_equals_brute_force(spark, k, width):
    made = list(clouds(k))
    frame = lambda i: spark.createDataFrame([(key, *p, "x") for key, *sides in made for p in sides[i]], "key string, x double, y double, z double, near string")
    expected = {}
    for key, left, right in made:
        for p in set(left):
            best = sorted((sum((a - b) ** 2 for a, b in zip(p, r, strict=True)), r) for r in set(right))[:k]
            expected.update({(key, p, i): (r, math.sqrt(d)) for i, (d, r) in enumerate(best, 1)})
    got = {(r.key, (r.x, r.y, r.z), r.place): (tuple(r.near), r.distance) for r in neighbours.nearest_k(frame(0), frame(1), ["key"], ["x", "y", "z"], k, width).collect()}
    assert got.keys() == expected.keys()
    assert all(got[e][0] == expected[e][0] and abs(got[e][1] - expected[e][1]) < 1e-9 for e in expected)


def test_nearest_k_of_odd_rows(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", float("nan"), 0.0), (None, 1.0, 1.0), ("a", -0.5, 2.0)], "key string, x double, y double")
    assert [(r.x, r.y, r.distance) for r in neighbours.nearest_k(df, df, ["key"], ["x", "y"], 2, 1.0).collect()] == [(-0.5, 2.0, 0.0)]
    assert neighbours.nearest_k(df, df.where("false"), ["key"], ["x", "y"], 2, 1.0).collect() == []


def test_clouds_far_apart_meet_in_few_pairs(spark):
    """The pairs that the last step looks at, of 1,000 times 1,000 points at a distance of 1,000."""
    rng = random.Random(8)
    frame = lambda shift: spark.createDataFrame([("k", rng.random() * 20 + shift, rng.random() * 20) for _ in range(1000)], "key string, x double, y double")
    left, right = frame(0.0), frame(1000.0)
    near = neighbours.nearest_k(left, right, ["key"], ["x", "y"], 1, 0.5)
    assert near.count() == 1000
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    metrics = {}

    def walk(node):
        if node.nodeName().startswith(("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")):
            metrics[node.nodeName() + str(len(metrics))] = node.metrics().apply("numOutputRows").value()
        for child in [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)

    near.collect()
    plan = near._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan)
    assert max(metrics.values(), default=0) < 200_000


def test_box_clearance_by_hand(spark):
    centres = spark.createDataFrame([("k", 1.0, 1.0), ("k", 9.0, 1.0)], "key string, x double, y double")
    asked = spark.createDataFrame([("k", 1.5, 0.2), ("k", 5.0, 1.0), ("k", 12.0, 6.0), ("other", 0.0, 0.0)], "key string, x double, y double")
    got = {(r.x, r.y): r.clearance for r in neighbours.box_clearance(asked, centres, ["key"], ["x", "y"], 2.0).collect()}
    assert got == {(1.5, 0.2): 0.0, (5.0, 1.0): 3.0, (12.0, 6.0): pytest.approx(math.hypot(2, 4))}


def test_coarse_to_fine_finds_what_the_exhaustive_search_of_its_set_finds(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(5), rng.randrange(3)) for k in range(12) for i in sorted(rng.sample(range(1, 60), rng.randrange(1, 30)))]
    asked = []

    def score(df):
        asked.append(df)
        return df.withColumn("value", F.col("a") * 10 + F.col("b"))

    df = spark.createDataFrame(rows, "k int, at int, a int, b int")
    got = {r.k: (r.at, r.value) for r in revisits.coarse_to_fine(df, ["k"], "at", score, [F.col("value"), F.col("b")]).collect()}
    expected, scored = {}, 0
    for k, group in itertools.groupby(rows, key=lambda r: r[0]):
        down = sorted(group, key=lambda r: -r[1])
        key = lambda r: (r[2] * 10 + r[3], r[3], r[1])
        coarse = down[::4]
        near = max(coarse, key=key)[1]
        every = coarse + [r for i, r in enumerate(down) if i % 4 and abs(r[1] - near) <= 3]
        scored += len(every)
        best = max(every, key=key)
        expected[k] = (best[1], best[2] * 10 + best[3])
    assert got == expected
    assert sum(d.count() for d in asked) == scored < len(rows)


def test_mirrored_pairs_by_hand(spark):
    """A path of 9 frames out and back: the turn is frame 4, the stop frame 8."""
    x = [0.0, 1.0, 2.0, 3.0, 4.0, 3.1, 2.0, 5.0, 0.0]
    yaw = [0.0, 170.0, 20.0, 30.0, 40.0, 30.0, 50.0, -175.0, 0.0]
    frames = spark.createDataFrame([("c", i, a, b) for i, (a, b) in enumerate(zip(x, yaw, strict=True))], "case string, i long, x double, yaw double")
    turns = spark.createDataFrame([("c", 4, 8)], "case string, turn long, stop long")
    pairs = lambda **bounds: sorted((r.first, r.revisit, round(r.distance, 6), round(r.angle_error, 6)) for r in revisits.mirrored_pairs(frames, turns, ["case"], "i", ["x"], "yaw", 2, **bounds).collect())
    assert pairs() == [(3, 5, 0.1, 0.0)]
    assert pairs(most_distance=None) == [(1, 7, 4.0, 15.0), (3, 5, 0.1, 0.0)]
    assert pairs(most_distance=None, most_angle=30.0) == [(1, 7, 4.0, 15.0), (2, 6, 0.0, 30.0), (3, 5, 0.1, 0.0)]


IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]


def scene(spark, depth, source_depth, pose=None):
    """Two views of 4x4 pixels that look along z with a focal length of 2; colours are the columns."""
    pixels = lambda d: spark.createDataFrame([(1, r, c, float(d[r][c]), d[r][c] > 0, [float(10 * c)] * 3) for r in range(4) for c in range(4)], "k int, row int, col int, depth double, valid boolean, rgb array<double>")
    camera = F.struct(*[F.lit(v).alias(n) for n, v in (("fx", 2.0), ("fy", 2.0), ("cx", 2.0), ("cy", 2.0))])
    poses = [F.array(*[F.lit(float(v)) for v in p]).alias(n) for n, p in (("target_pose", IDENTITY), ("source_pose", pose or IDENTITY))]
    cameras = spark.range(1).select(F.lit(1).alias("k"), *[camera.alias(n) for n in ("target_rgb", "target_depth", "source_rgb", "source_depth")], *poses)
    t, s = pixels(depth), pixels(source_depth)
    return {(r.row, r.col): r for r in projection.dense_projection(t, t, s, s, cameras, ["k"]).collect()}, t, s


def test_projection_onto_itself_and_occlusion(spark):
    flat = [[4.0] * 4 for _ in range(4)]
    got, _, _ = scene(spark, flat, flat)
    assert len(got) == 16 and all(r.support and r.depth_absrel == 0 and r.rgb_mae == 0 and (r.source_row, r.source_col) == k for k, r in got.items())
    near, hole = [list(r) for r in flat], [list(r) for r in flat]
    near[1][2], near[2][2], hole[0][0] = 2.0, 3.7, 0.0
    got, _, _ = scene(spark, hole, near)
    assert got[1, 2].candidate and not got[1, 2].support and got[1, 2].depth_absrel == 1.0
    assert got[2, 2].support and got[2, 2].depth_absrel == pytest.approx(0.3 / 3.7)
    assert not got[0, 0].candidate and got[0, 0].depth_absrel is None and got[0, 0].rgb_mae is None


def test_projection_of_a_moved_camera(spark):
    """A step of 2 to the right at depth 4 and focal length 2 moves the picture one column to the left; behind the camera nothing is seen."""
    flat, right, ahead = [[4.0] * 4 for _ in range(4)], list(IDENTITY), list(IDENTITY)
    right[3], ahead[11] = 2.0, 5.0
    got, t, s = scene(spark, flat, flat, right)
    assert all((r.source_row, r.source_col) == (row, col - 1) and r.support == (col > 0) for (row, col), r in got.items())
    assert all(r.rgb_mae == pytest.approx(10 / 255) for (_, col), r in got.items() if col)
    behind, _, _ = scene(spark, flat, flat, ahead)
    assert all(not r.candidate and r.source_row is None for r in behind.values())
    p = spark.createDataFrame(list(got.values()))
    mask = t.where("row < 2").select("k", "row", "col", F.lit("a").alias("anchor"))
    one = projection.anchor_support(p, mask, s.where("col >= 1").select("k", "row", "col", F.lit("a").alias("anchor")), ["k"], "anchor").first()
    assert (one.mask_pixels, one.support_pixels, one.supported_fraction, one.depth_absrel, one.rgb_mae) == (8, 4, 0.5, 0.0, pytest.approx(10 / 255))


def test_records_at_any_depth(spark):
    deep = {"s": 1, "t": 2, "inner": {"s": 3, "t": 4}}
    for _ in range(12):
        deep = {"a": [deep, 5], "b": None}
    rows = [(1, json.dumps(deep)), (2, json.dumps([{"s": i, "t": None} for i in range(3)] + [{"s": 9}])), (3, None), (4, "no json"), (5, "7"), (6, "{}")]
    found = diagnostics.json_records(spark.createDataFrame(rows, "id int, doc string"), ["id"], "doc", ("s", "t"))
    got = sorted((r.id, r.path, r.s) for r in found.select("id", "path", F.try_variant_get("v", "$.s", "int").alias("s")).collect())
    assert got == [(1, [0, 0] * 12, 1), (2, [0], 0), (2, [1], 1), (2, [2], 2)]


def test_dimensions_are_lenient_inside_and_strict_outside(spark):
    dims, pairs = {"q": ("a", "b"), "g": ("d", "c")}, {"d": ("d1", "d2")}
    rows = [
        ("all", "a", 50.0, 80.0), ("all", "b", 70.0, 100.0), ("all", "d1", 10.0, 90.0), ("all", "d2", 30.0, 70.0), ("all", "c", 40.0, 60.0),
        ("gaps", "a", 50.0, 80.0), ("gaps", "b", None, None), ("gaps", "d2", 30.0, 70.0),
        ("no_g", "a", 50.0, 80.0), ("no_g", "c", 40.0, None), ("none", "a", None, None),
    ]
    df = spark.createDataFrame(rows, "model string, name string, level double, retention double")
    out = timewindows.dimension_retention(df, ["model"], "name", dims, pairs)
    got = {r.model: (r.dimensions.asDict(True), r.score) for r in out.collect()}
    part = lambda a, b: {"level": a, "retention": b}
    assert got["all"] == ({"q": part(60.0, 90.0), "g": part(30.0, 70.0)}, pytest.approx((0.3 * 60 + 0.7 * 90 + 0.3 * 30 + 0.7 * 70) / 2))
    assert got["gaps"] == ({"q": part(50.0, 80.0), "g": part(30.0, 70.0)}, pytest.approx((0.3 * 50 + 0.7 * 80 + 0.3 * 30 + 0.7 * 70) / 2))
    assert got["no_g"] == ({"q": part(50.0, 80.0), "g": None}, None) and got["none"] == ({"q": None, "g": None}, None)
    only = timewindows.dimension_retention(df, ["model"], "name", dims, pairs, only=F.col("model") == "all", without={"q": ("b",)})
    assert {r.model: r.dimensions.q.level for r in only.collect() if r.dimensions.q} == {"all": 70.0, "gaps": 50.0, "no_g": 50.0}


def test_nearest_distances_keep_repeated_rows(spark):
    left = spark.createDataFrame([("k", 1, 0.0), ("k", 2, 0.0), ("k", 3, 7.0), ("lone", 4, 1.0)], "k string, id int, x double")
    right = spark.createDataFrame([("k", 9, 2.0), ("k", 9, 2.0)], "k string, id int, x double")
    assert sorted((r.id, r.distance) for r in evaluation.nearest_distances(left, right, ("k",), ["x"], "id", 0.5).collect()) == [(1, 2.0), (2, 2.0), (3, 5.0)]


def test_latest_passing_by_hand(spark):
    """Frames 0 to 12, tested at 12, 8, 4, 0: 4 is the latest of them that passes, 7 the latest between 4 and 8, and 10 isn't looked at."""
    df = spark.createDataFrame([("a", i, i in (1, 4, 7, 10)) for i in range(13)] + [("b", i, i == 3) for i in range(5)] + [("c", 9, True)], "k string, i long, ok boolean")
    assert sorted(map(tuple, pairing.latest_passing(df, ["k"], "i", lambda d: d.where("ok")).collect())) == [("a", 7), ("c", 9)]


def test_spaced_by_hand(spark):
    df = spark.createDataFrame([("k", i) for i in (0, 5, 9, 10, 20, 20, 31, 40, 52)] + [("one", 3)], "k string, i long")
    got = lambda most: sorted((r.k, r.place, r.i) for r in pairing.spaced(df, ["k"], "i", 10, most).collect())
    assert got(5) == [("k", 1, 52), ("k", 2, 40), ("k", 3, 20), ("k", 4, 10), ("k", 5, 0), ("one", 1, 3)]
    assert got(2) == [("k", 1, 52), ("k", 2, 40), ("one", 1, 3)]


def test_sessions_by_hand(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2024-01-01 00:00:00', 1.0D), ('a', TIMESTAMP'2024-01-01 00:09:59', 3.0D), ('a', TIMESTAMP'2024-01-01 00:20:00', 9.0D), ('b', TIMESTAMP'2024-01-01 00:00:00', CAST('NaN' AS DOUBLE)) AS t(k, at, v)")
    got = sorted((r.k, r.n, r.mean, (r.stop - r.start).total_seconds()) for r in timewindows.sessions(df, ["k"], "at", "10 minutes", "v").collect())
    assert got == [("a", 1, 9.0, 600.0), ("a", 2, 2.0, 1199.0), ("b", 1, None, 600.0)]
