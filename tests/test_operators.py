"""Small fixtures with known values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import numeric, text, vectors
from meridia.operators import curation, diagnostics, ingest, matching, pairing, sampling, scoring, sequences, spatial, timewindows
from meridia.plans import rules


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_scores(spark):
    values = [0.05, 0.3, -0.1, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    got = [tuple(r) for r in df.select(numeric.error_score(v, 0.2), numeric.unit_score(v)).collect()]
    assert got[0] == pytest.approx((75, 5))
    assert got[1] == pytest.approx((0, 30))
    assert got[2] == pytest.approx((100, 0))
    assert got[3:] == [(None, None)] * 3
    assert one(spark, x=numeric.linear_score(F.lit(12.0), F.lit(10.0), F.lit(20.0), F.lit(1)))["x"] == pytest.approx(20)


def test_means(spark):
    a, n = F.lit(80.0), F.lit(None).cast("double")
    assert one(spark, s=numeric.strict_mean(a, n), m=numeric.lenient_mean(a, n), none=numeric.lenient_mean(n)) == {"s": None, "m": 80.0, "none": None}


def test_knots(spark):
    points = ((400.0, 2.0), (500.0, 2.25), (500.0, 3.0), (600.0, 4.0))
    got = [one(spark, x=numeric.knots(F.lit(v).cast("double"), points))["x"] for v in (475.0, 100.0, 700.0, 500.0, 550.0, None)]
    assert got == [2.1875, 2.0, 4.0, 2.25, 3.5, None]


@pytest.mark.parametrize(("duration", "expected"), [(22.25, [(0, 5), (5, 10), (10, 15), (15, 20), (17.25, 22.25)]), (60.0, [(i, i + 5) for i in range(0, 60, 5)]), (3.0, [(0, 3)]), (5.0, [(0, 5)])])
def test_window_bounds(spark, duration, expected):
    got = one(spark, w=timewindows.window_bounds(F.lit(duration)))["w"]
    assert [(w.start, w.stop) for w in got] == expected


def test_a_sample_in_an_overlap_counts_twice(spark):
    df = spark.createDataFrame([(18.0,), (22.25,), (4.999,), (30.0,)], "t double")
    got = sorted((r.t, r.window) for r in timewindows.in_windows(df, "t", 22.25).collect())
    assert got == [(4.999, 0), (18.0, 3), (18.0, 4), (22.25, 4)]


@pytest.mark.parametrize(("means", "level", "kept"), [([90, 80, 95, None], 88.333333, 95.0), ([None, 80], None, None), ([90], None, None), ([90, None], None, None)])
def test_retention(spark, means, level, kept):
    df = spark.createDataFrame([("k", i, None if m is None else float(m)) for i, m in enumerate(means)], "k string, window long, mean double")
    r = timewindows.retention(df, ["k"]).first()
    assert (r.level, r.retention) == (pytest.approx(level) if level else None, kept)


def test_changes_reset_after_a_gap(spark):
    df = spark.createDataFrame([("k", 0, 5.0), ("k", 1, None), ("k", 2, 3.0)], "k string, window long, mean double")
    got = [(r.from_first, r.from_previous) for r in timewindows.window_changes(df, ["k"]).orderBy("window").collect()]
    assert got == [(0.0, None), (None, None), (2.0, None)]


def test_rank(spark):
    df = spark.createDataFrame([("a", 70.0), ("b", 80.0), ("c", 80.0), ("d", None)], "model string, v double").withColumn("group", F.lit("world"))
    assert {r.model: r.v_rank for r in scoring.ranked(df, ["v"]).collect()} == {"a": 3, "b": 1, "c": 1, "d": None}


@pytest.mark.parametrize(("n", "m", "expected"), [(10, 4, [0, 3, 6, 9]), (8, 3, [0, 3, 7]), (3, 5, [0, 1, 2]), (0, 5, []), (9, 1, [0])])
def test_linspace(spark, n, m, expected):
    assert one(spark, x=sampling.linspace(F.lit(n), m))["x"] == expected


@pytest.mark.parametrize(("pool", "expected"), [([0, 3, 8, 9, 16], [(0, 8), (3, 9), (8, 16)]), ([0, 6, 10, 20], [(0, 6), (6, 10), (10, 20)])])
def test_nearest_after(spark, pool, expected):
    df = spark.createDataFrame([("c", i) for i in pool], "c string, i long")
    got = sorted((r.left, r.right) for r in sampling.nearest_after(df, ["c"], "i", 8).collect())
    assert got == expected


def test_context_and_heldout(spark):
    got = one(spark, s=sampling.context_heldout(F.lit(10), 4, 2), none=sampling.context_heldout(F.lit(5), 4, 2))
    assert (got["s"].heldout, got["s"].context, got["none"]) == ([2, 7], [0, 3, 6, 9], None)


def test_quarters_and_frames(spark):
    got = [one(spark, q=sampling.quarters(F.lit(a), F.lit(b)))["q"] for a, b in ((0, 10), (4, 5), (3, 6), (7, 7))]
    assert got == [[3, 5, 8, 10], [5], [4, 5, 6], None]
    spans = [[tuple(w) for w in one(spark, w=sampling.overlapping_windows(F.lit(n), 24, 8))["w"]] for n in (0, 24, 25, 41)]
    assert spans == [[(0, 24)], [(0, 24)], [(0, 24), (16, 40)], [(0, 24), (16, 40), (32, 56)]]
    with pytest.raises(ValueError):
        sampling.overlapping_windows(F.lit(9), 8, 8)
    got = [one(spark, f=matching.timestamp_to_frame(F.lit(t), 16.0, F.lit(357)))["f"] for t in (1.0, 22.25, 22.3, 0.03125)]
    assert got == [16, 356, None, 0]


def test_scale_and_error(spark):
    df = spark.createDataFrame([("k", 2.0, 1.0), ("k", 4.0, 2.0), ("k", 8.0, 2.0), ("k", 0.0, 1.0)], "k string, ref double, est double")
    r = spatial.median_scale_error(df, ["k"], "ref", "est").first()
    assert (r.scale, r.abs_rel) == (2.0, pytest.approx(1 / 6))
    pairs = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 4.0)], "k string, e double, r double")
    assert sequences.positive_scale(pairs, ["k"], ["e"], ["r"]).first().scale == 2.0
    assert sequences.positive_scale(pairs.withColumn("e", F.lit(0.0)), ["k"], ["e"], ["r"]).first().scale == 1.0


def test_voxels(spark):
    df = spark.createDataFrame([(0.125,), (-0.025,), (0.0249,)], "x double")
    assert [r[0] for r in df.select(spatial.voxel(F.col("x"), 0.05)).collect()] == [3, 0, 0]
    assert one(spark, f=spatial.f_score(F.lit(1), F.lit(2), F.lit(1), F.lit(1)))["f"] == pytest.approx(2 / 3)


def test_frontmost_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(0, 0, 0.5, 7), (0, 0, 0.5, 2), (0, 0, 0.9, 1)], "r int, c int, z double, n int")
    assert spatial.frontmost(df, ["r", "c"], "z", ["n"], []).first().n == 2


def test_strength(spark):
    got = [one(spark, g=curation.strength(F.lit(a), F.lit(b), F.lit(v)))["g"] for a, b, v in ((0.39, 0.9, True), (0.40, 0.9, True), (0.05, 0.9, True), (0.5, 0.9, False))]
    assert got == ["moderate", "strong", "weak", "invalid"]


def test_gates_refuse_bad_thresholds():
    good = {k: 1.0 for k in curation.REQUIRED_KEYS}
    for bad in ({}, {**good, "else": 1.0}, {**good, "minimum_translation_m": 0.0}, {**good, "minimum_translation_m": -1.0}, {**good, "minimum_translation_m": math.inf}):
        with pytest.raises(ValueError):
            curation.gate({}, bad)


def test_image_statistics(spark):
    df = spark.createDataFrame([("k", float(i), float(i) + 10) for i in range(50)], "k string, a double, b double")
    assert spatial.image_statistics(df, ["k"], "a", "b").first().psnr == pytest.approx(28.1308, abs=1e-4)
    assert spatial.image_statistics(df, ["k"], "a", "a").first().psnr == 100.0


def test_vectors(spark):
    a, zero = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, c=vectors.cosine(a, a), z=vectors.cosine(a, zero)) == {"c": pytest.approx(1.0), "z": 0.0}
    pose = vectors.yaw_pose(F.lit(30.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    got = one(spark, m=vectors.product(pose, vectors.rigid_inverse(pose)), r=vectors.rotation_degrees(pose), u=vectors.rotation_degrees(pose, stable=False), p=vectors.rigid_problems(pose), short=vectors.rigid_problems(F.array(F.lit(1.0))))
    assert got["m"] == pytest.approx([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], abs=1e-12)
    assert (got["r"], got["u"], got["p"], got["short"]) == (pytest.approx(30), pytest.approx(30), [], ["size"])
    q = one(spark, q=vectors.quaternion_matrix(*[F.lit(x) for x in (0.0, math.sin(math.pi / 12), 0.0, math.cos(math.pi / 12))]))["q"]
    assert q == pytest.approx([math.cos(math.pi / 6), 0, 0.5, 0, 1, 0, -0.5, 0, math.cos(math.pi / 6)])


def test_texts(spark):
    c = lambda f, v: one(spark, x=f(F.lit(v)))["x"]
    assert c(text.slug, "Some_my clip!.v2") == "Some_my_clip_v2"
    assert [c(text.prompt, p) for p in ("Red  Door", "left door", "door and sign", "road sign", "a b c d e", "asphalt road", "overhead lamp", "front door", "")] == ["red door", None, None, "road sign", None, None, None, "front door", None]
    listed = [one(spark, x=text.prompts(F.array(*map(F.lit, v))))["x"] for v in (("door", "Door", "red door"), ("door",), ("door", "the sky"), ("a", "b", "c", "d", "e"))]
    assert listed == [["door", "red door"], None, None, None]
    assert c(text.caption_of, '```json\n{"dense_caption": "a  b"}\n```') == "a b"
    assert c(text.caption_of, '{"dense_caption": "a", "more": 1}') is None
    assert c(text.without_plane_phrases, "on the left, a tree in the background stands") == "A tree stands"
    assert c(text.last_number, "frame_0012_b") == 12
    assert [c(text.safe_name, n) for n in ("a.b", "..", "a/b", "")] == [True, False, False, False]


def test_tree_is_strict(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (1.0, 3.0, 8.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(scoring.fold({"x": ["a", "b"], "y": "c"})).collect()] == [None, 5.0]
    assert len(rules.RULES) == 37


def test_upsert_and_resume(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 1, "z"), ("a", 2, "y")], "k string, at long, v string")
    assert sorted(map(tuple, ingest.latest(rows, ["k"], ["at"]).collect())) == [("a", 3, None), ("b", 1, "z")]
    assert [r.k for r in ingest.remaining(rows, rows.where("k = 'a'"), ["k"]).collect()] == ["b"]


def test_mutual_matches(spark):
    df = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.5), (2, 10, 0.3), (2, 11, 0.31), (3, 12, 0.1)], "a long, b long, d double")
    assert [(r.a, r.b) for r in matching.mutual_matches(df, "a", "b", "d", 0.9).collect()] == [(1, 10)]  # 3 and 12 have no second


def test_votes_of_moves(spark):
    rows = [("w", 0.1, 0.0, 5.0), ("w", 0.0, 0.1, 9.0), ("w", -3.0, 0.0, 0.1), ("no", 1.0, 0.0, 0.0), ("no", -1.0, 0.0, 0.0), ("half", 1.0, 0.0, 0.0), ("half", 0.0, 0.0, 0.0), ("a", -2.0, 0.0, -2.0), ("up", 0.1, 9.0, 0.2)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    got = {r.k: r.pressed for r in sequences.vote_keys(df, ["k"], {"z": ("W", "S"), "x": ("D", "A")}, ("x", "y", "z")).collect()}
    assert got == {"w": ["W"], "no": [], "half": [], "a": ["S", "A"], "up": []}


def test_spaced_walks_down(spark):
    df = spark.createDataFrame([("k", i) for i in (5, 10, 11, 12, 13, 23, 24, 25)] + [("one", 3)], "k string, i long")
    got = sorted((r.k, r.place, r.i) for r in pairing.spaced(df, ["k"], "i", 12).collect())
    assert got == [("k", 1, 25), ("k", 2, 13), ("one", 1, 3)]


def test_long_keys_take_linear_time(spark):
    """A window that looked ahead from each row would take hours."""
    import time

    start = time.perf_counter()
    track = spark.range(300_000).select(F.lit("k").alias("k"), (F.col("id") * 1.0).alias("t"), (F.col("id") % 7 * 1.0).alias("x"), "id")
    queries = track.select("k", (F.col("t") + 0.5).alias("t"))
    assert matching.asof_interpolate(queries, track, ["k"], "t", ["x"]).where("x IS NULL").count() == 1
    assert sampling.nearest_after(track, ["k"], "id", 8).count() == 300_000 - 8
    assert time.perf_counter() - start < 60


def test_slerp_takes_the_shorter_arc(spark):
    track = spark.createDataFrame([("k", t, *q) for t, q in ((0.0, (0.0, 0.0, 0.0, 1.0)), (1.0, (0.0, -1.0, 0.0, 0.0)), (2.0, (0.0, 1.0, 0.0, 1e-9)), (3.0, (0.0, -0.6, 0.0, -0.8)))], "k string, t double, x double, y double, z double, w double")
    queries = spark.createDataFrame([("k", t) for t in (0.5, 1.0, 1.5, 3.0, 3.5)], "k string, t double")
    got = {r.t: r for r in matching.asof_interpolate(queries, track, ["k"], "t", [], ["x", "y", "z", "w"]).collect()}
    assert abs(got[0.5].y) == pytest.approx(math.sqrt(0.5)) and got[0.5].w == pytest.approx(math.sqrt(0.5))
    assert abs(got[1.5].y) == pytest.approx(1) and (got[1.0].y, got[3.0].w, got[3.5].w) == (-1.0, -0.8, None)


def test_nearest_distances_by_force(spark):
    import random

    from meridia.operators import evaluation

    rng = random.Random(3)
    side = lambda n, k: [(k, i, rng.uniform(0, 40) ** 1.5, rng.uniform(0, 3)) for i in range(n)]
    a, b = side(60, "p") + side(5, "alone"), side(40, "p") + [("other", 0, 1.0, 1.0)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, id long, x double, y double")
    got = {(r.k, r.id): r.distance for r in evaluation.nearest_distances(frame(a), frame(b), ("k",), ["x", "y"], "id", 0.5).collect()}
    expected = {(k, i): min(math.dist((x, y), (u, v)) for m, _, u, v in b if m == k) for k, i, x, y in a if k == "p"}
    assert got == pytest.approx(expected)


def test_validity_ratios_by_hand(spark):
    """Golden cases: all frames, a plan, an invalid plan, frames out of range, nothing provided, no frames at all."""
    cases = spark.createDataFrame(
        [(1, 4, 4, 1.0, None), (2, 4, 4, 1.0, [0, 2]), (3, 4, 4, 1.0, [1, 2]), (4, 4, 3, 0.75, None), (5, 4, 9, 1.0, None), (6, 0, 0, 1.0, None), (7, 4, 4, 1.0, [0, 4]), (8, 4, 4, 1.0, []), (9, 4, 4, 1.0, [0, 2, 2])],
        "case_id long, expected long, decoded long, decode_ratio double, plan array<long>",
    )
    frames = [(1, k, f) for k in ("pose", "depth") for f in (0, 1, 2, 3, 3)] + [(2, "pose", 0), (2, "pose", 1), (2, "depth", 0), (2, "depth", 2), (4, "pose", -1), (4, "pose", 7), (4, "depth", 3), (3, "pose", 1)]
    out = diagnostics.validity_ratios(cases, spark.createDataFrame(frames, "case_id long, kind string, frame_index long"))
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    assert got == {
        1: ("ok", 4, 1.0, 1.0, 1.0, 0, 0, True),
        2: ("ok", 2, 1.0, 0.5, 1.0, 1, 0, False),
        3: ("invalid_plan", 2, None, None, None, None, None, None),
        4: ("ok", 4, 0.75, 0.0, 0.25, 2, 0, False),
        5: ("ok", 4, 1.0, 0.0, 0.0, 0, 0, False),
        6: ("ok", 0, 0.0, 0.0, 0.0, 0, 0, False),
        7: ("invalid_plan", 2, None, None, None, None, None, None),
        8: ("invalid_plan", 0, None, None, None, None, None, None),
        9: ("invalid_plan", 3, None, None, None, None, None, None),
    }
