"""Control, consistency, horizon, smoothing and lenses by hand and against dense solutions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import vectors
from meridia.operators import control, smoothing


def test_control_by_hand(spark):
    track = lambda k, rows, frames: [(k, i, x, 0.0, rx, 0.0, err, 2.0, frames) for i, x, rx, err in rows]
    rows = track("a", [(0, 0.0, 0.0, 0.0), (1, 1.0, 9.0, 50.0), (2, 2.0, 4.0, 10.0), (4, 4.0, 4.0, 20.0)], 5)
    rows += track("gap", [(0, 0.0, 0.0, 1.0), (2, 1.0, 1.0, 1.0)], 5) + track("one", [(0, 0.0, 0.0, 1.0)], 1)
    df = spark.createDataFrame(rows, "k string, i long, x double, y double, rx double, ry double, err double, scale double, n long")
    got = {r.k: r for r in control.control_summary(df, ["k"], "i", ["x", "y"], ["rx", "ry"], "err", "scale", "n", 2).collect()}
    a = got["a"]
    assert (a.status, a.primary, a.translation_mean, a.rotation_mean) == ("ok", 3, pytest.approx(1 / 3), 10.0)
    assert a.translation_rmse == pytest.approx(math.sqrt(1 / 3)) and a.rotation_p95 == pytest.approx(19.0)
    assert a.ate == pytest.approx(math.sqrt((64 + 4) / 4)) and a.ate_normalized == pytest.approx(a.ate / 2)
    assert a.path_ratio == pytest.approx(4 / 14) and a.usable_ratio == 0.8
    assert (got["gap"].status, got["gap"].rotation_mean) == ("missing_samples", None) and got["one"].status == "too_few"
    events = spark.createDataFrame([("a", 0), ("a", 3), ("a", None), ("gap", 2)], "k string, i long")
    assert {r.k: (r.events, r.covered) for r in control.node_coverage(events, df, ["k"], "i").collect()} == {"a": (3, 1), "gap": (1, 1)}


def test_consistency_by_hand(spark):
    rows = [("v", "short", 4, True, [], 0.1), ("v", "short", 6, True, ["x"], 0.3), ("v", "short", 0, True, ["x", "y"], 9.0), ("v", "short", 1, True, [], float("nan")), ("v", "medium", 0, False, [], None)]
    df = spark.createDataFrame(rows, "k string, b string, n long, there boolean, why array<string>, e double")
    got = {r.b: r for r in control.consistency_by_baseline(df, ["k"], "b", "n", "there", "why", ["e"]).collect()}
    s = got["short"]
    assert (s.status, s.scheduled, s.available, s.usable, s.points, s.failure_reasons) == ("ok", 4, 4, 3, 11, {"x": 2, "y": 1})
    assert (s.e_mean, s.e_median, s.e_p95) == (pytest.approx(0.2), pytest.approx(0.2), pytest.approx(0.29))
    m = got["medium"]
    assert (m.status, m.scheduled, m.available, m.usable, m.points, m.e_mean, m.failure_reasons) == ("not_covered", 1, 0, 0, 0, None, {})


def test_horizon_by_hand(spark):
    pair = {"C": ("a", "b"), "D": ("a", "nowhere")}
    good = [0.0, 0.5, 1.5]
    rows = [(n, t, fps, {"a": 0, "b": 2}, pair) for n, t, fps in (("ok", good, 16.0), ("bad", good, 16.0), ("part", good, 16.0), ("none", good, 16.0), ("late", [0.5, 1.0], 16.0), ("back", [0.0, 0.0], 16.0), ("nan", [0.0, float("nan"), 1.0], 16.0), ("one", [0.0], 16.0), ("still", good, 0.0), ("null", None, 16.0))]
    cases = spark.createDataFrame(rows, "k string, timestamps array<double>, fps double, events map<string, int>, pairs map<string, struct<first: string, revisit: string>>")
    curves = spark.createDataFrame([("ok", "m", "ok"), ("ok", "l", "ok"), ("bad", "m", "not_covered"), ("bad", "l", "evaluator_failed"), ("part", "m", "not_covered"), ("part", "l", "ok"), ("none", "l", "ok"), ("ok", "other", "evaluator_failed"), ("one", "m", "ok")], "k string, metric string, status string")
    got = {r.k: r for r in control.horizon_record(cases, curves, ["k"], ("not_available", "invalid_input", "evaluator_failed"), ("m", "l")).collect()}
    assert {k: r.status for k, r in got.items()} == {"ok": "ok", "bad": "evaluator_failed", "part": "not_covered", "none": "not_available", **dict.fromkeys(("late", "back", "nan", "one", "still", "null"), "invalid_input")}
    assert got["ok"].duration == 1.5 and got["ok"].schedule["C"].asDict() == {"first_time": 0.0, "revisit_time": 1.5, "interval": 1.5} and got["ok"].schedule["D"].interval is None
    assert got["late"].schedule is None and got["none"].statuses == {"m": "not_available", "l": "ok"}


def turned(axis, angle):
    a = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def track(seed, n):
    rng = np.random.default_rng(seed)
    poses = np.tile(np.eye(4), (n, 1, 1))
    for i in range(n):
        poses[i, :3, :3] = turned((1, 2, 0.5), 2.9 + i / n + rng.normal() / 20)  # passes half a turn, where quaternions change sides
        poses[i, :3, 3] = [i / 8 + rng.normal() / 20, math.sin(i / 5), rng.normal() / 10]
    return poses


@pytest.mark.parametrize(("n", "marked"), [(4, []), (30, [7, 8, 9, 20]), (31, [1, 29]), (12, [0, 2, 4, 6, 8, 10]), (40, [13])])
def test_smoothing_equals_the_dense_solution(n, marked):
    poses, fixed = track(n, n), np.zeros(n, bool)
    fixed[marked] = True
    got = smoothing.smooth_track(poses, fixed, 16.0, 0.5)
    ends = fixed.copy()
    ends[[0, -1]] = True
    q = smoothing.quaternions(poses[:, :3, :3])
    assert np.allclose(smoothing.rotations(q), poses[:, :3, :3]) and (np.einsum("ij,ij->i", q[1:], q[:-1]) > 0).all()
    x = np.concatenate([poses[:, :3, 3], q], axis=1)
    d2 = np.zeros((n - 2, n))
    for r in range(n - 2):
        d2[r, r : r + 3] = 1, -2, 1
    h = np.eye(n) + d2.T @ d2 / (2 - 2 * math.cos(2 * math.pi * 0.5 / 16)) ** 2
    y = x.copy()
    y[~ends] = np.linalg.solve(h[~ends][:, ~ends], x[~ends] - h[~ends][:, ends] @ x[ends])
    assert np.allclose(got[:, :3, 3], y[:, :3]) and (got[ends] == poses[ends]).all()
    assert np.allclose(got[~ends, :3, :3], smoothing.rotations(y[~ends, 3:] / np.linalg.norm(y[~ends, 3:], axis=1, keepdims=True)))


def test_smoothing_of_odd_tracks(spark):
    poses = {"short": track(1, 3), "all": track(2, 6), "some": track(3, 20)}
    rows = [(k, i, p.ravel().tolist(), True if k == "all" else None) for k, t in poses.items() for i, p in reversed(list(enumerate(t)))]
    df = spark.createDataFrame(rows, "k string, i int, pose array<double>, w boolean").repartition(3)
    got = {(r.k, r.i): np.array(r.pose).reshape(4, 4) for r in smoothing.smooth_waypoints(df, ["k"], "i", "pose", "w").collect()}
    assert len(got) == 29
    for k, t in poses.items():
        expected = t if k != "some" else smoothing.smooth_track(t, np.zeros(20, bool), 16.0, 0.2)
        assert all(np.allclose(got[k, i], p, atol=1e-12) for i, p in enumerate(expected))
    flips = np.stack([np.eye(4)] * 9)
    for i in range(9):
        flips[i, :3, :3] = turned((0, 0, 1), i * math.pi / 4)
    with pytest.raises(ValueError):
        smoothing.smooth_track(flips, np.zeros(9, bool), 16.0, 0.01)


def test_lenses_are_inverted(spark):
    points = [(x / 10, y / 10) for x in range(-6, 7, 2) for y in range(-6, 7, 3)]
    df = spark.createDataFrame(points, "x double, y double")
    for lens in ((0.0, 0.0, 0.0, 0.0), (-0.2, 0.05, 0.01, -0.005), (0.1, -0.02, -0.004, 0.008)):
        k = [F.lit(v) for v in lens]
        seen = df.select("x", "y", vectors.distort(F.col("x"), F.col("y"), *k).alias("d"))
        for r in seen.select("*", vectors.undistort(F.col("d.x"), F.col("d.y"), *k).alias("b")).collect():
            r2 = r.x * r.x + r.y * r.y
            radial = 1 + lens[0] * r2 + lens[1] * r2 * r2
            assert r.d.x == pytest.approx(r.x * radial + 2 * lens[2] * r.x * r.y + lens[3] * (3 * r.x**2 + r.y**2), abs=1e-12)
            assert (r.b.x, r.b.y) == (pytest.approx(r.x, abs=1e-12), pytest.approx(r.y, abs=1e-12))
    # At this point 1 + 3 k1 r2 is 0, so the first step has no inverse.
    flat = spark.range(1).select(vectors.undistort(F.lit(1.0), F.lit(0.0), F.lit(-1 / 3), *[F.lit(0.0)] * 3).alias("b")).first().b
    assert flat.x is None


def held_by_loop(moves, seconds, rates, frames=12, least=0.1, tail=2.0):
    """[(start, end, keys)] of (x, y, z, yaw, pitch) moves, window by window."""
    second, debt, last, out = seconds / len(moves), [0.0, 0.0], [0, 0], []
    for lo in range(0, len(moves), frames):
        part = moves[lo : lo + frames]
        t0, span = lo * second, len(part) * second
        unit = [[v / max(math.sqrt(m[0] ** 2 + m[1] ** 2 + m[2] ** 2), 1e-12) for v in m[:3]] for m in part]
        keys = []
        for axis, pos, neg in ((2, "W", "S"), (0, "D", "A")):
            votes = sum(u[axis] > 0.5 for u in unit) - sum(u[axis] < -0.5 for u in unit)
            keys += [pos] if votes > len(unit) / 2 else [neg] if votes < -len(unit) / 2 else []
        looks = []
        for a, (pos, neg) in enumerate((("L", "J"), ("I", "K"))):
            turn = sum(m[3 + a] for m in part)
            sign = (turn > 0.05) - (turn < -0.05)
            if sign and last[a] and sign != last[a]:
                debt[a] = 0.0
            error = debt[a] + turn
            hold = min(abs(error) / rates[a], span) if sign else 0.0
            hold = 0.0 if hold < least else hold
            debt[a] = error - sign * hold * rates[a]
            last[a] = sign or last[a]
            looks.append((hold, pos if sign > 0 else neg))
        cuts = sorted({0.0, span, *[h for h, _ in looks if 0 < h < span]})
        for x, y in zip(cuts, cuts[1:], strict=False):
            now = keys + [k for h, k in looks if h > x + 1e-9]
            if out and out[-1][2] == now:
                out[-1] = (out[-1][0], t0 + y, now)
            else:
                out.append((t0 + x, t0 + y, now))
    return [*out, (seconds, seconds + tail, [])]


def test_timed_actions_equal_a_loop(spark, sf_dir):
    from meridia.plans import catalogue
    from meridia.plans.metric_queries import timed_moves

    tracks, got = {}, {}
    for r in timed_moves(spark, sf_dir).orderBy("k", "i").collect():
        tracks.setdefault(r.k, []).append((r.x, r.y, r.z, r.yaw, r.pitch))
    for r in catalogue.QUERIES["timed_actions"](spark, sf_dir).collect():
        got.setdefault(r.k, []).append((r.start_s, r.end_s, list(r.pressed)))
    assert got.keys() == tracks.keys() and len(tracks) > 10
    seen = set()
    for k, moves in tracks.items():
        expected = held_by_loop(moves, 20.0, (20.0, 15.0))
        ours = sorted(got[k], key=lambda x: (x[0], x[1]))
        assert [x[2] for x in ours] == [x[2] for x in expected]
        assert all(abs(a - b) < 1e-9 for x, y in zip(ours, expected, strict=True) for a, b in zip(x[:2], y[:2], strict=True))
        seen |= {key for x in expected for key in x[2]}
    assert seen >= set("WLJIK")
