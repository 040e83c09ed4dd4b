from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meridia.operators import trajectories


@pytest.fixture(scope="module")
def routes(spark):
    rows = [(i, t, 2.0, 4.0, 1.0, 40.0) for i, t in enumerate(("forward_backward", "lateral_out_and_back", "yaw_return", "peek_occlude_retract"))]
    rows += [(10, "unknown", 2.0, 4.0, 1.0, 40.0), (11, "forward_backward", 200.0, 900.0, 1.0, 40.0)]
    return spark.createDataFrame(rows, "r long, template string, distance double, far double, side double, turn double")


def test_events_share_out_all_intervals(routes):
    got = {r.r: (r.frames, r.feasible) for r in trajectories.allocate(routes, ["r"]).collect()}
    assert got[10] == (None, False) and got[11] == (None, False)
    for r in range(4):
        frames, feasible = got[r]
        assert feasible and frames[0] == 0 and frames[-1] == 356 and all(a < b for a, b in zip(frames[:-1], frames[1:], strict=True))


def test_poses_keep_ends_revisits_and_limits(routes):
    tracks, events = {}, {}
    for p in trajectories.poses(routes, ["r"]).orderBy("r", "frame_index").collect():
        tracks.setdefault(p.r, []).append(p)
    for e in trajectories.event_frames(routes, ["r"]).collect():
        events.setdefault(e.r, {})[e.event] = e.frame_index
    assert sorted(tracks) == [0, 1, 2, 3]
    for r, track in tracks.items():
        assert [p.frame_index for p in track] == list(range(357))
        at = lambda name: track[events[r][name]]  # noqa: B023, E731
        spot = lambda p: (p.x, p.z, p.yaw)
        assert spot(at("q0")) == pytest.approx((0, 0, 0)) == spot(at("q0_return"))
        assert spot(at("qc_first")) == pytest.approx(spot(at("qc_revisit")))
        steps = [((b.x - a.x) ** 2 + (b.z - a.z) ** 2) ** 0.5 * trajectories.FPS for a, b in zip(track[:-1], track[1:], strict=True)]
        assert max(steps) <= trajectories.MOVE_LIMITS[0] * 1.01
        assert max(abs(b.yaw - a.yaw) * trajectories.FPS for a, b in zip(track[:-1], track[1:], strict=True)) <= trajectories.TURN_LIMITS[0] * 1.01


def test_a_broken_return_is_found(routes):
    one = routes.where("r = 0")
    track = trajectories.poses(one, ["r"]).withColumn("z", F.when(F.col("frame_index") == 356, 0.5).otherwise(F.col("z")))
    assert trajectories.route_checks(track, trajectories.event_frames(one, ["r"]), ["r"]).first().problems == ["return"]
