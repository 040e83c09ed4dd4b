from __future__ import annotations

import math

import pytest

from meridia.operators import long_routes

TRACK = "r long, frame_index int, x double, y double, z double, yaw double"
ROUTE = "r long, template string, qe int, focus_x double, focus_y double, focus_z double, heading double, direction double"


def line(r, dx=0.0, dz=0.02, turn=0.0, n=81):
    return [(r, i, i * dx, 0.0, i * dz, i * turn) for i in range(n)]


def made(spark, tracks, routes, **settings):
    rows = [(*r, *[None] * (6 - len(r)), 0.0, 0.0) if len(r) < 8 else r for r in routes]
    return long_routes.plans(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(rows, ROUTE), ["r"], **settings)


@pytest.fixture(scope="module")
def six(spark):
    tracks = [*line(0), *line(1, 0.02, 0.0), *line(2, 0.0, 0.0, 1.0), *line(3), *line(4, 0.02, 0.0), *line(5)]
    routes = [(k, t, 40, *((0.0, 0.0, 3.0) if k == 4 else ())) for k, t in enumerate(long_routes.TEMPLATES)]
    planned = made(spark, tracks, routes).cache()
    frames = {}
    for f in long_routes.frames(planned, ["r"]).orderBy("r", "frame_index").collect():
        frames.setdefault(f.r, []).append(f)
    short = {}
    for r, i, x, y, z, yaw in tracks:
        short.setdefault(r, {})[i] = (x, y, z, yaw)
    return planned, {p.r: p for p in planned.collect()}, frames, short


def spot(f):
    return f.x, f.y, f.z, f.yaw


def test_every_template_keeps_its_prefix_and_comes_home(six):
    _, plans, frames, short = six
    assert sorted(plans) == list(range(6)) and all(p.reason is None for p in plans.values())
    for r, track in frames.items():
        assert [f.frame_index for f in track] == list(range(961))
        assert [spot(f) for f in track[:41]] == [short[r][i] for i in range(41)]
        assert spot(track[-1]) == short[r][0]


def test_visits_meet_after_an_excursion_and_five_seconds(six):
    planned, plans, frames, _ = six
    for r, p in plans.items():
        at = dict(zip(long_routes.EVENTS, p.frames, strict=True))
        for _, first, second in long_routes.PAIRS:
            assert at[second] - at[first] >= 80
            assert spot(frames[r][at[first]]) == pytest.approx(spot(frames[r][at[second]]), abs=1e-9)
    found = long_routes.excursions(long_routes.frames(planned, ["r"]), long_routes.events(planned, ["r"]), ["r"]).collect()
    assert len(found) == 18 and all(e.closed and e.excursion for e in found)


def test_a_straight_way_out_by_hand(six):
    # 0.02 a frame for 920 frames are 18.4; 0.8 lead home from the query view, 8.8 are left each way.
    _, plans, frames, _ = six
    assert plans[0].target == pytest.approx(18.4) and plans[0].amplitude == pytest.approx(8.8)
    assert plans[0].counts == [110, 110, 132, 88, 88, 132, 110, 150]
    assert frames[0][plans[0].frames[3]].z == pytest.approx(0.8 + 8.8)
    assert frames[1][plans[1].frames[0]].x == pytest.approx(0.8 + 2.2)


def test_lengths_are_what_the_speed_travels(six):
    _, plans, frames, _ = six
    for r in (0, 1, 3, 4, 5):
        points = frames[r][40:]
        length = sum(math.dist(spot(a)[:3], spot(b)[:3]) for a, b in zip(points[:-1], points[1:], strict=True))
        assert length == pytest.approx(18.4, rel=0.01), r


def test_yaw_swings_between_240_and_300_as_the_speed_allows(six):
    # 16 degrees a second for 57.5 s are 920: 260 up, 300 home, three swings of 120.
    _, plans, frames, _ = six
    yaws = [f.yaw for f in frames[2]]
    assert plans[2].counts == [64, 64, 64, 417, 80, 64, 64, 103]
    assert max(yaws) <= 300 + 1e-9 and yaws[plans[2].frames[3]] == pytest.approx(300)
    last = yaws[plans[2].frames[2] : plans[2].frames[3] + 1]
    assert sum(b < 241.5 and a > b and c >= b for a, b, c in zip(last[:-2], last[1:-1], last[2:], strict=True)) == 3


def test_an_orbit_keeps_its_radius_and_faces_its_focus(six):
    _, plans, frames, _ = six
    p, track = plans[4], frames[4]
    radius = math.hypot(0.8, 3.0)
    for f in track[40 : p.frames[6] + 1]:
        assert math.hypot(f.x, f.z - 3.0) == pytest.approx(radius, rel=1e-4)
    bearing = lambda f: math.degrees(math.atan2(0.0 - f.x, 3.0 - f.z)) - f.yaw
    assert {round((bearing(f) - bearing(track[40]) + 180) % 360 - 180, 1) for f in track[40 : p.frames[3]]} <= {0.0, -0.0}


def test_routes_that_cannot_be_made_say_why(spark):
    tracks = [*line(0), *line(1), *line(2)[:30], *line(4), *line(4)[:1], *line(5), *line(6, n=81)[1:], *line(7, 0.0, 0.0), *line(8)]
    tracks.append((9, 0, None, 0.0, 0.0, 0.0))
    routes = [(0, "spiral", 40), (1, "arc_return", 0), (2, "arc_return", 40), (3, "arc_return", 40), (4, "forward_backward", 40)]
    routes += [(5, "forward_backward", 40, None, None, None, 0.0, 45.0), (6, "forward_backward", 40), (7, "orbit_around_anchor", 40, 0.0, 0.0, 3.0), (8, "orbit_around_anchor", 40), (9, "forward_backward", 40), (10, None, None)]
    got = {p.r: (p.reason, p.frames is None) for p in made(spark, tracks, routes).collect()}
    assert got == {0: ("template", True), 1: ("qe", True), 2: ("qe", True), 3: ("track", True), 4: (None, False), 5: ("settings", True), 6: ("track", True), 7: ("focus", True), 8: ("focus", True), 9: ("track", True), 10: ("template", True)}


def test_no_routes_give_no_plans_and_no_frames(spark):
    planned = long_routes.plans(spark.createDataFrame([], TRACK), spark.createDataFrame([], ROUTE), ["r"])
    assert planned.count() == 0 and long_routes.frames(planned, ["r"]).count() == 0


def test_headings_turn_between_the_visits_only(spark):
    planned = made(spark, line(0), [(0, "forward_backward", 40, None, None, None, 12.0, 0.0)])
    p, track = planned.first(), long_routes.frames(planned, ["r"]).orderBy("frame_index").collect()
    assert [f.yaw for f in track[:41]] == [0.0] * 41 and track[-1].yaw == pytest.approx(0.0)
    assert {round(f.yaw, 9) for f in track[p.frames[0] : p.frames[6] + 1]} == {12.0}
