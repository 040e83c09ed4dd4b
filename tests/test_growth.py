"""Cases of queries that grew faster than their tables, or did the same work many times."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import text, vectors
from meridia.llm import secret_scan
from meridia.operators import long_routes, reviews
from meridia.plans import catalogue

TRACK = "r long, frame_index int, x double, y double, z double, yaw double"
ROUTE = "r long, template string, qe int, focus_x double, focus_y double, focus_z double"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def stretched(spark):
    """A route of each template, arcs stretched to 0.6."""
    side = ("lateral_out_and_back", "orbit_around_anchor")
    tracks = [(k, i, i * 0.02 * (t in side), 0.0, i * 0.02 * (t not in side and t != "yaw_return"), i * 1.0 * (t == "yaw_return")) for k, t in enumerate(long_routes.TEMPLATES) for i in range(81)]
    routes = [(k, t, 40, 0.0, 0.0, 3.0) for k, t in enumerate(long_routes.TEMPLATES)]
    return long_routes.plans(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(routes, ROUTE), ["r"], width=0.6)


def test_plans_read_without_legs_do_not_make_them(stretched):
    assert " AS legs#" in optimized(stretched.select("r", "legs"))
    assert " AS legs#" not in optimized(stretched.select("r", "reason", "amplitude", "span", "frames"))


def test_intervals_are_dealt_by_the_ways_of_the_legs(stretched):
    least = long_routes.LEAST
    for p in stretched.collect():
        size = (lambda a, b: abs(a.yaw - b.yaw)) if p.template == "yaw_return" else (lambda a, b: math.dist(a[:3], b[:3]))
        ways = [sum(size(a, b) for a, b in zip(leg[:-1], leg[1:], strict=True)) for leg in p.legs]
        free = [k for k in range(8) if p.counts[k] > least[k] + 1]
        rate = sum(p.counts[k] for k in free) / sum(ways[k] for k in free)
        assert sum(p.counts) == 920 and all(abs(p.counts[k] - rate * ways[k]) < 1.5 for k in free), p.template


def test_frames_lie_evenly_by_way_and_are_not_sorted_with_their_pieces(stretched):
    track = long_routes.frames(stretched, ["r"])
    assert "Window" not in optimized(track)
    found = {(f.r, f.frame_index): f for f in track.collect()}
    for p in stretched.collect():
        for leg, n, begin in zip(p.legs, p.counts, [p.qe, *p.frames], strict=False):
            of = (lambda a, b: abs(a.yaw - b.yaw)) if p.template == "yaw_return" else (lambda a, b: math.dist(a[:3], b[:3]))
            upto = [0.0]
            for a, b in zip(leg[:-1], leg[1:], strict=True):
                upto.append(upto[-1] + of(a, b))
            for i in range(n):
                k = max(j for j in range(len(leg) - 1) if upto[j] <= i * upto[-1] / n + 1e-12)
                s = (i * upto[-1] / n - upto[k]) / (upto[k + 1] - upto[k])
                f = found[p.r, begin + i]
                assert (f.x, f.y, f.z, f.yaw) == pytest.approx(tuple(u + s * (v - u) for u, v in zip(leg[k], leg[k + 1], strict=True)), abs=1e-7)
    assert len(found) == 6 * 961


def test_excursions_repeat_no_frame_for_its_pairs(spark):
    rows = [(1, i, float(min(i, 10 - i)), 0.0, 0.0, 0.0) for i in range(11)] + [(2, i, 0.0, 0.0, 0.0, 0.0) for i in range(11)]
    named = spark.createDataFrame([(k, e, i) for k in (1, 2) for e, i in (("a", 1), ("b", 9), ("c", 8), ("d", 3))], "r long, event string, frame_index int")
    out = long_routes.excursions(spark.createDataFrame(rows, TRACK), named, ["r"], (("P", "a", "b"), ("Q", "c", "d"), ("R", "d", "c")))
    assert optimized(out).count("Generate") == 1  # of sums, not of frames
    got = {(e.r, e.pair): (e.closed, e.moved, e.excursion) for e in out.collect()}
    assert got == {(1, "P"): (True, 4.0, True), (1, "R"): (False, 2.0, True), (2, "P"): (True, 0.0, False), (2, "R"): (True, 0.0, False)}


def test_lenses_are_undone_in_batches_and_not_in_a_fold_a_row(spark):
    k = (-0.08, 0.012, 0.003, -0.002)
    rows = spark.range(2000).select(*[((F.col("id") * n % 21 - 10) / 12).alias(c) for n, c in ((1, "x"), (7, "y"))])
    seen = rows.select("x", "y", vectors.distort(F.col("x"), F.col("y"), *map(F.lit, k)).alias("d"))
    back = seen.select("x", "y", vectors.undistort(F.col("d.x"), F.col("d.y"), *map(F.lit, k)).alias("b"))
    assert "ArrowEvalPython" in optimized(back) and "aggregate(" not in optimized(back)
    assert all(abs(r.x - r.b.x) < 1e-9 and abs(r.y - r.b.y) < 1e-9 for r in back.collect())
    none = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, 1.0D AS y").select(vectors.undistort(F.col("x"), F.col("y"), *map(F.lit, k)).alias("b")).first().b
    assert none.x is None and none.y is None


def test_answers_are_dealt_to_all_tasks(spark):
    one = spark.createDataFrame([(i, "{}") for i in range(64)], "k int, answer string").coalesce(1)
    out = reviews.parsed(one, "answer", ["k"], "v")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_prompt_is_squeezed_once(spark):
    plan = optimized(spark.createDataFrame([(" Red  Door ",)], "s string").select(text.prompt(F.col("s")).alias("p")))
    assert plan.count("regexp_replace(") == 1 and plan.count("regexp_extract_all(") == 1


def test_traces_are_searched_once(spark, sf_dir):
    plan = optimized(catalogue.QUERIES["trace_reuse"](spark, sf_dir))
    assert "Join" not in plan


def test_identifiers_travel_as_one_text(spark):
    rows = [(i, f"alpha_beta gamma {'x' * i} alpha_beta {w}") for i, w in enumerate(("delta", "delta", "delta", "once", ""))]
    found = secret_scan.identifiers(spark.createDataFrame([*rows, (9, rows[3][1]), (10, None), (11, ""), (12, "1 2")], "doc_id long, text string")).split()
    assert found[:3] == [b"delta", b"gamma", b"alpha_beta"]
