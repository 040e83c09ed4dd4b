"""Cases that earlier code failed on."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from meridia.functions.numeric import quantile
from meridia.llm import secret_scan
from meridia.operators import diagnostics, pairing, smoothing
from meridia.plans import catalogue


def test_smoothing_goes_on_after_a_degenerated_track(spark):
    still = np.eye(4)
    rows = [("still", i, still.ravel().tolist(), False) for i in range(9)]
    for i in range(9):
        c, s = math.cos(i * math.pi / 4), math.sin(i * math.pi / 4)
        spun = np.eye(4)
        spun[:2, :2] = [[c, -s], [s, c]]
        rows.append(("spun", i, spun.ravel().tolist(), False))
    df = spark.createDataFrame(rows, "k string, i int, pose array<double>, w boolean")
    got = smoothing.smooth_waypoints(df, ["k"], "i", "pose", "w", cutoff_hz=0.01).collect()
    assert len(got) == 18
    assert {(r.k, r.problem, r.pose is None) for r in got} == {("still", None, False), ("spun", "degenerated", True)}


def test_third_axis_is_voted_for(spark, tmp_path):
    items = [(1, 0.05, 0.08, 25.0), (2, 0.05, 0.0, 25.0), (3, 0.05, 0.04, 50.0)]
    spark.createDataFrame(items, "l_orderkey long, l_discount double, l_tax double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.pressed for r in catalogue.QUERIES["majority_vote_keys"](spark, str(tmp_path)).collect()}
    assert got == {1: "Q", 2: "E", 3: "W"}


def fused(low, high, d):
    return float(Fraction(low) * Fraction(1 - d) + Fraction(high * d)) if d else low


def test_quantile_of_neighbours_that_differ_in_the_last_bits(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        a = float(rng.uniform(1, 90))
        rows.append((k, [a, math.nextafter(a, 100.0) if k % 2 else a + float(rng.uniform(0, 50)), 200.0]))
    df = spark.createDataFrame(rows, "k int, a array<double>")
    for share in (0.125, 0.15, 0.375, 0.45, 0.5):
        got = {r.k: r.q for r in df.select("k", quantile(F.col("a"), share).alias("q")).collect()}
        assert all(got[k] == fused(a[math.floor(2 * share)], a[math.ceil(2 * share)], 2 * share - math.floor(2 * share)) for k, a in rows)
    assert spark.range(1).select(quantile(F.array().cast("array<double>"), 0.5).alias("q")).first().q is None


def test_shape_takes_the_quarter_as_its_sql_does(spark):
    # Of four steps the two least are alike but for their last bits, and the quarter lies between them.
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for k in range(500):
        a = float(rng.uniform(20, 80))
        track, at = [(k, 0, 0.0, 0.0, 0.0)], 0.0
        for i, n in enumerate((a, a, 3 * a, 4 * a)):
            at += n
            track.append((k, i + 1, at, float(track[-1][3] + 10 - 2 * i), 0.0))
        steps = [(math.sqrt((q[2] - p[2]) * (q[2] - p[2])), q[3] - p[3]) for p, q in zip(track, track[1:], strict=False)]
        sh = sorted(h for h, _ in steps)
        slopes = sorted(v / h for h, v in steps if h > fused(sh[0], sh[1], 0.75))
        place = (len(slopes) - 1) * 0.95
        expected[k] = fused(slopes[math.floor(place)], slopes[math.ceil(place)], place - math.floor(place))
        rows += track
    df = spark.createDataFrame(rows, "k int, i int, x double, y double, z double")
    got = {r.k: r.slope_p95 for r in diagnostics.trajectory_shape(df, ["k"], "i", "x", "y", "z").collect()}
    assert got == expected


def test_either_join_gives_each_pair_once(spark):
    left = spark.createDataFrame([(1, 5, 7), (1, 6, 7), (1, 5, 8), (2, None, 8), (None, 5, 7)], "l int, a int, b int")
    right = spark.createDataFrame([(10, 5, 7), (10, 6, 8), (11, 9, 8), (12, None, None)], "r int, a int, b int")
    got = sorted(tuple(r) for r in pairing.either_join(left, right, "l", "r", [("a", "a"), ("b", "b")]).collect())
    assert got == [(1, 10), (1, 11), (2, 10), (2, 11)]
    plan = pairing.either_join(left, right, "l", "r", [("a", "a"), ("b", "b")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l#" not in plan.split("Join")[0]


def test_identifiers_come_from_all_rows(spark):
    # The words of a few rows among many are found; copies of a text count once.
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10_000 == 77, F.concat(F.lit("needle_word is "), F.col("id"))).when(F.col("id") < 50, "copied_word").otherwise(F.lit("x")).alias("text"))
    words = secret_scan.identifiers(docs).split()
    assert b"needle_word" in words and b"copied_word" not in words
