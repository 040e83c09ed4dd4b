"""Queries of ordered series, poses and stateful plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import vectors
from meridia.operators import sequences
from meridia.operators.matching import lag_join
from meridia.plans.fixtures import FRAMES, MEASUREMENT, frames, measurement, table
from meridia.plans.registry import query


@query(
    "path_length",
    f"""WITH {FRAMES}, s AS (SELECT case_id, frame_index, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step FROM frames WINDOW w AS (PARTITION BY case_id ORDER BY frame_index))
    SELECT case_id, frame_index, round(step, 6) AS step, round(sum(step) OVER (PARTITION BY case_id ORDER BY frame_index), 5) AS travelled FROM s""",
)
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.path_length(frames(spark, sf_dir), ["case_id"], "frame_index", ["x", "y", "z"])
    return out.select("case_id", "frame_index", F.round("step", 6).alias("step"), F.round("travelled", 5).alias("travelled"))


@query(
    "dynamics_limits",
    f"""WITH {FRAMES}, d AS (SELECT case_id, (x - lag(x) OVER w) / 0.0625::DOUBLE AS v, (x - 2 * lag(x) OVER w + lag(x, 2) OVER w) / 0.00390625::DOUBLE AS a, (x - 3 * lag(x) OVER w + 3 * lag(x, 2) OVER w - lag(x, 3) OVER w) / 0.000244140625::DOUBLE AS j FROM frames WINDOW w AS (PARTITION BY case_id ORDER BY frame_index))
    SELECT case_id, round(max(abs(v)), 4) AS speed, round(max(abs(a)), 3) AS acceleration, round(max(abs(j)), 2) AS jerk FROM d GROUP BY case_id""",
)
def dynamics_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.dynamics(frames(spark, sf_dir), ["case_id"], "frame_index", "x", 0.0625)
    return out.select("case_id", F.round("speed", 4).alias("speed"), F.round("acceleration", 3).alias("acceleration"), F.round("jerk", 2).alias("jerk"))


_RUNS = MEASUREMENT + """, o AS (SELECT case_id, t, event_id, metric, CASE WHEN metric = lag(metric) OVER w THEN 0 ELSE 1 END AS fresh FROM measurement WINDOW w AS (PARTITION BY case_id ORDER BY event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY event_id) AS run FROM o)"""


@query("run_length_groups", f'WITH {_RUNS} SELECT case_id, CAST(run AS BIGINT) AS run, any_value(metric) AS metric, min(event_id) AS "first", max(event_id) AS "last", count(*) AS length FROM r GROUP BY case_id, run')
def run_length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(measurement(spark, sf_dir), ["case_id"], ["event_id"], "metric")


def labelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(measurement(spark, sf_dir), ["case_id"], ["event_id"], "metric").withColumnRenamed("metric", "label")


@query("merge_short_runs")
def merge_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events merged up to three; no SQL, the tests compare with a loop."""
    return sequences.merge_short_runs(labelled_runs(spark, sf_dir), "case_id", 3)


@query(
    "majority_vote_keys",
    """WITH m AS (SELECT l_orderkey, round(l_discount * 100) - 5 AS x, round(l_tax * 100) - 4 AS y, l_quantity - 25 AS z FROM lineitem), u AS (SELECT *, greatest(sqrt(x * x + y * y + z * z), 1e-12) AS n FROM m),
    v AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE z / n > 0.5) - count(*) FILTER (WHERE z / n < -0.5) AS wz, count(*) FILTER (WHERE x / n > 0.5) - count(*) FILTER (WHERE x / n < -0.5) AS wx,
      count(*) FILTER (WHERE y / n > 0.5) - count(*) FILTER (WHERE y / n < -0.5) AS wy FROM u GROUP BY l_orderkey)
    SELECT l_orderkey, concat(CASE WHEN wz > n / 2 THEN 'W' WHEN wz < -n / 2 THEN 'S' ELSE '' END, CASE WHEN wx > n / 2 THEN 'D' WHEN wx < -n / 2 THEN 'A' ELSE '' END, CASE WHEN wy > n / 2 THEN 'Q' WHEN wy < -n / 2 THEN 'E' ELSE '' END) AS pressed FROM v""",
)
def majority_vote_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    moves = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.round(c("l_discount") * 100) - 5).alias("x"), (F.round(c("l_tax") * 100) - 4).alias("y"), (c("l_quantity") - 25).alias("z"))
    out = sequences.vote_keys(moves, ["l_orderkey"], {"z": ("W", "S"), "x": ("D", "A"), "y": ("Q", "E")}, ("x", "y", "z"))
    return out.select("l_orderkey", F.array_join("pressed", "").alias("pressed"))


@query("block_actions")
def block_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole steps a block of 16 frames that follow x; the carry has no SQL, the tests compare with a loop."""
    return sequences.block_actions(frames(spark, sf_dir), "case_id", "frame_index", "x", 25.0, 16)


@query(
    "positive_scale_fit",
    f"WITH {FRAMES} SELECT case_id, round(CASE WHEN sum(x * x + y * y) > 1e-12 THEN greatest(0, sum(x * z + y * x) / sum(x * x + y * y)) ELSE 1 END, 6) AS scale FROM frames GROUP BY case_id",
)
def positive_scale_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.positive_scale(frames(spark, sf_dir), ["case_id"], ["x", "y"], ["z", "x"])
    return out.select("case_id", F.round("scale", 6).alias("scale"))


@query("similarity_alignment")
def similarity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each track onto itself, turned, scaled and moved; singular values have no SQL."""
    f = frames(spark, sf_dir).select("case_id", "x", "y", "z", (2 * F.col("z") + 1).alias("tx"), (2 * F.col("y") - 3).alias("ty"), (-2 * F.col("x")).alias("tz"))
    return sequences.align(f, ["case_id"], ["x", "y", "z"], ["tx", "ty", "tz"])


_POSES = FRAMES + """, p AS (SELECT a.case_id, a.frame_index, a.x AS ax, a.y AS ay, a.z AS az, radians(a.yaw) AS ra, b.x AS bx, b.y AS by_, b.z AS bz, radians(b.yaw) AS rb FROM frames a JOIN frames b ON b.case_id = a.case_id AND b.frame_index = a.frame_index + 16)"""


@query(
    "relative_pose",
    f"""WITH {_POSES} SELECT case_id, frame_index, round(cos(ra) * (bx - ax) - sin(ra) * (bz - az), 5) + 0.0 AS right_, round(by_ - ay, 5) + 0.0 AS down, round(sin(ra) * (bx - ax) + cos(ra) * (bz - az), 5) + 0.0 AS forward,
      round(degrees(acos(greatest(-1, least(1, cos(rb - ra))))), 4) AS rotation, round(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2), 5) AS distance FROM p""",
)
def relative_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lag_join(frames(spark, sf_dir), ["case_id"], "frame_index", 16, ["x", "y", "z", "yaw"])
    pose = lambda end: vectors.yaw_pose(*[F.col(c + end) for c in ("yaw", "x", "y", "z")])
    m = F.col("m")
    out = pairs.select("case_id", "frame_index", vectors.relative(pose(""), pose("_next")).alias("m"))
    at = lambda i, name: (F.round(m[i], 5) + 0.0).alias(name)
    return out.select("case_id", "frame_index", at(3, "right_"), at(7, "down"), at(11, "forward"), F.round(vectors.rotation_degrees(m), 4).alias("rotation"), F.round(vectors.translation_norm(m), 5).alias("distance"))


@query("rigid_pose_checks", f"WITH {FRAMES} SELECT case_id, frame_index, CASE WHEN frame_index % 5 = 0 THEN 'orthonormal' ELSE '' END AS problems FROM frames")
def rigid_pose_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = vectors.yaw_pose(*[F.col(c) for c in ("yaw", "x", "y", "z")])
    bent = F.when(F.col("frame_index") % 5 == 0, F.transform(pose, lambda x, i: F.when(i == 5, 1.01).otherwise(x))).otherwise(pose)
    return frames(spark, sf_dir).select("case_id", "frame_index", bent.alias("m")).select("case_id", "frame_index", F.array_join(vectors.rigid_problems(F.col("m")), ",").alias("problems"))


@query(
    "reprojection",
    f"WITH {FRAMES} SELECT case_id, frame_index, round((x / (z + 1)) * 500 + 320, 5) AS u, round((y / (z + 1)) * 500 + 240, 5) AS v, round(((x / (z + 1)) * 500 + 320 + 0.5 - 320) / 500 * (z + 1), 5) AS back FROM frames",
)
def reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx, cx, cy = F.lit(500.0), F.lit(320.0), F.lit(240.0)
    depth = F.col("z") + 1
    pixels = frames(spark, sf_dir).select("case_id", "frame_index", depth.alias("depth"), vectors.project(F.col("x"), F.col("y"), depth, fx, fx, cx, cy).alias("p"))
    back = vectors.backproject(F.col("p.u"), F.col("p.v"), F.col("depth"), fx, fx, cx, cy, centre=0.5)
    return pixels.select("case_id", "frame_index", F.round("p.u", 5).alias("u"), F.round("p.v", 5).alias("v"), F.round(back["x"], 5).alias("back"))


@query(
    "yaw_unwrapped",
    f"""WITH {FRAMES}, s AS (SELECT case_id, frame_index, yaw, -round_even(coalesce(yaw - lag(yaw) OVER w, 0) / 360, 0) AS turns FROM frames WINDOW w AS (PARTITION BY case_id ORDER BY frame_index))
    SELECT case_id, frame_index, yaw + 360 * sum(turns) OVER (PARTITION BY case_id ORDER BY frame_index) AS unwrapped FROM s""",
)
def yaw_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.unwrapped(frames(spark, sf_dir), ["case_id"], "frame_index", "yaw").select("case_id", "frame_index", "unwrapped")
