"""Queries of control, consistency by baseline, the requested horizon, smoothing and lenses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions import vectors
from meridia.operators import control, smoothing, timed
from meridia.plans import rules
from meridia.plans.fixtures import FRAMES, MEASUREMENT, frames, measurement, steady, table
from meridia.plans.registry import query

c = F.col

_TRACK = MEASUREMENT + """, track AS (
  SELECT model, row_number() OVER (PARTITION BY model ORDER BY t, event_id) - 1 AS i, value AS x, event_id % 50 / CAST(10 AS DOUBLE) AS y, value + event_id % 7 / CAST(8 AS DOUBLE) AS rx, event_id % 50 / CAST(10 AS DOUBLE) - event_id % 3 AS ry,
         CAST(event_id * 37 % 180 AS DOUBLE) AS err, 2.0::DOUBLE + model % 3 AS scale, event_id FROM measurement),
held AS (SELECT * EXCLUDE (event_id), CASE WHEN model % 4 = 3 THEN 100000 ELSE (SELECT count(*) FROM measurement m WHERE m.model = t.model) END AS frames FROM track t WHERE i % 5 <> 1 OR model % 2 = 0)"""


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("model")
    m = measurement(spark, sf_dir).withColumns({"i": F.row_number().over(w.orderBy("t", "event_id")).cast("long") - 1, "frames": F.when(c("model") % 4 == 3, F.lit(100000)).otherwise(F.count("*").over(w))})
    y = c("event_id") % 50 / 10.0
    rows = m.select("model", "i", c("value").alias("x"), y.alias("y"), (c("value") + c("event_id") % 7 / 8.0).alias("rx"), (y - c("event_id") % 3).alias("ry"), (c("event_id") * 37 % 180).cast("double").alias("err"), (2.0 + c("model") % 3).alias("scale"), "frames")
    return rows.where("i % 5 <> 1 OR model % 2 = 0")


_OK = "CASE WHEN status = 'ok' THEN round({0} + 1e-9, 6) END AS {0}"


@query(
    "control_summary",
    f"""WITH {_TRACK}, s AS (SELECT *, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) AS apart, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS done, sqrt(pow(rx - lag(rx) OVER w, 2) + pow(ry - lag(ry) OVER w, 2)) AS path FROM held WINDOW w AS (PARTITION BY model ORDER BY i)),
    g AS (SELECT model, count(*) FILTER (WHERE i % 4 = 0) AS "primary", avg(apart / scale) FILTER (WHERE i % 4 = 0) AS translation_mean, avg(err) FILTER (WHERE i % 4 = 0) AS rotation_mean, sqrt(avg(apart / scale * apart / scale) FILTER (WHERE i % 4 = 0)) AS translation_rmse,
      quantile_cont(err, 0.95) FILTER (WHERE i % 4 = 0) AS rotation_p95, sqrt(avg(apart * apart)) AS ate, max(scale) AS scale, sum(done) / greatest(sum(path), 1e-6) AS path_ratio, count(*) / CAST(max(frames) AS DOUBLE) AS usable_ratio,
      CASE WHEN count(*) FILTER (WHERE i % 4 = 0 AND i < frames) < ceil(max(frames) / 4) THEN 'missing_samples' WHEN count(*) FILTER (WHERE i % 4 = 0) < 2 THEN 'too_few' ELSE 'ok' END AS status FROM s GROUP BY model)
    SELECT model, status, "primary", {", ".join(_OK.format(n) for n in ("translation_mean", "rotation_mean", "translation_rmse", "rotation_p95"))}, round(ate + 1e-9, 6) AS ate, round(ate / scale + 1e-9, 6) AS ate_normalized, round(path_ratio + 1e-9, 6) AS path_ratio, round(usable_ratio + 1e-9, 6) AS usable_ratio FROM g""",
)
def control_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some models lack primary samples, others are shorter than asked for."""
    out = control.control_summary(_track(spark, sf_dir), ["model"], "i", ["x", "y"], ["rx", "ry"], "err", "scale", "frames", 4)
    return out.withColumns({n: steady(n, 6) for n, kind in out.dtypes if kind == "double"})


@query(
    "node_coverage",
    f"WITH {_TRACK} SELECT e.model, count(*) AS events, count(h.i) AS covered, round(count(h.i) / CAST(count(*) AS DOUBLE) + 1e-9, 6) AS coverage FROM track e LEFT JOIN held h ON h.model = e.model AND h.i = e.event_id % 400 GROUP BY e.model",
)
def node_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = measurement(spark, sf_dir).select("model", (c("event_id") % 400).alias("i"))
    return control.node_coverage(events, _track(spark, sf_dir), ["model"], "i").withColumn("coverage", steady("coverage", 6))


_FIELD = "avg({0}) FILTER (WHERE n > 0)", "quantile_cont({0}, 0.5) FILTER (WHERE n > 0)", "quantile_cont({0}, 0.95) FILTER (WHERE n > 0)"


@query(
    "depth_consistency",
    f"""WITH p AS (SELECT l_suppkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'short' ELSE 'medium' END AS baseline, CASE WHEN l_returnflag = 'R' OR l_suppkey % 9 = 0 THEN 0 ELSE l_partkey % 40 END AS n, l_returnflag <> 'R' AS there, l_discount AS e, l_tax AS g FROM lineitem),
    r AS (SELECT k, baseline, count(*) FILTER (WHERE NOT there) AS lost, count(*) FILTER (WHERE n = 0) AS bare FROM p GROUP BY ALL)
    SELECT k, baseline, CASE WHEN count(*) FILTER (WHERE n > 0) > 0 THEN 'ok' ELSE 'not_covered' END AS status, count(*) AS scheduled, count(*) FILTER (WHERE there) AS available, count(*) FILTER (WHERE n > 0) AS usable, CAST(sum(n) AS BIGINT) AS points,
      {", ".join(f"round({q.format(f)} + 1e-9, 6) AS {f}_{s}" for f in ("e", "g") for q, s in zip(_FIELD, ("mean", "median", "p95"), strict=True))},
      any_value(concat_ws(',', CASE WHEN lost > 0 THEN 'missing_depth=' || lost END, CASE WHEN bare > 0 THEN 'no_points=' || bare END)) AS reasons FROM p JOIN r USING (k, baseline) GROUP BY k, baseline""",
)
def depth_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = c("l_returnflag") != "R"
    n = F.when(~there | (c("l_suppkey") % 9 == 0), F.lit(0)).otherwise(c("l_partkey") % 40)
    rows = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("k"), F.when(c("l_linenumber") % 2 == 0, "short").otherwise("medium").alias("baseline"), n.alias("n"), there.alias("there"), c("l_discount").alias("e"), c("l_tax").alias("g"))
    rows = rows.withColumn("why", F.array_compact(F.array(F.when(~c("there"), "missing_depth"), F.when(c("n") == 0, "no_points"))))
    out = control.consistency_by_baseline(rows, ["k"], "baseline", "n", "there", "why", ["e", "g"])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("failure_reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("reasons", shown).drop("failure_reasons").withColumns({m: steady(m, 6) for m, kind in out.dtypes if kind == "double"})


_METRICS = ("click", "view", "purchase")


@query(
    "horizon_record",
    f"""WITH {MEASUREMENT}, filled AS (SELECT case_id, metric, count(DISTINCT least(11, CAST(floor(t / 5) AS INT))) AS n FROM measurement WHERE t <= 60 + 1e-8 GROUP BY ALL),
    curve AS (SELECT case_id, metric, CASE WHEN case_id % 13 = 0 AND metric = 'view' THEN 'evaluator_failed' WHEN n = 12 THEN 'ok' ELSE 'not_covered' END AS status FROM filled),
    times AS (SELECT case_id, list(DISTINCT CAST(floor(t * 16) AS BIGINT) ORDER BY CAST(floor(t * 16) AS BIGINT)) AS f FROM measurement GROUP BY case_id),
    s AS (SELECT case_id, coalesce((SELECT status FROM curve v WHERE v.case_id = t.case_id AND metric = 'click'), 'not_available') AS a, coalesce((SELECT status FROM curve v WHERE v.case_id = t.case_id AND metric = 'view'), 'not_available') AS b,
      coalesce((SELECT status FROM curve v WHERE v.case_id = t.case_id AND metric = 'purchase'), 'not_available') AS c, f, len(f) AS n FROM times t)
    SELECT case_id, CASE WHEN n < 2 THEN 'invalid_input' {" ".join(f"WHEN '{x}' IN (a, b, c) THEN '{x}'" for x in rules.INCOMPLETE)} WHEN a = 'ok' AND b = 'ok' AND c = 'ok' THEN 'ok' ELSE 'not_covered' END AS status,
      CASE WHEN n >= 2 THEN (f[n] - f[1]) / CAST(16 AS DOUBLE) END AS duration, CASE WHEN n >= 2 THEN concat_ws(',', a, b, c) END AS statuses, CASE WHEN n >= 2 THEN (f[1 + n // 2] - f[1]) / CAST(16 AS DOUBLE) END AS "interval" FROM s""",
)
def horizon_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' requested times, their metrics' coverage of twelve windows, and one revisit half-way."""
    m = measurement(spark, sf_dir)
    seen = m.where("t <= 60 + 1e-8").groupBy("case_id", "metric").agg(F.count_distinct(F.least(F.lit(11), F.floor(c("t") / 5).cast("int"))).alias("n"))
    status = F.when((c("case_id") % 13 == 0) & (c("metric") == "view"), "evaluator_failed").when(c("n") == 12, "ok").otherwise("not_covered")
    stamps = m.groupBy("case_id").agg(F.sort_array(F.collect_set(F.floor(c("t") * 16))).alias("f"))
    times = F.transform("f", lambda x: (x - F.get("f", F.lit(0))) / 16.0)
    events = F.create_map(F.lit("q0"), F.lit(0).cast("long"), F.lit("w2"), F.floor(F.size("f") / 2))
    pairs = F.create_map(F.lit("C"), F.struct(F.lit("q0").alias("first"), F.lit("w2").alias("revisit")))
    cases = stamps.select("case_id", times.alias("timestamps"), F.lit(16.0).alias("fps"), events.alias("events"), pairs.alias("pairs"))
    out = control.horizon_record(cases, seen.select("case_id", "metric", status.alias("status")), ["case_id"], rules.INCOMPLETE, _METRICS)
    shown = F.array_join(F.array(*[F.element_at("statuses", F.lit(x)) for x in _METRICS]), ",")
    return out.select("case_id", "status", "duration", shown.alias("statuses"), c("schedule")["C"]["interval"].alias("interval"))


@query("smooth_waypoints")
def smooth_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track smoothed between each 12th frame; the linear equations have no SQL, the tests solve them densely."""
    f = frames(spark, sf_dir)
    a = F.radians("yaw")
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(F.cos(a), zero, F.sin(a), c("x"), zero, one, zero, c("y"), -F.sin(a), zero, F.cos(a), c("z"), zero, zero, zero, one)
    rows = f.select("case_id", "frame_index", pose.alias("pose"), (c("frame_index") % 12 == 0).alias("waypoint"))
    return smoothing.smooth_waypoints(rows, ["case_id"], "frame_index", "pose", "waypoint", cutoff_hz=1.0)


_LENS = (-0.08, 0.012, 0.003, -0.002)
_K = tuple(f"CAST({v} AS DOUBLE)" for v in _LENS)


@query(
    "lens_distortion",
    f"""WITH {FRAMES}, p AS (SELECT case_id, frame_index, ((x * 7) % 16 - 8) / 10 AS x, (frame_index % 12 - 6) / CAST(10 AS DOUBLE) AS y FROM frames), q AS (SELECT *, x * x + y * y AS r FROM p)
    SELECT case_id, frame_index, round(x * (1 + {_K[0]} * r + {_K[1]} * r * r) + 2 * {_K[2]} * x * y + {_K[3]} * (r + 2 * x * x) + 1e-9, 6) AS u, round(y * (1 + {_K[0]} * r + {_K[1]} * r * r) + {_K[2]} * (r + 2 * y * y) + 2 * {_K[3]} * x * y + 1e-9, 6) AS v,
      round(x + 1e-9, 6) AS x, round(y + 1e-9, 6) AS y FROM q""",
)
def lens_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through a lens and back: the inverse must give what went in."""
    k = [F.lit(v) for v in _LENS]
    p = frames(spark, sf_dir).select("case_id", "frame_index", (((c("x") * 7) % 16 - 8) / 10).alias("x"), ((c("frame_index") % 12 - 6) / 10.0).alias("y"))
    seen = p.select("case_id", "frame_index", vectors.distort(c("x"), c("y"), *k).alias("d"))
    back = seen.select("*", vectors.undistort(c("d.x"), c("d.y"), *k).alias("b"))
    return back.select("case_id", "frame_index", *[steady(v, 6).alias(n) for n, v in (("u", "d.x"), ("v", "d.y"), ("x", "b.x"), ("y", "b.y"))])


def timed_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, i, x, y, z, yaw, pitch, seconds): the lines of ten parts in a row as one track of moves."""
    w = Window.partitionBy("k")
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.floor(c("l_partkey") / 10))
    i = F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) - 1
    turn = (c("l_orderkey") % 21 - 10) / 8
    return rows.select("k", i.alias("i"), (c("l_discount") * 100 - 5).alias("x"), (c("l_tax") * 100 - 4).alias("y"), (c("l_quantity") - 20).alias("z"), turn.alias("yaw"), ((c("l_linenumber") - 3) / 4).alias("pitch"), F.lit(20.0).alias("seconds"))


@query("timed_actions")
def timed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held keys of every track; the debts carry from window to window and have no short SQL, the tests compare with a loop."""
    windows = timed.action_windows(timed_moves(spark, sf_dir), ["k"], "i", ("x", "y", "z"), "yaw", "pitch", "seconds", (20.0, 15.0))
    return timed.timed_actions(windows, ["k"])
