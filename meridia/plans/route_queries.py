"""Queries of camera routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import long_routes, sequences, trajectories
from meridia.plans.fixtures import steady, table
from meridia.plans.registry import query


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, template, distance, far, side, turn): a route for every part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    names = F.array(*[F.lit(t) for t in ("forward_backward", "lateral_out_and_back", "yaw_return", "peek_occlude_retract", "unknown")])
    return table(spark, sf_dir, "part").select("p_partkey", F.get(names, (k % 5).cast("int")).alias("template"), (0.5 + size / 25).alias("distance"), (1.0 + size / 10).alias("far"), (size / 20 - 1).alias("side"), (20.0 + size).alias("turn"))


@query("route_poses")
def route_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """357 frames of every feasible route; the clock has no short SQL, the tests check limits, ends and revisits."""
    return trajectories.poses(routes(spark, sf_dir), ["p_partkey"]).drop("pose")


@query("route_checks", "SELECT p_partkey, '' AS problems FROM part WHERE p_partkey % 5 <> 4")
def route_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes(spark, sf_dir)
    out = trajectories.route_checks(trajectories.poses(r, ["p_partkey"]), trajectories.event_frames(r, ["p_partkey"]), ["p_partkey"])
    return out.select("p_partkey", F.array_join("problems", ",").alias("problems"))


@query("route_dynamics", "SELECT p_partkey, true AS within FROM part WHERE p_partkey % 5 <> 4")
def route_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sampled speed, acceleration and jerk of progress, side move and turn hold the limits, to what sampling adds."""
    axes = {"x": trajectories.MOVE_LIMITS, "z": trajectories.MOVE_LIMITS, "yaw": trajectories.TURN_LIMITS}
    d = sequences.axes_dynamics(trajectories.poses(routes(spark, sf_dir), ["p_partkey"]), ["p_partkey"], "frame_index", list(axes), 1 / trajectories.FPS)
    held = F.lit(True)
    for axis, limits in axes.items():
        for name, limit in zip(("speed", "acceleration", "jerk"), limits, strict=True):
            held = held & (F.col(f"{axis}_{name}") <= limit * 1.1)
    return d.select("p_partkey", held.alias("within"))


LONG = (*long_routes.TEMPLATES, "unknown")


def long_shorts(spark: SparkSession, sf_dir: str, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Short tracks of steady speed, one a row of the table, and the settings of their long routes."""
    k = F.col(key)
    rows = table(spark, sf_dir, name).select(key, F.get(F.array(*[F.lit(t) for t in LONG]), (k % 7).cast("int")).alias("template"), (40 + k % 37).cast("int").alias("qe"), ((1 + k % 50) / 400).alias("v"))
    orbit, turn, side = F.col("template") == "orbit_around_anchor", F.col("template") == "yaw_return", F.col("template").isin("lateral_out_and_back", "orbit_around_anchor")
    settings = rows.select(key, "template", "qe", *[F.when(orbit, v).alias(f"focus_{a}") for a, v in (("x", F.lit(0.0)), ("y", F.lit(0.0)), ("z", F.col("v") * F.col("qe")))])
    i = rows.withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.col("qe") + 20)))
    way = F.col("v") * F.col("frame_index")
    return i.select(key, "frame_index", F.when(side, way).otherwise(0.0).alias("x"), F.lit(0.0).alias("y"), F.when(side | turn, 0.0).otherwise(way).alias("z"), F.when(turn, way * 10).otherwise(0.0).alias("yaw")), settings


def _long_sql(name: str, key: str) -> str:
    """Plans in closed form, but for the peek's bisection; the least intervals are settled in three rounds."""
    listed = ", ".join(f"'{t}'" for t in LONG)
    rounds = "".join(
        f""", r{n} AS (SELECT k, leg, w, least, fixed OR w * (total - coalesce(sum(least) FILTER (WHERE fixed) OVER p, 0)) / nullif(sum(w) FILTER (WHERE NOT fixed) OVER p, 0) < least AS fixed, total
          FROM r{n - 1} WINDOW p AS (PARTITION BY k))"""
        for n in (1, 2, 3)
    )
    return f"""WITH RECURSIVE base AS (SELECT {key} AS k, [{listed}][1 + {key} % 7] AS template, 40 + {key} % 37 AS qe, (1 + {key} % 50) / CAST(400 AS DOUBLE) AS v FROM {name}),
    lens AS (SELECT *, v * qe AS way, v * (960 - qe) AS target, 800 * sin(pi() / 800) AS half, greatest(0.15 * v * qe, 0.001) AS aside, greatest(20 * v - v, 0.5 * v * qe, 0.001) AS beyond FROM base),
    ramp AS (SELECT i, pow(least(i * 0.00125 / 0.3, 1), 2) * (3 - 2 * least(i * 0.00125 / 0.3, 1)) AS y FROM range(401) t(i)),
    rise AS (SELECT b.i, b.y - a.y AS dy FROM ramp a JOIN ramp b ON b.i = a.i + 1),
    halving(k, n, low, high) AS (
      SELECT k, 0, CAST(0 AS DOUBLE), target FROM lens WHERE template = 'peek_occlude_retract'
      UNION ALL
      SELECT h.k, h.n + 1, CASE WHEN e.total < l.target THEN (h.low + h.high) / 2 ELSE h.low END, CASE WHEN e.total < l.target THEN h.high ELSE (h.low + h.high) / 2 END
      FROM halving h JOIN lens l ON l.k = h.k, LATERAL (SELECT (h.low + h.high) / 2 AS s, l.aside * greatest(1, (h.low + h.high) / 2 / l.beyond) AS lift) m,
        LATERAL (SELECT l.way + 2 * ((SELECT sum(sqrt(pow(m.s * 0.00125, 2) + pow(dy * m.lift, 2))) FROM rise) + 0.5 * m.s) + 2 * sqrt(pow(0.9 * l.way + m.s, 2) + pow(m.lift, 2)) AS total) e
      WHERE h.n < 60),
    sized AS (SELECT l.*, CASE template WHEN 'forward_backward' THEN (target - way) / 2 WHEN 'lateral_out_and_back' THEN (target - way) / 2
        WHEN 'arc_return' THEN (target - way) / (0.6 + 2 * 2.55 * half) WHEN 'peek_occlude_retract' THEN (h.low + h.high) / 2 ELSE 0 END AS a,
        sqrt(2) * way AS radius, 10 * way AS first, least(greatest((10 * target + 10 * way) / 2, 180), 300) AS peak
      FROM lens l LEFT JOIN halving h ON h.k = l.k AND h.n = 60),
    turned AS (SELECT *, CASE WHEN template = 'orbit_around_anchor' THEN 20 + 280 * floor(greatest(0, least((degrees(4800 * asin((target - way) / (9600 * radius))) - 20) / 280, 1 - pow(2, -24))) * 16777216) / 16777216 END AS span,
        greatest(floor(round((round(10 * target, 9) - (peak - first) - peak) / 120 + 0.5, 9)), 0) AS loops, aside * greatest(1, a / beyond) AS lift FROM sized),
    weighed AS (SELECT *, CASE template
        WHEN 'arc_return' THEN [0.3 * a, a * half, 0.85 * a * half, 0.7 * a * half, 0.7 * a * half, 0.85 * a * half, a * half, 0.3 * a + way]
        WHEN 'yaw_return' THEN [(peak - first) / 4, (peak - first) / 4, (peak - first) / 4, (peak - first) / 4 + 2 * loops * (peak - 240), (peak - first) / 4, (peak - first) / 4, (peak - first) / 4, (peak + 3 * first) / 4]
        WHEN 'orbit_around_anchor' THEN list_transform([0.25, 0.25, 0.3, 0.2, 0.2, 0.3, 0.25, 0.25], lambda d, i: 800 * radius * sin(radians(span) * d / 800) + CASE WHEN i = 8 THEN way ELSE 0 END)
        WHEN 'peek_occlude_retract' THEN list_transform(range(8), lambda i: CASE WHEN i IN (0, 7) THEN u0 WHEN i IN (1, 6) THEN u1 WHEN i IN (2, 5) THEN 0.5 * a ELSE sqrt(pow(0.9 * way + a, 2) + lift * lift) END + CASE WHEN i = 7 THEN way ELSE 0 END)
        WHEN 'unknown' THEN NULL
        ELSE [0.25 * a, 0.25 * a, 0.3 * a, 0.2 * a, 0.2 * a, 0.3 * a, 0.25 * a, 0.25 * a + way] END AS weights
      FROM turned t, LATERAL (SELECT sum(CASE WHEN i <= 200 THEN sqrt(pow(t.a * 0.00125, 2) + pow(dy * t.lift, 2)) END) AS u0, sum(CASE WHEN i > 200 THEN sqrt(pow(t.a * 0.00125, 2) + pow(dy * t.lift, 2)) END) AS u1 FROM rise) u),
    r0 AS (SELECT k, g.leg, weights[g.leg] AS w, CASE WHEN g.leg IN (4, 5) THEN 80 ELSE 1 END AS least, false AS fixed, CAST(960 - qe AS DOUBLE) AS total FROM weighed, range(1, 9) g(leg) WHERE weights IS NOT NULL){rounds},
    shares AS (SELECT k, leg, CASE WHEN fixed THEN least ELSE w * (total - coalesce(sum(least) FILTER (WHERE fixed) OVER p, 0)) / sum(w) FILTER (WHERE NOT fixed) OVER p END AS s, total FROM r3 WINDOW p AS (PARTITION BY k)),
    dealt AS (SELECT k, leg, floor(round(s, 9)) + CASE WHEN row_number() OVER (PARTITION BY k ORDER BY round(s - floor(round(s, 9)), 9) DESC, leg) <= total - sum(floor(round(s, 9))) OVER (PARTITION BY k) THEN 1 ELSE 0 END AS n FROM shares),
    placed AS (SELECT k, leg, CAST(sum(n) OVER (PARTITION BY k ORDER BY leg) AS INT) AS upto FROM dealt),
    told AS (SELECT k, list(upto ORDER BY leg) AS upto FROM placed GROUP BY k)"""


@query("long_route_plans", _long_sql("part", "p_partkey") + """
  SELECT w.k AS p_partkey, w.template, CASE WHEN t.k IS NULL THEN 'template' END AS reason, CASE WHEN t.k IS NOT NULL THEN round(a + 1e-9, 6) END AS amplitude,
         CASE WHEN t.k IS NOT NULL THEN round(span + 1e-6, 3) END AS span, array_to_string(list_transform(t.upto, lambda f: qe + f), ',') AS frames
  FROM weighed w LEFT JOIN told t ON t.k = w.k""")
def long_route_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the long route of every part goes, and the frames of its events after the query view."""
    plans = long_routes.plans(*long_shorts(spark, sf_dir, "part", "p_partkey"), ["p_partkey"])
    return plans.select("p_partkey", "template", "reason", steady("amplitude", 6).alias("amplitude"), steady("span", 3).alias("span"), F.array_join("frames", ",").alias("frames"))


@query("long_route_visits", _long_sql("supplier", "s_suppkey") + """
  SELECT w.k AS s_suppkey, pair, true AS closed, true AS excursion, CASE WHEN w.template IN ('forward_backward', 'lateral_out_and_back') THEN round(a * (1 - share) + 1e-9, 6) END AS reach
  FROM weighed w JOIN told t ON t.k = w.k, (VALUES ('C', 0.25), ('A', 0.5), ('B', 0.8)) p(pair, share)""")
def long_route_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of visits in the 961 frames of every supplier's long route, and how far a straight one goes in between."""
    tracks, settings = long_shorts(spark, sf_dir, "supplier", "s_suppkey")
    plans = long_routes.plans(tracks, settings, ["s_suppkey"])
    found = long_routes.excursions(long_routes.frames(plans, ["s_suppkey"]), long_routes.events(plans, ["s_suppkey"]), ["s_suppkey"])
    straight = F.col("template").isin("forward_backward", "lateral_out_and_back")
    return found.join(settings.select("s_suppkey", "template"), "s_suppkey").select("s_suppkey", "pair", "closed", "excursion", F.when(straight, steady("moved", 6)).alias("reach"))
