"""Parametric camera routes as table expressions.

A route has seven events: the start, a way point, the query view, a first visit, the turn,
a revisit bound to the first visit, and the return to the start. Each template gives the
events' progress along the way from start to query view, their lateral offset and yaw;
the 356 intervals of a clip are dealt out by what speed, acceleration and jerk limits
ask of each segment, and every segment runs on a quintic clock, at rest at its events.
Headings are interpolated as yaw angles; full rotation splines are not built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.tables import settled
from meridia.functions.vectors import smoothstep, yaw_pose

# Event names in order, intervals of a short clip, frames a second.
EVENTS = ("q0", "w1", "qe", "qc_first", "w2", "qc_revisit", "q0_return")
INTERVALS, FPS = 356, 16
# Largest speed, acceleration and jerk of a quintic step of length 1 in time 1.
QUINTIC = (1.875, 10 / 3**0.5, 60.0)
#: Limits of translation (units a second ..) and of rotation (degrees a second ..).
MOVE_LIMITS, TURN_LIMITS = (2.0, 4.0, 16.0), (90.0, 240.0, 960.0)


def _events(template: Column, d: Column, far: Column, side: Column, turn: Column) -> Column:
    """Array of (progress, lateral, yaw) of the seven events; null for an unknown template."""
    zero = F.lit(0.0)
    visit = d + 0.55 * (far - d)
    at = lambda p, s, y: F.struct(p.cast("double").alias("progress"), s.cast("double").alias("lateral"), y.cast("double").alias("yaw"))
    forward = F.array(at(zero, zero, zero), at(0.5 * d, zero, zero), at(d, zero, zero), at(visit, zero, zero), at(far, zero, zero), at(visit, zero, zero), at(zero, zero, zero))
    lateral = F.array(at(zero, zero, zero), at(0.5 * d, zero, zero), at(d, zero, zero), at(visit, 0.5 * side, zero), at(far, side, turn), at(visit, 0.5 * side, zero), at(zero, zero, zero))
    yaw = F.array(at(zero, zero, zero), at(zero, zero, 0.5 * turn), at(zero, zero, turn), at(zero, zero, turn + 0.58 * (180.0 - turn)), at(zero, zero, F.lit(180.0)), at(zero, zero, turn + 0.58 * (180.0 - turn)), at(zero, zero, zero))
    peek = F.array(at(zero, zero, zero), at(0.5 * d, zero, zero), at(d, zero, zero), at(0.82 * far, side, zero), at(F.least(0.1 * far, F.lit(0.25)), zero, zero), at(0.82 * far, side, zero), at(zero, zero, zero))
    return F.when(template == "forward_backward", forward).when(template == "lateral_out_and_back", lateral).when(template == "yaw_return", yaw).when(template == "peek_occlude_retract", peek)


def _least_intervals(move: Column, turn: Column) -> Column:
    """Intervals that a quintic step over a distance and an angle needs, two frames at the least."""

    def seconds(length: Column, limits: tuple[float, float, float]) -> Column:
        v, a, j = (q * length / limit for q, limit in zip(QUINTIC, limits, strict=True))
        return F.greatest(v, F.sqrt(a), F.cbrt(j))

    return F.greatest(F.ceil(F.greatest(seconds(move, MOVE_LIMITS), seconds(turn, TURN_LIMITS)) * FPS - 1e-9), F.lit(1)).cast("int")


def allocate(routes: DataFrame, carry: list[str]) -> DataFrame:
    """(carried, events, frames, feasible): the events, and the frame of each.

    routes has template, distance, far, side and turn. Intervals beyond what the limits
    ask are dealt in proportion, whole ones first and then by the largest remainder,
    earlier segments first. An unknown template, or one that needs more intervals than
    there are, is not feasible and has no frames.
    """
    e = routes.select(*carry, _events(F.col("template"), F.col("distance"), F.col("far"), F.col("side"), F.col("turn")).alias("events"))
    e = settled(e)
    legs = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(F.get("events", i).alias("a"), F.get("events", i + 1).alias("b")))
    gap = lambda s, c: s["b"][c] - s["a"][c]
    need = F.transform(legs, lambda s: _least_intervals(F.sqrt(gap(s, "progress") * gap(s, "progress") + gap(s, "lateral") * gap(s, "lateral")), F.abs(gap(s, "yaw"))))
    e = e.select(*carry, "events", F.when(F.col("events").isNotNull(), need).alias("need"))
    e = settled(e)
    total = F.aggregate("need", F.lit(0), lambda a, x: a + x)
    e = e.select(*carry, "events", "need", total.alias("total"))
    e = settled(e)
    exact = F.transform("need", lambda n: n / F.col("total").cast("double") * (INTERVALS - F.col("total")))
    e = e.select(*carry, "events", "need", "total", exact.alias("exact"))
    e = settled(e)
    left = INTERVALS - F.col("total") - F.aggregate(F.transform("exact", lambda x: F.floor(x).cast("int")), F.lit(0), lambda a, x: a + x)
    order = F.sort_array(F.transform("exact", lambda x, i: F.struct((-F.round(x - F.floor(x), 9)).alias("r"), i.alias("i"))))
    more = F.transform(F.slice(order, 1, F.greatest(left, F.lit(0)).cast("int")), lambda o: o["i"])
    e = e.select(*carry, "events", "need", "total", "exact", more.alias("more"))
    e = settled(e)
    spans = F.transform("need", lambda n, i: n + F.floor(F.get("exact", i)).cast("int") + F.when(F.array_contains("more", i), 1).otherwise(0))
    e = e.select(*carry, "events", (F.col("total") <= INTERVALS).alias("fits"), spans.alias("spans"))
    e = settled(e)
    frames = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.aggregate(F.slice("spans", 1, k), F.lit(0), lambda a, x: a + x))
    feasible = F.coalesce(F.col("fits"), F.lit(False))
    return e.select(*carry, "events", F.when(feasible, frames).alias("frames"), feasible.alias("feasible"))


def poses(routes: DataFrame, carry: list[str]) -> DataFrame:
    """(carried, frame_index, x, z, yaw, pose) of the 357 frames of every feasible route, from the start's camera.

    Routes are dealt out by the carried columns before their frames are made, so that later
    steps on a route's frames need no shuffle; each leg makes its own frames.
    """
    placed = settled(allocate(routes, carry)).where("feasible")
    placed = placed.repartition(int(routes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *carry)
    leg = lambda i: F.struct(F.get("events", i).alias("a"), F.get("events", i + 1).alias("b"), (F.get("frames", i) + F.when(i == 0, 0).otherwise(1)).alias("first"), F.get("frames", i).alias("begin"), F.get("frames", i + 1).alias("end"))
    legs = placed.select(*carry, F.inline(F.transform(F.sequence(F.lit(0), F.lit(len(EVENTS) - 2)), leg))).where("first <= end")
    rows = legs.withColumn("frame_index", F.explode(F.sequence("first", "end")))
    s = smoothstep((F.col("frame_index") - F.col("begin")) / (F.col("end") - F.col("begin")))
    value = lambda c: F.col(f"a.{c}") + s * (F.col(f"b.{c}") - F.col(f"a.{c}"))
    out = rows.select(*carry, "frame_index", value("lateral").alias("x"), value("progress").alias("z"), value("yaw").alias("yaw"))
    return out.withColumn("pose", yaw_pose(F.col("yaw"), F.col("x"), F.lit(0.0), F.col("z")))


def event_frames(routes: DataFrame, carry: list[str]) -> DataFrame:
    """(carried, event, frame_index) of the seven events of every feasible route."""
    named = F.arrays_zip(F.array(*[F.lit(n) for n in EVENTS]).alias("event"), F.col("frames").alias("frame_index"))
    return allocate(routes, carry).where("feasible").select(*carry, F.inline(named)).toDF(*carry, "event", "frame_index")


def route_checks(track: DataFrame, events: DataFrame, carry: list[str]) -> DataFrame:
    """(carried, returns, revisits, problems): how far the return is from the start and the revisit from the first visit."""
    # Events go to their route, not to its frames, so that frames dealt out by route stay where they are.
    named = events.groupBy(*carry).agg(*[F.max(F.when(F.col("event") == n, F.col("frame_index"))).alias(f"_{n}") for n in EVENTS])
    at = track.select(*carry, "frame_index", "x", "z", "yaw").join(named.hint("shuffle_hash"), carry)
    here = lambda n: F.col("frame_index") == F.col(f"_{n}")
    side = lambda c, n: F.max(F.when(here(n), F.col(c)))
    gap = lambda a, b: F.sqrt(sum(((side(c, a) - side(c, b)) * (side(c, a) - side(c, b)) for c in ("x", "z")), F.lit(0.0))) + F.abs(side("yaw", a) - side("yaw", b))
    found = sum((F.count(F.when(here(n), 1)) for n in EVENTS), F.lit(0))
    out = at.groupBy(*carry).agg(gap("q0", "q0_return").alias("returns"), gap("qc_first", "qc_revisit").alias("revisits"), found.alias("n"))
    problems = F.array_compact(F.array(F.when(F.col("n") != len(EVENTS), F.lit("events")), F.when(F.col("returns") > 1e-6, F.lit("return")), F.when(F.col("revisits") > 1e-6, F.lit("revisit"))))
    return out.select(*carry, "returns", "revisits", problems.alias("problems"))
