"""Long camera routes: a short route kept up to its query view, then 60 seconds in all.

A short route is a track of at most some hundred frames with a query view (QE). Its long
route keeps every frame up to QE, goes on through C, A and B to the far point W, and comes
back over B, A and C to the start, at the speed that the short one had. How far it goes
is found by bisection, so that its length is what that speed travels in the time left.

A route is one row, bisection and the shares of the frames are folds of fixed length over
lengths in closed form. Its polylines are arrays of a bounded length and are made last, so
that what reads plans without them does not pay for them.
Tracks turn about the vertical axis and yaw is continuous in degrees; forward is +z.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.tables import settled
from meridia.functions.vectors import let

# Templates, events after QE, last frame, frames a second, pairs of visits.
TEMPLATES = ("forward_backward", "lateral_out_and_back", "yaw_return", "arc_return", "orbit_around_anchor", "peek_occlude_retract")
EVENTS = ("qc_first", "qa_first", "qb_first", "w", "qb_revisit", "qa_revisit", "qc_revisit", "q0_return")
LAST, FPS = 960, 16
PAIRS = (("C", "qc_first", "qc_revisit"), ("A", "qa_first", "qa_revisit"), ("B", "qb_first", "qb_revisit"))
# Where C, A, B and W lie along a straight way out; circles of an arc; least intervals of a leg.
STOPS = (0.25, 0.5, 0.8, 1.0)
CIRCLES = (1.0, 0.85, 0.7)
LEAST = (1, 1, 1, 80, 80, 1, 1, 1)

AXES = ("x", "y", "z")
Vector = tuple[Column, Column, Column]


def _vector(spot: Column) -> Vector:
    return tuple(spot[a] for a in AXES)


def _spot(at: Vector, yaw: Column) -> Column:
    return F.struct(*[v.alias(a) for v, a in zip(at, AXES, strict=True)], yaw.alias("yaw"))


def _plus(a: Vector, b: Vector, k: Column | float = 1.0) -> Vector:
    return tuple(x + y * k for x, y in zip(a, b, strict=True))


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _norm(a: Vector) -> Column:
    return F.sqrt(_dot(a, a))


def _steps(line: Column, length) -> Column:
    """length(from, to) of every piece of a polyline."""
    return F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda i: length(F.get(line, i), F.get(line, i + 1)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _moved(a: Column, b: Column) -> Column:
    return _norm(_plus(_vector(b), _vector(a), -1.0))


def _turned(a: Column, b: Column) -> Column:
    return F.abs(b["yaw"] - a["yaw"])


def _median_above(values: Column, least: float) -> Column:
    """Median of the values above least, 0 where there is none."""

    def median(held: Column) -> Column:
        n = F.size(held)
        at = lambda k: F.get(held, F.floor(k).cast("int"))
        return F.when(n > 0, (at((n - 1) / 2) + at(n / 2)) / 2).otherwise(0.0)

    return let(F.sort_array(F.filter(values, lambda v: v > least)), median)


def _measured(short: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """One row a route: its settings, its track as an array, speeds of its moving frames and the way to QE."""
    frame = F.struct("frame_index", *[F.col(c).cast("double").alias(c) for c in (*AXES, "yaw")])
    tracks = short.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.collect_list(frame))).alias("track"))
    given = {"direction": 0.0, "heading": 0.0, "speed_ratio": 1.0, "focus_x": None, "focus_y": None, "focus_z": None, "turn_frame": None}
    extra = [(F.col(c) if c in routes.columns else F.lit(v)).cast("double").alias(c) for c, v in given.items()]
    # Routes are little data and much work, so they are dealt to as many tasks as the session has; the tracks follow them.
    dealt = routes.select(*keys, "template", F.col("qe").cast("int").alias("qe"), *extra).repartition(int(short.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    e = dealt.join(tracks, keys, "left")
    number = lambda v: v.isNotNull() & ~F.isnan(v)
    sound = F.forall("track", lambda p: number(p["x"]) & number(p["y"]) & number(p["z"]) & number(p["yaw"])) & (F.transform("track", lambda p: p["frame_index"].cast("int")) == F.sequence(F.lit(0), F.size("track") - 1))
    e = e.withColumn("sound", F.coalesce(F.when(F.size("track") > 1, sound), F.lit(False)))
    e = e.withColumn("track", F.when(F.col("sound"), F.col("track")))
    e = e.withColumns({"q0": F.get("track", F.lit(0)), "q": F.get("track", F.col("qe")), "prefix": F.when((F.col("qe") > 0) & (F.col("qe") < F.size("track")), F.slice("track", 1, F.greatest(F.col("qe") + 1, F.lit(1))))})
    e = settled(e)
    wrapped = lambda a, b: F.abs(F.pmod(b["yaw"] - a["yaw"] + 180.0, F.lit(360.0)) - 180.0) * FPS
    return e.withColumns(
        {
            "way": _sum(_steps(F.col("prefix"), _moved)),
            "reach": _moved(F.col("q0"), F.col("q")),
            "linear": _median_above(_steps(F.col("track"), lambda a, b: _moved(a, b) * FPS), 1e-6),
            "angular": _median_above(_steps(F.col("track"), wrapped), 1e-5),
            "seconds": (LAST - F.col("qe")) / FPS,
        }
    )


def _unit(v: Vector, fallback: Vector) -> Vector:
    n, m = _norm(v), _norm(fallback)
    return tuple(F.when(n > 1e-9, a / n).otherwise(b / m) for a, b in zip(v, fallback, strict=True))


def _with_basis(e: DataFrame) -> DataFrame:
    """Columns `primary`, the way out, and `lateral`, at right angles to it; turned by `direction` where the template takes it."""
    turn = F.radians(F.col("q0.yaw"))
    right, ahead = (F.cos(turn), F.lit(0.0), -F.sin(turn)), (F.sin(turn), F.lit(0.0), F.cos(turn))
    gone = _plus(_vector(F.col("q")), _vector(F.col("q0")), -1.0)
    pack = lambda v: F.struct(*[c.alias(a) for c, a in zip(v, AXES, strict=True)])
    sideways = F.col("template") == "lateral_out_and_back"
    e = e.withColumn("primary", F.when(sideways, pack(_unit(gone, right))).otherwise(pack(_unit(gone, ahead))))
    e = settled(e)
    primary = _vector(F.col("primary"))
    across = lambda v: _plus(v, primary, -_dot(v, primary))
    first, second = across(right), across(ahead)
    rest = tuple(F.when(_norm(first) > 1e-9, a).otherwise(b) for a, b in zip(first, second, strict=True))
    e = settled(e.withColumn("lateral", pack(_unit(rest, right))))
    bent = F.when(F.col("template").isin("forward_backward", "lateral_out_and_back", "peek_occlude_retract"), F.radians("direction")).otherwise(0.0)
    p, s = _vector(F.col("primary")), _vector(F.col("lateral"))
    ahead_of = tuple(F.cos(bent) * a + F.sin(bent) * b for a, b in zip(p, s, strict=True))
    beside = tuple(F.cos(bent) * b - F.sin(bent) * a for a, b in zip(p, s, strict=True))
    return e.withColumns({"primary": pack(ahead_of), "lateral": pack(beside)})


def _with_peek(e: DataFrame) -> DataFrame:
    """Columns of the peek: `aside` (direction), `aside_by` and `beyond` (how far the short route went past QE), as its track shows them up to the turn."""
    start, primary = _vector(F.col("q0")), _vector(F.col("primary"))
    stop = F.greatest(F.col("qe") + 1, F.coalesce(F.col("turn_frame").cast("int"), F.floor(F.size("track") / 2).cast("int")))
    span = F.slice("track", F.col("qe") + 1, F.greatest(stop - F.col("qe"), F.lit(1)))
    off = lambda p: _plus(_vector(p), start, -1.0)
    aside = lambda p: _plus(off(p), primary, -_dot(off(p), primary))
    found = F.transform(span, lambda p, i: F.struct(_norm(aside(p)).alias("n"), (-i).alias("i"), *[v.alias(a) for v, a in zip(aside(p), AXES, strict=True)], _dot(off(p), primary).alias("along")))
    e = settled(e.withColumn("_found", F.when(F.col("template") == "peek_occlude_retract", found)))
    e = settled(e.withColumns({"_most": F.array_max("_found"), "_along": F.array_max(F.transform("_found", lambda f: f["along"]))}))
    seen = F.col("_most.n") > 1e-6
    direction = F.struct(*[F.when(seen, F.col(f"_most.{a}") / F.col("_most.n")).otherwise(F.col(f"lateral.{a}")).alias(a) for a in AXES])
    return e.withColumns({"aside": direction, "aside_by": F.greatest("_most.n", 0.15 * F.col("reach"), F.lit(1e-3)), "beyond": F.greatest(F.col("_along") - F.col("reach"), 0.5 * F.col("reach"), F.lit(1e-3))}).drop("_found", "_most", "_along")


def _ramp(t: Column) -> Column:
    u = F.least(t / 0.3, F.lit(1.0))
    return u * u * (3.0 - 2.0 * u)


def _lift(scale: Column) -> Column:
    return F.col("aside_by") * F.greatest(F.lit(1.0), scale / F.col("beyond"))


def _peek_far(scale: Column) -> Vector:
    return _plus(_plus(_vector(F.col("q")), _vector(F.col("primary")), scale), _vector(F.col("aside")), _lift(scale))


def _peek_near() -> Vector:
    start = _vector(F.col("q0"))
    return _plus(start, _plus(_vector(F.col("q")), start, -1.0), 0.1)


def _half(width: float) -> Column:
    """Length of a half circle of radius 1 in 400 pieces, stretched by width."""
    return F.lit(sum(math.hypot(math.cos(math.pi * k / 400) - math.cos(math.pi * (k + 1) / 400), width * (math.sin(math.pi * (k + 1) / 400) - math.sin(math.pi * k / 400))) for k in range(400)))


def _rises(first: int, stop: int, along: Column, up: Column) -> Column:
    """Length of the pieces first to stop - 1 of a peek's ramp, each `along` wide, the whole ramp `up` high."""
    ramp = [min(i * 0.00125 / 0.3, 1.0) ** 2 * (3.0 - 2.0 * min(i * 0.00125 / 0.3, 1.0)) for i in range(first, stop + 1)]
    return F.aggregate(F.lit([b - a for a, b in zip(ramp[:-1], ramp[1:], strict=True)]), F.lit(0.0), lambda s, r: s + F.hypot(along, r * up))


def _length(width: float):
    """length(scale) of a route of each template that has a scale, QE to the start.

    Beyond `beyond` a peek's ramp grows in proportion to the scale, so its length is one product with `slope`.
    """
    half = _half(width)

    def peek(scale: Column) -> Column:
        rise = F.when(scale >= F.col("beyond"), scale * F.col("slope")).otherwise(_rises(0, 240, scale * 0.00125, F.col("aside_by")))
        return 2 * (rise + 0.7 * scale) + 2 * _norm(_plus(_peek_far(scale), _peek_near(), -1.0))

    def length(scale: Column) -> Column:
        t = F.col("template")
        return F.col("way") + F.when(t == "arc_return", scale * (0.6 + 2 * sum(CIRCLES) * half)).when(t == "peek_occlude_retract", peek(scale)).otherwise(2 * scale)

    return length


def _bisected(target: Column, length, reference: Column) -> Column:
    """The scale at which length reaches target, by doubling and 64 halvings; a quarter of reference if it is there at 0."""
    high = F.aggregate(F.sequence(F.lit(1), F.lit(44)), F.greatest(reference, F.lit(0.25)), lambda h, _: F.when((length(h) < target) & (h < 1e6), h * 2).otherwise(h))

    def halve(s: Column, _: Column) -> Column:
        middle = 0.5 * (s["low"] + s["high"])
        return F.when(length(middle) < target, F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.lit(0.0).alias("low"), high.alias("high")), halve, lambda s: 0.5 * (s["low"] + s["high"]))
    return F.when(target <= length(F.lit(0.0)) + 1e-9, F.greatest(reference * 0.25, F.lit(1e-3))).otherwise(found)


def _weights(width: float) -> Column:
    """Ways of the eight legs that _legs() makes, angles for yaw_return, without making them."""
    scale, way, half = F.col("amplitude"), F.col("way"), _half(width)
    back = lambda *out: F.array(*out, *out[:0:-1], out[0] + way)
    line = back(*[scale * (b - a) for a, b in zip((0.0, *STOPS), STOPS, strict=False)])
    arc = back(scale * 0.3, *[scale * (r * half) for r in CIRCLES])
    ramp = lambda first, stop: _rises(first, stop, scale * 0.00125, _lift(scale))
    peek = back(ramp(0, 200), ramp(200, 240) + 0.2 * scale, 0.5 * scale, _norm(_plus(_peek_far(scale), _peek_near(), -1.0)))
    orbit = back(*[800.0 * F.col("radius") * F.sin(F.radians("span") * (b - a) / 800.0) for a, b in zip((0.0, *STOPS), STOPS, strict=False)])
    first, peak = F.col("yaw_start"), F.col("peak")
    part = F.abs(peak - first) / 4
    yaws = F.array(part, part, part, part + 2 * F.col("loops") * F.abs(peak - F.signum(peak) * 240.0), part, part, part, F.abs(first + (peak - first) * 0.25))
    t = F.col("template")
    return F.when(t == "yaw_return", yaws).when(t == "arc_return", arc).when(t == "peek_occlude_retract", peek).when(t == "orbit_around_anchor", orbit).otherwise(line)


def _there_and_back(out: list[Column], home: Column) -> Column:
    """Eight legs: four out, and the same four back, the last of them joined to the way home."""
    back = [F.reverse(leg) for leg in reversed(out)]
    return F.array(*out, *back[:3], F.concat(back[3], home))


def _even(n: int, spot) -> Column:
    """spot(k / n) for k = 0 .. n."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: spot(k / float(n)))


def _legs(width: float) -> Column:
    q, scale, yaw, primary, lateral = _vector(F.col("q")), F.col("amplitude"), F.col("q.yaw"), _vector(F.col("primary")), _vector(F.col("lateral"))
    start = _spot(_vector(F.col("q0")), F.col("q0.yaw"))
    home = F.transform(F.slice(F.reverse("prefix"), 2, F.greatest(F.col("qe"), F.lit(0))), lambda p: _spot(_vector(p), p["yaw"]))
    straight = [_spot(_plus(q, primary, scale * t), yaw) for t in (0.0, *STOPS)]
    line = _there_and_back([F.array(a, b) for a, b in zip(straight[:-1], straight[1:], strict=True)], home)

    bases, foot = [], 0.3
    for r in CIRCLES:
        bases.append(foot)
        foot += 2 * r

    def circle(k: int, back: bool) -> Column:
        def spot(t: Column) -> Column:
            at = math.pi * (t + 1.0 if back else t)
            middle = _plus(q, primary, scale * (bases[k] + CIRCLES[k] * (1.0 - F.cos(at))))
            return _spot(_plus(middle, lateral, scale * CIRCLES[k] * width * F.sin(at)), yaw)

        low, up = (_spot(_plus(q, primary, scale * (bases[k] + 2 * CIRCLES[k] * end)), yaw) for end in (0, 1))
        inner = F.slice(_even(400, spot), 2, 399)
        return F.concat(F.array(up if back else low), inner, F.array(low if back else up))

    stem = F.array(_spot(q, yaw), _spot(_plus(q, primary, scale * 0.3), yaw))
    arc = F.array(stem, circle(0, False), circle(1, False), circle(2, False), circle(2, True), circle(1, True), circle(0, True), F.concat(F.reverse(stem), home))

    rising = lambda t: _spot(_plus(_plus(q, primary, scale * t), _vector(F.col("aside")), _lift(scale) * _ramp(t)), yaw)
    near_yaw = yaw + F.pmod(F.col("q0.yaw") - yaw + 180.0, F.lit(360.0)) - 180.0
    ups = [_even(200, lambda u: rising(u * 0.25)), _even(200, lambda u: rising(0.25 + u * 0.25)), F.array(rising(F.lit(0.5)), rising(F.lit(1.0)))]
    retract = F.array(rising(F.lit(1.0)), _spot(_peek_near(), near_yaw))
    peek = F.array(*ups, retract, F.reverse(retract), F.reverse(ups[2]), F.reverse(ups[1]), F.concat(F.reverse(ups[0]), home))

    def around(t: Column) -> Column:
        at = F.col("orbit_start") + F.radians("span") * F.col("orbit_sign") * t
        return _spot((F.col("focus_x") + F.col("radius") * F.cos(at), q[1], F.col("focus_z") + F.col("radius") * F.sin(at)), yaw - F.col("orbit_sign") * F.col("span") * t)

    ends = [(0.0, 0.25), (0.25, 0.5), (0.5, 0.8), (0.8, 1.0)]
    ways = [_even(400, lambda u, a=a, b=b: around(a + u * (b - a))) for a, b in ends]
    orbit = _there_and_back([F.concat(F.array(_spot(q, yaw)), F.slice(ways[0], 2, 400)), *ways[1:]], home)

    base, first, peak = F.col("q0.yaw"), F.col("yaw_start"), F.col("peak")
    heading = lambda y: _spot(q, base + y)
    c, a, b = (heading(first + (peak - first) * t) for t in (0.25, 0.5, 0.75))
    swing = F.flatten(F.transform(F.sequence(F.lit(1), F.col("loops") + 1), lambda k: F.when(k == 1, F.array(b, heading(peak))).otherwise(F.array(heading(F.signum(peak) * 240.0), heading(peak)))))
    yaws = F.array(F.array(heading(first), c), F.array(c, a), F.array(a, b), swing, F.array(heading(peak), b), F.array(b, a), F.array(a, c), F.array(c, start))

    t = F.col("template")
    return F.when(t == "yaw_return", yaws).when(t == "arc_return", arc).when(t == "peek_occlude_retract", peek).when(t == "orbit_around_anchor", orbit).otherwise(line)


def _with_orbit(e: DataFrame) -> DataFrame:
    """Radius, start, direction and span of an orbit: the widest of 20 to 300 degrees, by bisection, whose way there and back the speed allows."""
    q, recent = F.col("q"), F.get("track", F.greatest(F.col("qe") - 4, F.lit(0)))
    dx, dz = q["x"] - F.col("focus_x"), q["z"] - F.col("focus_z")
    e = e.withColumns({"radius": F.hypot(dx, dz), "orbit_start": F.atan2(dz, dx), "_tangential": ((q["z"] - recent["z"]) * dx - (q["x"] - recent["x"]) * dz) / F.hypot(dx, dz)})
    e = settled(e.withColumn("orbit_sign", F.signum("_tangential")))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        long = 9600.0 * F.col("radius") * F.sin(F.radians(middle) / 4800.0) + F.col("way")
        return F.when(long > F.col("target"), F.struct(s["low"].alias("low"), middle.alias("high"))).otherwise(F.struct(middle.alias("low"), s["high"].alias("high")))

    span = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(F.lit(20.0).alias("low"), F.lit(300.0).alias("high")), halve, lambda s: s["low"])
    return e.withColumn("span", F.when((F.col("template") == "orbit_around_anchor") & (F.abs("_tangential") >= 1e-10), span))


def _shared(weights: Column) -> Column:
    """Intervals of the eight legs after QE: in proportion to weights, at least LEAST, by the largest remainder (to 9 digits), earlier legs first."""
    least = F.array(*[F.lit(float(m)) for m in LEAST])
    total = (F.lit(LAST) - F.col("qe")).cast("double")
    fill = lambda safe, fixed: (total - _sum(F.zip_with(fixed, least, lambda f, m: F.when(f, m).otherwise(0.0)))) / F.greatest(_sum(F.zip_with(fixed, safe, lambda f, w: F.when(f, 0.0).otherwise(w))), F.lit(1e-300))

    def shares(safe: Column) -> Column:
        again = lambda fixed, _: let(fill(safe, fixed), lambda rate: F.transform(fixed, lambda f, i: f | (F.get(safe, i) * rate < F.get(least, i))))
        settle = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.array(*[F.lit(False)] * 8), again)
        return let(settle, lambda fixed: let(fill(safe, fixed), lambda rate: F.transform(fixed, lambda f, i: F.when(f, F.get(least, i)).otherwise(F.get(safe, i) * rate))))

    return F.when(weights.isNotNull(), let(F.transform(weights, lambda w: F.greatest(w, F.lit(1e-9))), shares))


def plans(short: DataFrame, routes: DataFrame, keys: list[str], gap_seconds: float = 5.0, width: float = 1.0) -> DataFrame:
    """(keys, template, qe, reason, target, amplitude, span, legs, counts, frames): the plan of every long route.

    short has (keys, frame_index, x, y, z, yaw), frames from 0 without gaps; equal rows
    count once. routes has a row a route with (keys, template, qe), qe being the frame of
    the query view, and may have direction (degrees, turns the way out), heading (degrees
    added between the visits of C), speed_ratio (0.75 to 1.25), turn_frame (of a peek) and
    focus_x, focus_y, focus_z (of an orbit, at the camera's height). width stretches arcs.
    Straight ways, arcs and peeks go as far as amplitude says, orbits as far as span.

    A route that can't be made has a reason, no legs and no frames: `template`, `track`
    (missing, with gaps, or null values), `qe` (not inside the track), `settings`,
    `focus`, `yaw_room`, `budget` (an orbit of 20 degrees is too long), `motion` (a leg
    without any) or `revisit_gap`.
    """
    e = _measured(short, routes, keys)
    t, qe = F.col("template"), F.col("qe")
    speed = F.when(F.col("linear") > 0, F.col("linear")).when(F.col("reach") > 0, F.col("reach") / F.greatest(qe / FPS, F.lit(1.0))).otherwise(0.25)
    e = e.withColumn("target", F.col("speed_ratio") * F.when(t == "yaw_return", F.col("reach")).otherwise(speed * F.col("seconds")))
    e = _with_orbit(settled(_with_peek(settled(_with_basis(settled(e))))))
    e = e.withColumn("slope", F.when(t == "peek_occlude_retract", _rises(0, 240, F.lit(0.00125), F.col("aside_by") / F.col("beyond"))))
    e = settled(e)
    scaled = ~t.isin("yaw_return", "orbit_around_anchor")
    e = e.withColumn("amplitude", F.when(scaled & (F.col("target") > 0), _bisected(F.col("target"), _length(width), F.col("way"))).otherwise(0.0))

    start = F.col("q.yaw") - F.col("q0.yaw")
    budget = F.round(F.col("angular") * F.col("seconds"), 9)
    sign = F.when(start >= 0, 1.0).otherwise(-1.0)
    e = e.withColumns({"yaw_start": start, "peak": sign * F.least(F.greatest((budget + F.abs(start)) / 2, F.lit(180.0)), F.lit(300.0))})
    e = settled(e)
    spare = budget - F.abs(F.col("peak") - F.col("yaw_start")) - F.abs("peak")
    e = e.withColumn("loops", F.greatest(F.floor(F.round(spare / 120.0 + 0.5, 9)), F.lit(0)).cast("int"))

    farthest = F.array_max(F.transform("prefix", lambda p: F.abs(p["yaw"] - F.col("q0.yaw"))))
    limit = F.when(t.isin("forward_backward", "lateral_out_and_back"), 20).otherwise(30)
    orbit, turn = t == "orbit_around_anchor", t == "yaw_return"
    steady = F.coalesce(F.abs("direction") <= limit, F.lit(False)) & F.coalesce(F.col("speed_ratio").between(0.75, 1.25), F.lit(False))
    faced = F.coalesce((F.col("heading") == 0) | ((F.abs("heading") <= 20) & (limit == 20)), F.lit(False))
    arcs = sum((1600.0 * F.col("radius") * F.sin(F.radians(F.col("span")) * (b - a) / 800.0) for a, b in ((0.0, 0.25), (0.25, 0.5), (0.5, 0.8), (0.8, 1.0))), F.lit(0.0))
    reason = (
        F.when(~F.coalesce(t.isin(*TEMPLATES), F.lit(False)), "template")
        .when(~F.col("sound"), "track")
        .when(F.col("prefix").isNull() | (qe > LAST - sum(LEAST)), "qe")
        .when(~steady | ~faced, "settings")
        .when(orbit & ~F.coalesce((F.col("radius") >= 1e-6) & F.col("span").isNotNull(), F.lit(False)), "focus")
        .when(turn & ((farthest > 300 + 1e-6) | (F.abs(F.col("peak") - F.col("yaw_start")) < 1) | (F.abs("peak") <= F.abs("yaw_start") + 1)), "yaw_room")
        .when(orbit & (arcs + F.col("way") > F.col("target") + 1e-6), "budget")
    )
    e = settled(settled(e).withColumn("reason", reason))
    e = e.withColumn("weights", F.when(F.col("reason").isNull(), _weights(width)))
    e = settled(settled(e).withColumn("shares", _shared(F.col("weights"))))
    left = F.lit(LAST) - qe - F.aggregate("shares", F.lit(0), lambda s, v: s + F.floor(F.round(v, 9)).cast("int"))
    ranked = F.sort_array(F.transform("shares", lambda v, i: F.struct((-F.round(v - F.floor(F.round(v, 9)), 9)).alias("r"), i.alias("i"))))
    e = e.withColumn("_more", F.transform(F.slice(ranked, 1, F.greatest(left, F.lit(0))), lambda o: o["i"]))
    e = settled(e).withColumn("counts", F.transform("shares", lambda v, i: F.floor(F.round(v, 9)).cast("int") + F.array_contains("_more", i).cast("int")))
    e = settled(e).withColumn("frames", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: qe + F.aggregate(F.slice("counts", 1, k), F.lit(0), lambda s, v: s + v)))
    e = settled(e)
    place = {n: F.get("frames", F.lit(k)) for k, n in enumerate(EVENTS)}
    close = [place[b] - place[a] < gap_seconds * FPS for _, a, b in PAIRS]
    late = F.when(F.exists("weights", lambda w: w <= 1e-12), "motion").when(close[0] | close[1] | close[2], "revisit_gap")
    e = e.withColumn("reason", F.coalesce("reason", late))
    fine = F.col("reason").isNull()
    e = settled(e)
    # Legs are made from columns that are settled, in the last step of all.
    kept = {n: F.when(fine, _legs(width) if n == "legs" else F.col(n)).alias(n) for n in ("target", "amplitude", "span", "legs", "counts", "frames", "prefix")}
    return e.select(*keys, "template", "qe", "reason", "heading", *kept.values())


def events(planned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event, frame_index): start, query view and the eight events after it of every route that has a plan."""
    named = F.arrays_zip(F.array(*[F.lit(n) for n in ("q0", "qe", *EVENTS)]).alias("event"), F.concat(F.array(F.lit(0), F.col("qe")), "frames").alias("frame_index"))
    return planned.where("reason IS NULL").select(*keys, F.inline(named)).toDF(*keys, "event", "frame_index")


def _spread(lines: pa.Array, sizes: pa.Array, turns: pa.Array) -> pa.Array:
    """size spots along each line, from its start and short of its end, evenly by way (by angle for a turn); the line's own where size is null."""
    names = (*AXES, "yaw")
    at, ends = np.vstack([f.to_numpy(zero_copy_only=False) for f in lines.flatten().flatten()]), lines.offsets.to_numpy() - lines.offsets[0].as_py()
    step = np.diff(at, axis=1)
    ways, angles = np.sqrt(step[0] * step[0] + step[1] * step[1] + step[2] * step[2]), np.abs(step[3])
    found = []
    for a, b, size, turn in zip(ends[:-1], ends[1:], sizes.to_pylist(), turns.to_pylist(), strict=True):
        if size is None or b - a < 2:
            found.append(at[:, a : b if size is None else a])
            continue
        border = np.cumsum((angles if turn else ways)[a : b - 1])
        border = border * size / border[-1]
        border[-1] = size
        i = np.arange(size)
        k = np.searchsorted(border, i, side="right")
        before = np.append(0.0, border)[k]
        found.append(at[:, a + k] + (i - before) / (border[k] - before) * step[:, a + k])
    spots = np.concatenate(found, axis=1) if found else at[:, :0]
    offsets = np.cumsum([0, *[f.shape[1] for f in found]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in spots], names))


def frames(planned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame_index, x, y, z, yaw): the 961 frames of every route that has a plan.

    Frames up to QE are those of the short route, bit by bit, and the last is its first.
    Within a leg frames lie evenly by way (by angle for yaw_return).
    """
    bare = lambda p: _spot(_vector(p), p["yaw"])
    kept = F.struct(F.transform(F.slice("prefix", 1, F.col("qe")), bare).alias("line"), F.lit(None).cast("int").alias("size"), F.lit(0).alias("begin"))
    new = F.transform("legs", lambda leg, i: F.struct(leg.alias("line"), F.get("counts", i).alias("size"), F.when(i == 0, F.col("qe")).otherwise(F.get("frames", i - 1)).alias("begin")))
    last = F.struct(F.transform(F.slice("prefix", 1, 1), bare).alias("line"), F.lit(None).cast("int").alias("size"), F.lit(LAST).alias("begin"))
    e = planned.where("reason IS NULL").select(*keys, "heading", "qe", (F.col("template") == "yaw_return").alias("turn"), F.get("frames", F.lit(0)).alias("c1"), F.get("frames", F.lit(6)).alias("c2"), F.inline(F.concat(F.array(kept), new, F.array(last))))
    spots = F.arrow_udf(_spread, "array<struct<x:double,y:double,z:double,yaw:double>>")("line", "size", "turn")
    e = e.select(*keys, "heading", "qe", "c1", "c2", "begin", F.posexplode(spots))
    value = {c: F.col(f"col.{c}") for c in (*AXES, "yaw")}
    at = F.col("begin") + F.col("pos")
    smooth = lambda u: F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * (3 - 2 * F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)))
    end = F.greatest(F.col("c2") + 1, LAST - F.col("qe"))
    held = F.when(at <= F.col("c2"), smooth((at - F.col("qe")) / (F.col("c1") - F.col("qe")))).otherwise(1 - smooth((at - F.col("c2")) / (end - F.col("c2"))))
    value["yaw"] = F.when(F.col("heading") != 0, value["yaw"] + F.col("heading") * held).otherwise(value["yaw"])
    return e.select(*keys, at.alias("frame_index"), *[v.alias(c) for c, v in value.items()])


def excursions(track: DataFrame, named: DataFrame, keys: list[str], pairs: tuple = PAIRS) -> DataFrame:
    """(keys, pair, closed, moved, turned, excursion): whether each pair of visits meets in one pose, and goes somewhere in between.

    named has (keys, event, frame_index). Poses meet to 1e-6 in each coordinate and matrix
    entry (bounded here by the angle); an excursion moves or turns by more than 1e-6 from
    the first visit. Frames stay with their route: no row is repeated for its pairs.
    """
    at = lambda n: F.max(F.when(F.col("event") == n, F.col("frame_index")))
    spans = named.groupBy(*keys).agg(*[F.struct(at(a).alias("a"), at(b).alias("b")).alias(f"_{p}") for p, a, b in pairs])
    values = (*AXES, "yaw")
    rows = track.select(*keys, "frame_index", *values).join(spans, keys)
    inside = {p: F.coalesce((F.col(f"_{p}.a") < F.col(f"_{p}.b")) & F.col("frame_index").between(F.col(f"_{p}.a"), F.col(f"_{p}.b")), F.lit(False)) for p, _, _ in pairs}
    # The window has no order: a route's rows are read as they come, and each pair's first visit is put beside them.
    first = {p: F.min_by(F.struct(*values), F.when(inside[p], F.col("frame_index"))).over(Window.partitionBy(*keys)).alias(f"{p}0") for p in inside}
    rows = rows.select(*keys, "frame_index", *values, *[F.when(inside[p], F.col("frame_index") == F.col(f"_{p}.b")).alias(f"{p}_end") for p in inside], *first.values())
    made = {}
    for p in inside:
        there, start = F.col(f"{p}_end").isNotNull(), F.col(f"{p}0")
        angle = F.radians(F.abs(F.pmod(F.col("yaw") - start["yaw"] + 180.0, F.lit(360.0)) - 180.0))
        off = F.sqrt(sum(((F.col(v) - start[v]) * (F.col(v) - start[v]) for v in AXES), F.lit(0.0)))
        same = F.greatest(*[F.abs(F.col(v) - start[v]) for v in AXES], angle) <= 1e-6
        made[p] = [F.bool_or(F.when(there, F.col(f"{p}_end") & same)).alias(f"{p}_closed"), F.max(F.when(there, off)).alias(f"{p}_moved"), F.max(F.when(there, angle)).alias(f"{p}_turned"), F.count(F.when(there, 1)).alias(f"{p}_n")]
    sums = rows.groupBy(*keys).agg(*[c for columns in made.values() for c in columns])
    told = [F.struct(F.lit(p).alias("pair"), *[F.col(f"{p}_{c}").alias(c) for c in ("closed", "moved", "turned", "n")]) for p in made]
    out = sums.select(*keys, F.inline(F.array(*told))).where("n > 0").drop("n")
    return out.withColumn("excursion", (F.col("moved") > 1e-6) | (F.col("turned") > 1e-6))
