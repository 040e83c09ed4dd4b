"""Queries of scenes: clearance to voxels, revisit search, dense projection and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.operators import neighbours, projection, revisits
from meridia.plans.fixtures import MEASUREMENT, POINTS, measurement, points, steady, table
from meridia.plans.registry import query

c = F.col


@query(
    "voxel_clearance",
    f"""WITH {POINTS}, vox AS (SELECT DISTINCT part, floor(x / 2) * 2 + 1 AS vx, floor(y / 2) * 2 + 1 AS vy, floor(z / 2) * 2 + 1 AS vz FROM points WHERE l_linenumber % 2 = 1),
    p AS (SELECT DISTINCT part, x * 3 AS x, y, z - 40 AS z FROM points WHERE l_linenumber % 2 = 0),
    r AS (SELECT p.*, vx, vy, vz, row_number() OVER (PARTITION BY part, x, y, z ORDER BY (vx - x) * (vx - x) + (vy - y) * (vy - y) + (vz - z) * (vz - z), vx, vy, vz) AS rn FROM p JOIN vox USING (part))
    SELECT part, x, y, z, round(min(sqrt(greatest(abs(vx - x) - 1, 0) * greatest(abs(vx - x) - 1, 0) + greatest(abs(vy - y) - 1, 0) * greatest(abs(vy - y) - 1, 0) + greatest(abs(vz - z) - 1, 0) * greatest(abs(vz - z) - 1, 0))) + 1e-9, 6) AS clearance
    FROM r WHERE rn <= 16 GROUP BY part, x, y, z""",
)
def voxel_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the points, stretched and moved away, against the boxes that the other half fills."""
    p = points(spark, sf_dir)
    centre = lambda name: (F.floor(c(name) / 2) * 2 + 1).cast("double").alias(name)
    filled = p.where("l_linenumber % 2 = 1").select("part", *[centre(a) for a in "xyz"]).distinct()
    asked = p.where("l_linenumber % 2 = 0").select("part", (c("x") * 3).alias("x"), "y", (c("z") - 40).alias("z"))
    return neighbours.box_clearance(asked, filled, ["part"], ["x", "y", "z"], 2.0).withColumn("clearance", steady("clearance", 6))


_TRACK = MEASUREMENT + """, track AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY t, event_id) - 1 AS i, value AS x, CAST(event_id * 37 % 360 - 180 AS DOUBLE) AS yaw FROM measurement),
turns AS (SELECT model, CAST(floor(count(*) / 2) AS BIGINT) AS turn, count(*) - 1 AS stop FROM track GROUP BY model),
cand AS (
  SELECT a.model, a.i AS first, b.i AS revisit, sqrt((b.x - a.x) * (b.x - a.x)) AS distance, abs(((b.yaw - a.yaw + 180) % 360 + 360) % 360 - 180) AS angle_error
  FROM track a JOIN turns USING (model) JOIN track b ON b.model = a.model AND b.i = turn + CAST(round_even((turn - a.i) / CAST(turn AS DOUBLE) * (stop - turn), 0) AS BIGINT)
  WHERE a.i < turn AND a.i > 0 AND b.i > turn AND b.i < stop AND b.i - a.i >= 5),
fit AS (SELECT * FROM cand WHERE distance <= 100 AND angle_error <= 45)"""


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("model").orderBy("t", "event_id")).cast("long") - 1
    return measurement(spark, sf_dir).select("model", i.alias("i"), c("value").alias("x"), (c("event_id") * 37 % 360 - 180).cast("double").alias("yaw"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = _track(spark, sf_dir)
    turns = track.groupBy("model").agg(F.floor(F.count("*") / 2).alias("turn"), (F.count("*") - 1).alias("stop"))
    return revisits.mirrored_pairs(track, turns, ["model"], "i", ["x"], "yaw", 5, 100.0, 45.0)


@query("revisit_candidates", f"WITH {_TRACK} SELECT model, first, revisit, round(distance, 9) AS distance, angle_error FROM fit")
def revisit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).withColumn("distance", F.round("distance", 9))


@query(
    "revisit_search",
    f"""WITH {_TRACK}, n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY first DESC) - 1 AS n, least(first * 5 % 17, revisit * 3 % 17) AS novelty, (first * 7 + revisit * 13) % 11 AS shared FROM fit),
    best AS (SELECT model, first AS centre FROM n WHERE n % 4 = 0 QUALIFY row_number() OVER (PARTITION BY model ORDER BY novelty DESC, shared DESC, revisit - first DESC, distance, angle_error, first DESC) = 1),
    seen AS (SELECT n.* FROM n JOIN best USING (model) WHERE n % 4 = 0 OR abs(first - centre) <= 3)
    SELECT model, first, revisit, novelty, shared, round(distance, 9) AS distance, angle_error FROM seen
    QUALIFY row_number() OVER (PARTITION BY model ORDER BY novelty DESC, shared DESC, revisit - first DESC, distance, angle_error, first DESC) = 1""",
)
def revisit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth candidate is scored, then those round the best; greatest novelty, overlap and gap, least pose errors."""
    score = lambda df: df.withColumns({"novelty": F.least(c("first") * 5 % 17, c("revisit") * 3 % 17), "shared": (c("first") * 7 + c("revisit") * 13) % 11})
    by = [c("novelty"), c("shared"), c("revisit") - c("first"), -c("distance"), -c("angle_error")]
    found = revisits.coarse_to_fine(_candidates(spark, sf_dir), ["model"], "first", score, by)
    return found.select("model", "first", "revisit", "novelty", "shared", F.round("distance", 9).alias("distance"), "angle_error")


#: Cameras (fx, fy, cx, cy) and poses of two views; the second is turned by a 7-24-25 triangle.
_RGB, _DEPTH = (14.0, 13.0, 8.0, 6.0), (13.0, 12.5, 7.75, 6.25)
_POSES = {
    0: ((1.0, 0.0, 0.0, 0.125), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0)),
    1: ((0.96, 0.0, 0.28, 0.25), (0.0, 1.0, 0.0, 0.0625), (-0.28, 0.0, 0.96, -0.125), (0.0, 0.0, 0.0, 1.0)),
}
_PIXELS = """px AS (
  SELECT l_suppkey % 20 AS k, l_linenumber % 2 AS side, l_partkey % 12 AS row, l_orderkey % 16 AS col, 2 + sum(l_quantity) / count(*) / 64 AS depth, sum(l_linenumber) % 5 <> 0 AS valid,
         sum(l_orderkey) % 256 AS r, sum(l_partkey) % 256 AS g, sum(l_suppkey) % 256 AS b FROM lineitem GROUP BY ALL)"""


def _projected_sql(name: str, target: int, source: int) -> str:
    p, q = _POSES[target], _POSES[source]
    d = lambda x: f"CAST({x} AS DOUBLE)"
    world = [f"({d(p[r][0])} * (x * z) + {d(p[r][1])} * (y * z) + {d(p[r][2])} * z + {d(p[r][3])} - {d(q[r][3])})" for r in range(3)]
    at = [" + ".join(f"{d(q[r][i])} * {world[r]}" for r in range(3)) for i in range(3)]
    seen = lambda camera, f, i: f"CAST(floor(CASE WHEN p2 > 0 THEN {d(camera[f])} * p{i} / p2 + {d(camera[f + 2])} END) AS INT)"
    return f"""{name}_a AS (SELECT k, row, col, r, g, b, (col + 0.5::DOUBLE - {d(_RGB[2])}) / {d(_RGB[0])} AS x, (row + 0.5::DOUBLE - {d(_RGB[3])}) / {d(_RGB[1])} AS y FROM px WHERE side = {target}),
    {name}_b AS (SELECT a.*, o.depth AS z, o.valid AS ok FROM {name}_a a LEFT JOIN px o ON o.k = a.k AND o.side = {target} AND o.col = floor({d(_DEPTH[0])} * x + {d(_DEPTH[2])}) AND o.row = floor({d(_DEPTH[1])} * y + {d(_DEPTH[3])})),
    {name}_c AS (SELECT *, {at[0]} AS p0, {at[1]} AS p1, {at[2]} AS p2 FROM {name}_b),
    {name}_d AS (SELECT *, {seen(_DEPTH, 0, 0)} AS scol, {seen(_DEPTH, 1, 1)} AS srow, {seen(_RGB, 0, 0)} AS source_col, {seen(_RGB, 1, 1)} AS source_row FROM {name}_c),
    {name}_e AS (
      SELECT d.*, s.depth AS zs, coalesce(ok AND s.valid AND p2 > 0, false) AS candidate, (abs(e.r - d.r) + abs(e.g - d.g) + abs(e.b - d.b)) / CAST(3 AS DOUBLE) / 255 AS gap
      FROM {name}_d d LEFT JOIN px s ON s.k = d.k AND s.side = {source} AND s.row = srow AND s.col = scol LEFT JOIN px e ON e.k = d.k AND e.side = {source} AND e.row = source_row AND e.col = source_col),
    {name} AS (
      SELECT k, row, col, candidate, candidate AND coalesce(abs(p2 - zs) <= greatest(CAST(0.02 AS DOUBLE), CAST(0.1 AS DOUBLE) * zs), false) AS support, CASE WHEN candidate THEN abs(p2 - zs) / zs END AS depth_absrel,
             CASE WHEN candidate THEN gap END AS rgb_mae, source_row, source_col FROM {name}_e)"""


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = table(spark, sf_dir, "lineitem").groupBy((c("l_suppkey") % 20).alias("k"), (c("l_linenumber") % 2).alias("side"), (c("l_partkey") % 12).alias("row"), (c("l_orderkey") % 16).alias("col"))
    rgb = F.array(*[(F.sum(n) % 256).cast("double") for n in ("l_orderkey", "l_partkey", "l_suppkey")])
    return px.agg((2 + F.sum("l_quantity") / F.count("*") / 64).alias("depth"), (F.sum("l_linenumber") % 5 != 0).alias("valid"), rgb.alias("rgb"))


def _projected(px: DataFrame, target: int, source: int) -> DataFrame:
    def pinhole(k: tuple[float, ...], name: str) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("fx", "fy", "cx", "cy"), k, strict=True)]).alias(name)

    pose = lambda v, name: F.array(*[F.lit(x) for row in _POSES[v] for x in row]).alias(name)
    cameras = px.select("k").distinct().select("k", pinhole(_RGB, "target_rgb"), pinhole(_DEPTH, "target_depth"), pinhole(_RGB, "source_rgb"), pinhole(_DEPTH, "source_depth"), pose(target, "target_pose"), pose(source, "source_pose"))
    a, b = px.where(c("side") == target), px.where(c("side") == source)
    return projection.dense_projection(a, a, b, b, cameras, ["k"])


_SHOWN = "k, row, col, candidate, support, round(depth_absrel + 1e-9, 6) AS depth_absrel, round(rgb_mae + 1e-9, 6) AS rgb_mae, source_row, source_col"


@query("dense_projection", f"WITH {_PIXELS}, {_projected_sql('fw', 0, 1)}, {_projected_sql('bw', 1, 0)} SELECT 'forward' AS way, {_SHOWN} FROM fw UNION ALL SELECT 'reverse', {_SHOWN} FROM bw")
def dense_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views of every scene, each projected into the other."""
    px = _views(spark, sf_dir)
    both = _projected(px, 0, 1).withColumn("way", F.lit("forward")).unionByName(_projected(px, 1, 0).withColumn("way", F.lit("reverse")))
    return both.withColumns({n: steady(n, 6) for n in ("depth_absrel", "rgb_mae")})


def _anchor_sql(name: str, projected: str, target: int, source: int) -> str:
    return f"""{name} AS (
      SELECT t.k, t.anchor, count(*) AS mask_pixels, count(*) FILTER (WHERE s.k IS NOT NULL AND p.support) AS support_pixels, median(p.depth_absrel) FILTER (WHERE s.k IS NOT NULL AND p.candidate) AS depth_absrel,
             median(p.rgb_mae) FILTER (WHERE s.k IS NOT NULL AND p.support) AS rgb_mae
      FROM masks t LEFT JOIN {projected} p USING (k, row, col) LEFT JOIN masks s ON s.k = t.k AND s.side = {source} AND s.anchor = t.anchor AND s.row = p.source_row AND s.col = p.source_col WHERE t.side = {target} GROUP BY t.k, t.anchor)"""


def _parts(prefix: str, alias: str) -> str:
    show = lambda x: f"round({x} + 1e-9, 6)"
    return f"{alias}.mask_pixels AS {prefix}mask_pixels, {alias}.support_pixels AS {prefix}support_pixels, {show(f'{alias}.support_pixels / {alias}.mask_pixels')} AS {prefix}supported_fraction, {show(f'{alias}.depth_absrel')} AS {prefix}depth_absrel, {show(f'{alias}.rgb_mae')} AS {prefix}rgb_mae"


@query(
    "anchor_diagnostics",
    f"""WITH {_PIXELS}, {_projected_sql('fw', 0, 1)}, {_projected_sql('bw', 1, 0)}, masks AS (SELECT k, side, row, col, (row // 4 + col // 6) % 3 AS anchor FROM px),
    {_anchor_sql('f', 'fw', 0, 1)}, {_anchor_sql('b', 'bw', 1, 0)}
    SELECT f.k, f.anchor, {_parts('', 'f')}, {_parts('reverse_', 'b')}, coalesce(f.support_pixels / f.mask_pixels >= 0.1 AND f.depth_absrel <= 0.1 AND f.rgb_mae <= 0.5, false) AS passed FROM f LEFT JOIN b USING (k, anchor)""",
)
def anchor_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _views(spark, sf_dir)
    masks = px.select("k", "side", "row", "col", ((F.floor(c("row") / 4) + F.floor(c("col") / 6)) % 3).cast("int").alias("anchor"))
    mask = lambda v: masks.where(c("side") == v).drop("side")
    out = projection.anchor_diagnostics(_projected(px, 0, 1), _projected(px, 1, 0), mask(0), mask(1), ["k"], "anchor", most_rgb=0.5)
    return out.withColumns({n: steady(n, 6) for p in ("", "reverse_") for n in (f"{p}supported_fraction", f"{p}depth_absrel", f"{p}rgb_mae")})
