"""Queries of joins, points, voxels, descriptors and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.vectors import cosine, pooled
from meridia.operators import curation, ingest, matching, spatial, vectorsearch
from meridia.plans.fixtures import FRAMES, POINTS, descriptors, frames, points, table
from meridia.plans.registry import query


@query(
    "asof_linear_interp",
    f"""WITH {FRAMES}, q AS (SELECT DISTINCT case_id, floor(t) + 0.5 AS t FROM frames),
    b AS (SELECT q.case_id, q.t, (SELECT max(t) FROM frames f WHERE f.case_id = q.case_id AND f.t <= q.t) AS t0, (SELECT min(t) FROM frames f WHERE f.case_id = q.case_id AND f.t >= q.t) AS t1 FROM q)
    SELECT b.case_id, b.t, round(CASE WHEN t0 = b.t THEN x.x ELSE x.x + (b.t - t0) / (t1 - t0) * (y.x - x.x) END, 6) AS x
    FROM b LEFT JOIN frames x ON x.case_id = b.case_id AND x.t = t0 LEFT JOIN frames y ON y.case_id = b.case_id AND y.t = t1""",
)
def asof_linear_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    q = f.select("case_id", (F.floor("t") + 0.5).cast("double").alias("t")).distinct()
    return matching.asof_interpolate(q, f, ["case_id"], "t", ["x"]).select("case_id", "t", F.round("x", 6).alias("x"))


@query(
    "timestamp_to_frame",
    f"WITH {FRAMES} SELECT case_id, frame_index, CASE WHEN t >= -0.51::DOUBLE / 16 AND t <= 480 / 16.0::DOUBLE + 0.51::DOUBLE / 16 THEN CAST(greatest(0, least(round_even(t * 16, 0), 480)) AS BIGINT) END AS frame FROM frames",
)
def timestamp_to_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("case_id", "frame_index", matching.timestamp_to_frame(F.col("t"), 16.0, F.lit(481)).alias("frame"))


@query(
    "lag_pair_errors",
    f"""WITH {FRAMES} SELECT a.case_id, count(*) AS n, round(avg(abs(b.x - a.x)), 6) AS mean, round(sqrt(avg((b.x - a.x) * (b.x - a.x))), 6) AS rmse, round(quantile_cont(abs(b.x - a.x), 0.95), 6) AS p95
    FROM frames a JOIN frames b ON b.case_id = a.case_id AND b.frame_index = a.frame_index + 8 GROUP BY ALL""",
)
def lag_pair_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("x_next") - F.col("x")
    pairs = matching.lag_join(frames(spark, sf_dir), ["case_id"], "frame_index", 8, ["x"]).select("case_id", d.alias("d"), F.abs(d).alias("e"))
    return pairs.groupBy("case_id").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mean"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 6).alias("rmse"), F.round(F.expr("percentile(e, 0.95)"), 6).alias("p95"))


_REASONS = """b AS (SELECT DISTINCT l_orderkey FROM lineitem), r AS (
  SELECT l_orderkey, concat_ws(',', CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'missing_pose' END,
    CASE WHEN l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'missing_depth' END) AS reasons FROM b)"""


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    sides = {"pose": orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "depth": items.where("l_returnflag = 'R'").select("l_orderkey")}
    return matching.with_reasons(items.select("l_orderkey").distinct(), sides, ["l_orderkey"])


@query("coverage_reasons", f"WITH {_REASONS} SELECT l_orderkey, reasons FROM r")
def coverage_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir).select("l_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query("failure_histogram", f"WITH {_REASONS} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM r WHERE reasons <> '') GROUP BY reason")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "missing_and_extra",
    """WITH a AS (SELECT DISTINCT o_custkey + o_orderkey % 3 * 40 AS k FROM orders), e AS (SELECT c_custkey * 2 AS k FROM customer)
    SELECT k, 'missing' AS issue FROM e WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'extra' FROM a WHERE k NOT IN (SELECT k FROM e)""",
)
def missing_and_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even keys are expected; keys of the orders, some of them moved on, are there."""
    there = table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 3 * 40).alias("k"))
    return curation.missing_and_extra(table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("k")), there, ["k"])


@query(
    "manifest_upsert",
    "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
)
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return ingest.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("resume_remaining", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.remaining(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query(
    "zbuffer_frontmost",
    f"""WITH {POINTS}, p AS (SELECT floor(y) AS "row", floor(z) AS col, part, x, l_orderkey, l_linenumber FROM points),
    r AS (SELECT *, row_number() OVER (PARTITION BY part, "row", col ORDER BY x, l_orderkey, l_linenumber) AS rn FROM p)
    SELECT part, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, x, l_orderkey, l_linenumber FROM r WHERE rn = 1""",
)
def zbuffer_frontmost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumns({"row": F.floor("y"), "col": F.floor("z")})
    return spatial.frontmost(p, ["part", "row", "col"], "x", ["l_orderkey", "l_linenumber"], [])


_CELLS = POINTS + """, v AS (SELECT DISTINCT part, CAST(floor(x / 0.5 + 0.5 + 5e-5) AS BIGINT) AS x, CAST(floor(y / 0.5 + 0.5 + 5e-5) AS BIGINT) AS y, CAST(floor(z / 0.5 + 0.5 + 5e-5) AS BIGINT) AS z FROM points),
after AS (SELECT (part + 9) % 10 AS part, x, y, z FROM v)"""


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cells of every part, and those of the next part under this one's number."""
    v = spatial.voxels(points(spark, sf_dir), ["x", "y", "z"], 0.5, ("part",))
    return v, v.withColumn("part", (F.col("part") + 9) % 10)


@query("voxels_distinct", f"WITH {_CELLS} SELECT DISTINCT x, y, z FROM v")
def voxels_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.voxels(points(spark, sf_dir), ["x", "y", "z"], 0.5)


@query("voxel_intersection", f"WITH {_CELLS} SELECT * FROM v INTERSECT SELECT * FROM after")
def voxel_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _cells(spark, sf_dir)
    return a.intersect(b)


@query("voxel_difference", f"WITH {_CELLS} SELECT * FROM v EXCEPT SELECT * FROM after")
def voxel_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _cells(spark, sf_dir)
    return a.subtract(b)


@query(
    "voxel_beyond_radius",
    f"WITH {_CELLS}, wide AS (SELECT DISTINCT part, x + i AS x, y + j AS y, z + k AS z FROM after, range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k)) SELECT * FROM v EXCEPT SELECT * FROM wide",
)
def voxel_beyond_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _cells(spark, sf_dir)
    return matching.beyond_radius(a, b, ["x", "y", "z"], 1, ("part",))


@query(
    "first_in_cell",
    f"""WITH {POINTS}, r AS (SELECT CAST(floor(x / 5) AS BIGINT) AS cell_x, CAST(floor(y / 5) AS BIGINT) AS cell_y, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY floor(x / 5), floor(y / 5) ORDER BY l_orderkey, l_linenumber) AS rn FROM points)
    SELECT cell_x, cell_y, l_orderkey, l_linenumber FROM r WHERE rn = 1""",
)
def first_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.first_in_cell(points(spark, sf_dir), ["x", "y"], 5.0, ["l_orderkey", "l_linenumber"])


@query(
    "point_fscore",
    f"""WITH {POINTS}, a AS (SELECT DISTINCT part, x, y, z FROM points), b AS (SELECT DISTINCT (part + 9) % 10 AS part, x, y, z FROM points),
    h AS (SELECT a.part, a.x, a.y, a.z, b.x AS bx, b.y AS "by", b.z AS bz FROM a JOIN b ON a.part = b.part AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 1),
    n AS (SELECT part, (SELECT count(*) FROM a WHERE a.part = p.part) AS na, (SELECT count(*) FROM b WHERE b.part = p.part) AS nb, (SELECT count(*) FROM (SELECT DISTINCT x, y, z FROM h WHERE h.part = p.part)) AS ha, (SELECT count(*) FROM (SELECT DISTINCT bx, "by", bz FROM h WHERE h.part = p.part)) AS hb
      FROM (SELECT DISTINCT part FROM a) p)
    SELECT part, na, nb, ha, hb, round(2 * (ha / na) * (hb / nb) / (ha / na + hb / nb), 6) AS fscore FROM n""",
)
def point_fscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's distinct points against those of the next part."""
    a = points(spark, sf_dir).select("part", "x", "y", "z").distinct().withColumn("id", F.struct("x", "y", "z"))
    b = a.withColumn("part", (F.col("part") + 9) % 10)
    near = matching.within_radius(a, b, ["x", "y", "z"], 1.0, "id", "id", ("part",))
    hits = lambda c, name: near.select("part", c).distinct().groupBy("part").agg(F.count("*").alias(name))
    count = lambda df, name: df.groupBy("part").agg(F.count("*").alias(name))
    one = count(a, "na").join(count(b, "nb"), "part").join(hits("left_id", "ha"), "part").join(hits("right_id", "hb"), "part")
    return one.withColumn("fscore", F.round(spatial.f_score(F.col("ha"), F.col("na"), F.col("hb"), F.col("nb")), 6))


@query(
    "median_scale_absrel",
    f"""WITH {POINTS}, s AS (SELECT part, median((y + 1) / (z + 1)) AS scale FROM points GROUP BY part)
    SELECT part, count(*) AS n, round(any_value(scale), 6) AS scale, round(avg(abs((z + 1) * scale - (y + 1)) / (y + 1)), 6) AS abs_rel FROM points JOIN s USING (part) GROUP BY part""",
)
def median_scale_absrel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("part", (F.col("y") + 1).alias("ref"), (F.col("z") + 1).alias("est"))
    out = spatial.median_scale_error(p, ["part"], "ref", "est")
    return out.select("part", "n", F.round("scale", 6).alias("scale"), F.round("abs_rel", 6).alias("abs_rel"))


@query(
    "regional_scale_mad",
    f"""WITH {POINTS}, c AS (SELECT part, floor(x * 4 / 51) AS r, floor(y * 4 / 11) AS c, count(*) AS n, median((z + 1) / (y + 1)) AS m FROM points WHERE x >= 0 AND x < 51 AND y >= 0 AND y < 11 GROUP BY ALL HAVING count(*) >= 16),
    l AS (SELECT part, ln(greatest(m, 1e-8)) AS lg FROM c), mid AS (SELECT part, median(lg) AS md FROM l GROUP BY part)
    SELECT part, count(*) AS cells, CASE WHEN count(*) >= 2 THEN round(median(abs(lg - md)), 6) END AS inconsistency FROM l JOIN mid USING (part) GROUP BY part""",
)
def regional_scale_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("ratio", (F.col("z") + 1) / (F.col("y") + 1))
    out = spatial.regional_scale(p, ["part"], "x", "y", "ratio", 51.0, 11.0)
    return out.select("part", "cells", F.round("inconsistency", 6).alias("inconsistency"))


@query(
    "image_statistics",
    f"""WITH {POINTS}, g AS (SELECT part, count(*) AS n, avg((y - z) ** 2) AS mse, avg(abs(y - z)) AS l1, avg(y) AS ma, avg(z) AS mb, var_pop(y) AS va, var_pop(z) AS vb, covar_pop(y, z) AS vab FROM points GROUP BY part)
    SELECT part, n, round(CASE WHEN mse > 0 THEN 10 * log10(65025 / mse) ELSE 100 END, 6) AS psnr, round((2 * ma * mb + 6.5025::DOUBLE) * (2 * vab + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE)), 6) AS ssim, round(l1, 6) AS l1 FROM g""",
)
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.image_statistics(points(spark, sf_dir), ["part"], "y", "z")
    return out.select("part", "n", *[F.round(c, 6).alias(c) for c in ("psnr", "ssim", "l1")])


_PAIRS = """a AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), pairs AS (
  SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) AS c
  FROM a x JOIN a y ON x.label = y.label AND x.vec_id <> y.vec_id)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the descriptors of one label; labels are the joins' blocks."""
    d = descriptors(spark, sf_dir)
    other = d.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return d.withColumnRenamed("vec_id", "a").join(other, "label").where("a <> b").select("label", "a", "b", cosine(F.col("embedding"), F.col("other")).alias("c"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Descriptors of even and of odd ids."""
    d = descriptors(spark, sf_dir)
    return d.where("vec_id % 2 = 0"), d.where("vec_id % 2 = 1")


@query("cosine_topk", f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS rn FROM pairs) SELECT a, b, round(c, 6) AS c, CAST(rn AS INTEGER) AS \"rank\" FROM r WHERE rn <= 3")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = descriptors(spark, sf_dir)
    return vectorsearch.nearest_vectors(d, d, "label", "vec_id", "embedding", 3, 9, other=True).select("a", "b", F.round("c", 6).alias("c"), "rank")


@query(
    "mutual_ratio_match",
    f"""WITH {_PAIRS}, d AS (SELECT a, b, round(1 - c, 9) AS d FROM pairs WHERE a % 2 = 0 AND b % 2 = 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn, lead(d) OVER (PARTITION BY a ORDER BY d, b) AS nd FROM d), g AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rn, lead(d) OVER (PARTITION BY b ORDER BY d, a) AS nd FROM d)
    SELECT f.a, f.b, round(f.d, 6) AS d FROM f JOIN g ON f.a = g.a AND f.b = g.b WHERE f.rn = 1 AND g.rn = 1 AND f.d < 0.95::DOUBLE * f.nd AND g.d < 0.95::DOUBLE * g.nd""",
)
def mutual_ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of even ids against those of odd ids of their label: two sides that are the whole table together."""
    even, odd = _sides(spark, sf_dir)
    near = vectorsearch.nearest_vectors(even, odd, "label", "vec_id", "embedding", 2, 9).select("a", "b", "c")
    back = vectorsearch.nearest_vectors(odd, even, "label", "vec_id", "embedding", 2, 9).select(F.col("b").alias("a"), F.col("a").alias("b"), "c")
    d = near.unionByName(back).dropDuplicates(["a", "b"]).select("a", "b", F.round(1 - F.col("c"), 9).alias("d"))
    return matching.mutual_matches(d, "a", "b", "d", 0.95).select("a", "b", F.round("d", 6).alias("d"))


@query(
    "pooled_descriptor",
    """WITH e AS (SELECT label, vec_id % 5 + 1 AS w, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT label, i, sum(w * v) AS v FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM s GROUP BY label)
    SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(v / norm, 5) + 0.0 AS v FROM s JOIN n USING (label)""",
)
def pooled_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pooled(descriptors(spark, sf_dir).withColumn("w", F.col("vec_id") % 5 + 1), ["label"], "embedding", "w")
    return out.select("label", F.col("dim").cast("int").alias("dim"), (F.round("value", 5) + 0.0).alias("v"))


@query("greedy_match")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of even and odd descriptors within a label; no SQL, the tests compare with a loop."""
    return vectorsearch.greedy_vectors(*_sides(spark, sf_dir), "label", "vec_id", "embedding")


@query(
    "nearest_pose",
    f"""WITH {FRAMES}, c AS (SELECT l.case_id, l.frame_index, r.frame_index AS nearest, round(sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2) + 0.02::DOUBLE * abs(l.yaw - r.yaw), 9) AS cost FROM frames l JOIN frames r ON l.case_id = r.case_id AND l.frame_index <> r.frame_index),
    k AS (SELECT *, row_number() OVER (PARTITION BY case_id, frame_index ORDER BY cost, nearest) AS rn FROM c) SELECT case_id, frame_index, nearest, round(cost, 6) AS cost FROM k WHERE rn = 1""",
)
def nearest_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    out = matching.nearest_pose(f, f, ["case_id"], ["x", "y"], "yaw", "frame_index", 0.02)
    return out.select("case_id", "frame_index", "nearest", F.round("cost", 6).alias("cost"))


@query(
    "asof_pose_slerp",
    f"""WITH {FRAMES}, h AS (SELECT case_id, t, yaw * 0.49::DOUBLE AS a FROM frames), q AS (SELECT DISTINCT case_id, floor(t) + 0.5 AS t FROM frames),
    b AS (SELECT q.case_id, q.t, (SELECT max(t) FROM h WHERE h.case_id = q.case_id AND h.t <= q.t) AS t0, (SELECT min(t) FROM h WHERE h.case_id = q.case_id AND h.t > q.t) AS t1 FROM q)
    SELECT b.case_id, b.t, round(CASE WHEN t0 = b.t THEN x.a ELSE x.a + (b.t - t0) / (t1 - t0) * (y.a - x.a) END, 5) + 0.0 AS heading
    FROM b LEFT JOIN h x ON x.case_id = b.case_id AND x.t = t0 LEFT JOIN h y ON y.case_id = b.case_id AND y.t = t1""",
)
def asof_pose_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings as quaternions about one axis, under half a turn apart, at the middle of each unit of time."""
    half = F.radians(F.col("yaw") * 0.49) / 2
    f = frames(spark, sf_dir).withColumns({"qx": F.lit(0.0), "qy": F.sin(half), "qz": F.lit(0.0), "qw": F.cos(half)})
    q = f.select("case_id", (F.floor("t") + 0.5).cast("double").alias("t")).distinct()
    out = matching.asof_interpolate(q, f, ["case_id"], "t", ["x"], ["qx", "qy", "qz", "qw"])
    return out.select("case_id", "t", (F.round(F.degrees(2 * F.atan2("qy", "qw")), 5) + 0.0).alias("heading"))
