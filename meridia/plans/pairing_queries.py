"""Queries of frame pairs, mirrored views, overlaps and set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import pairing
from meridia.plans.fixtures import FRAMES, frames, table
from meridia.plans.registry import query


@query(
    "gated_frame_pairs",
    f"WITH {FRAMES} SELECT a.case_id, a.frame_index AS i, b.frame_index AS j, round(sqrt((b.x - a.x) ** 2 + (b.z - a.z) ** 2), 6) AS distance FROM frames a JOIN frames b ON a.case_id = b.case_id AND b.frame_index - a.frame_index BETWEEN 5 AND 40 WHERE sqrt((b.x - a.x) ** 2 + (b.z - a.z) ** 2) >= 20",
)
def gated_frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairing.gap_pairs(frames(spark, sf_dir), ["case_id"], "frame_index", 5, 40, ["x", "z"])
    dx, dz = F.col("x_next") - F.col("x"), F.col("z_next") - F.col("z")
    d = F.sqrt(dx * dx + dz * dz)
    return p.where(d >= 20).select("case_id", "i", "j", F.round(d, 6).alias("distance"))


@query(
    "mirrored_pairs",
    'WITH t AS (SELECT p_partkey, p_size + 3 AS w, 2 * p_size + 9 AS e FROM part) SELECT DISTINCT p_partkey, CAST(w - k AS INTEGER) AS "first", CAST(w + round_even(k / w * (e - w), 0) AS INTEGER) AS revisit FROM t, range(1, 60) r(k) WHERE k < w AND w + round_even(k / w * (e - w), 0) > w AND w + round_even(k / w * (e - w), 0) < e',
)
def mirrored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 3).alias("w"), (2 * F.col("p_size") + 9).alias("e"))
    return rows.select("p_partkey", F.inline(pairing.mirrored(F.col("w"), F.col("e"))))


@query(
    "view_overlap",
    "WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 2 = 1) SELECT l.l_suppkey, count(*) AS n, count(r.l_partkey) AS shared, round(count(r.l_partkey) / count(*), 6) AS share FROM lineitem l LEFT JOIN r ON r.l_suppkey = l.l_suppkey AND r.l_partkey = l.l_partkey WHERE l.l_orderkey % 2 = 0 GROUP BY l.l_suppkey",
)
def view_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    out = pairing.overlap_share(items.where("l_orderkey % 2 = 0"), items.where("l_orderkey % 2 = 1"), ["l_suppkey"], "l_partkey")
    return out.select("l_suppkey", "n", "shared", F.round("share", 6).alias("share"))


@query("either_join", "SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON (c_nationkey = s_nationkey AND c_custkey % 50 = s_suppkey % 50) OR c_custkey = s_suppkey")
def either_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("place", F.struct("c_nationkey", (F.col("c_custkey") % 50).alias("m")))
    s = table(spark, sf_dir, "supplier").withColumn("at", F.struct(F.col("s_nationkey").alias("c_nationkey"), (F.col("s_suppkey") % 50).alias("m")))
    return pairing.either_join(c, s, "c_custkey", "s_suppkey", [("place", "at"), ("c_custkey", "s_suppkey")])


@query(
    "set_equality",
    """WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 3 <> 0), a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber < 4)
    SELECT l_suppkey, count(e.l_partkey) AS expected, count(a.l_partkey) AS actual, count(*) FILTER (WHERE e.l_partkey IS NOT NULL AND a.l_partkey IS NOT NULL) AS shared,
      count(e.l_partkey) = count(*) FILTER (WHERE e.l_partkey IS NOT NULL AND a.l_partkey IS NOT NULL) AND count(a.l_partkey) = count(*) FILTER (WHERE e.l_partkey IS NOT NULL AND a.l_partkey IS NOT NULL) AS complete
    FROM (SELECT l_suppkey, l_partkey FROM e UNION SELECT l_suppkey, l_partkey FROM a) k LEFT JOIN e USING (l_suppkey, l_partkey) LEFT JOIN a USING (l_suppkey, l_partkey) GROUP BY l_suppkey""",
)
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return pairing.set_equality(items.where("l_orderkey % 3 <> 0"), items.where("l_linenumber < 4"), ["l_suppkey"], "l_partkey")


@query("triplet_starts", "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, CAST(i AS INTEGER) AS start FROM n, range(0, 200, 2) r(i) WHERE i <= n - 3")
def triplet_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", F.explode(pairing.triplets(F.col("n"), 2)).alias("start"))


@query(
    "tracking_windows",
    "WITH n AS (SELECT o_custkey, min(o_orderkey % 50) AS a, max(o_orderkey % 90) AS b FROM orders GROUP BY ALL) SELECT DISTINCT o_custkey, i AS frame FROM n, range(0, 100) r(i) WHERE b >= a AND i BETWEEN a AND b AND ((i - a) % 8 = 0 OR i = b)",
)
def tracking_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderkey") % 50).alias("a"), F.max(F.col("o_orderkey") % 90).alias("b"))
    return n.select("o_custkey", F.explode(pairing.strided_with_ends(F.col("a"), F.col("b"), 8)).alias("frame"))


@query("first_passing_attempt", "SELECT l_orderkey, count(*) AS tried, min(l_linenumber) FILTER (WHERE l_quantity > 30) AS chosen FROM lineitem GROUP BY ALL")
def first_passing_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.attempts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_quantity") > 30)


@query(
    "spaced_alternatives",
    f"""WITH RECURSIVE {FRAMES}, s AS (SELECT case_id, max(frame_index) AS frame_index, 1 AS place FROM frames GROUP BY case_id
      UNION ALL SELECT s.case_id, max(f.frame_index), s.place + 1 FROM s JOIN frames f ON f.case_id = s.case_id AND f.frame_index <= s.frame_index - 12 WHERE s.place < 5 GROUP BY s.case_id, s.place)
    SELECT case_id, frame_index, place FROM s""",
)
def spaced_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.spaced(frames(spark, sf_dir), ["case_id"], "frame_index", 12)


@query(
    "latest_passing",
    f"""WITH {FRAMES}, n AS (SELECT case_id, frame_index, frame_index * 7 % 11 < 5 AS ok, row_number() OVER (PARTITION BY case_id ORDER BY frame_index DESC) - 1 AS n FROM frames),
    b AS (SELECT case_id, min(n) AS best FROM n WHERE ok AND n % 4 = 0 GROUP BY case_id)
    SELECT case_id, max(frame_index) AS frame_index FROM n JOIN b USING (case_id) WHERE ok AND (n = best OR (n > best - 4 AND n < best)) GROUP BY case_id""",
)
def latest_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.latest_passing(frames(spark, sf_dir), ["case_id"], "frame_index", lambda df: df.where("frame_index * 7 % 11 < 5"))


@query(
    "heading_between",
    f"WITH {FRAMES}, g AS (SELECT case_id, frame_index, yaw, (((y - yaw + 180) % 360) + 360) % 360 - 180 AS gap FROM frames) SELECT case_id, frame_index, round((((yaw + 0.25::DOUBLE * gap + 180) % 360) + 360) % 360 - 180, 5) + 0.0 AS heading FROM g",
)
def heading_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("case_id", "frame_index", (F.round(pairing.slerp_yaw(F.col("yaw"), F.col("y"), F.lit(0.25)), 5) + 0.0).alias("heading"))


@query("display_values", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount * 8 - 0.05::DOUBLE <= 0.0031308::DOUBLE THEN greatest(0, l_discount * 8 - 0.05::DOUBLE) * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(least(1, l_discount * 8 - 0.05::DOUBLE), 1 / 2.4::DOUBLE) - 0.055::DOUBLE END, 6) AS v FROM lineitem")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(pairing.srgb(F.col("l_discount") * 8 - 0.05), 6).alias("v"))
