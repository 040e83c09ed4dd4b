"""Queries of images moved between cameras: each supplier's line items as the pixels of a small depth image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import warps
from meridia.plans.fixtures import steady, table
from meridia.plans.registry import query

KEY = ["l_suppkey"]
MATRIX = (0.3, 0.05, 2.0, -0.02, 0.35, 1.0, 0.001, 0.002, 1.0)
HEIGHT, WIDTH = 14, 18

_PIXELS = """pixels AS (SELECT l_suppkey, CAST(l_orderkey % 48 AS INT) AS "row", CAST(l_quantity AS INT) AS col, max(1 + l_tax * 100) AS depth, max(l_discount) AS discount FROM lineitem GROUP BY ALL)"""
_LANDED = f"""WITH {_PIXELS}, landed AS (
  SELECT l_suppkey, depth, discount, round_even(83 * (("row" + 0.5 - 24) / CAST(40 AS DOUBLE)) + 47 - 0.5, 0) AS r, round_even(85 * ((col + 0.5 - 26) / CAST(42 AS DOUBLE)) + 52 - 0.5, 0) AS c FROM pixels),
  found AS (SELECT l_suppkey, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, depth, discount FROM landed WHERE r >= 0 AND r < 90 AND c >= 0 AND c < 100)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    grid = [F.col("l_suppkey"), (F.col("l_orderkey") % 48).cast("int").alias("row"), F.col("l_quantity").cast("int").alias("col")]
    return items.groupBy(*grid).agg(F.max(1 + F.col("l_tax") * 100).alias("depth"), F.max("l_discount").alias("discount"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    camera = lambda *v: F.struct(*[F.lit(x).cast("double").alias(n) for x, n in zip(v, ("fx", "fy", "cx", "cy", "height", "width"), strict=True)], *[F.lit(None).cast("double").alias(n) for n in warps.LENS])
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), camera(42, 40, 26, 24, 48, 51).alias("source"), camera(85, 83, 52, 47, 90, 100).alias("target"))


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.array(*[F.lit(v) for v in MATRIX]).alias("homography"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"))


@query("depth_in_view", _LANDED + """ SELECT l_suppkey, "row", col, round(min(depth), 6) AS depth FROM found GROUP BY ALL""")
def depth_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's depths in a finer camera at the same place."""
    depths = pixels(spark, sf_dir).withColumn("valid", F.lit(True))
    return warps.depth_to_view(depths, cameras(spark, sf_dir), KEY).withColumn("depth", F.round("depth", 6))


@query(
    "mask_in_view",
    _LANDED + """ SELECT DISTINCT l_suppkey, CAST("row" + i AS INT) AS "row", CAST(col + j AS INT) AS col FROM found, range(-1, 2) a(i), range(-1, 2) b(j)
    WHERE discount >= 0.05 AND "row" + i BETWEEN 0 AND 89 AND col + j BETWEEN 0 AND 99""",
)
def mask_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of each supplier's larger discounts in that camera, widened by one."""
    return warps.mask_to_view(pixels(spark, sf_dir).where("discount >= 0.05"), cameras(spark, sf_dir), KEY)


def _inverse() -> list[float]:
    a, b, c, d, e, f, g, h, i = MATRIX
    parts = [e * i - f * h, -(b * i - c * h), b * f - c * e, -(d * i - f * g), a * i - c * g, -(a * f - c * d), d * h - e * g, -(a * h - b * g), a * e - b * d]
    det = a * parts[0] + b * parts[3] + c * parts[6]
    return [p / det for p in parts]


def _asked_sql() -> str:
    m = [f"CAST({v!r} AS DOUBLE)" for v in _inverse()]
    w = f"({m[6]} * c + {m[7]} * r + {m[8]})"
    return f"""WITH {_PIXELS}, asked AS (SELECT s_suppkey AS k, CAST(r AS INT) AS r, CAST(c AS INT) AS c, ({m[0]} * c + {m[1]} * r + {m[2]}) / {w} AS x, ({m[3]} * c + {m[4]} * r + {m[5]}) / {w} AS y
      FROM supplier, range({HEIGHT}) a(r), range({WIDTH}) b(c))"""


@query("warp_nearest", _asked_sql() + """ SELECT k AS l_suppkey, r AS "row", c AS col, round(depth, 6) AS depth FROM asked LEFT JOIN pixels p ON p.l_suppkey = k AND p."row" = round_even(y, 0) AND p.col = round_even(x, 0)""")
def warp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's image moved by a homography, by nearest pixels."""
    return warps.warped_nearest(pixels(spark, sf_dir), moved(spark, sf_dir), KEY, "depth").withColumn("depth", F.round("depth", 6))


@query(
    "warp_smooth",
    _asked_sql() + """, g AS (SELECT k, r, c, round_even(x * 32, 0) / 32 AS x, round_even(y * 32, 0) / 32 AS y FROM asked),
    tap AS (SELECT k, r, c, x, y, i, CASE WHEN abs(x - floor(x) - i) < 1e-9 THEN 1 ELSE sin(pi() * (x - floor(x) - i)) * sin(pi() * (x - floor(x) - i) / 4) / pow(x - floor(x) - i, 2) * 4 / pow(pi(), 2) END AS wx,
      CASE WHEN abs(y - floor(y) - i) < 1e-9 THEN 1 ELSE sin(pi() * (y - floor(y) - i)) * sin(pi() * (y - floor(y) - i) / 4) / pow(y - floor(y) - i, 2) * 4 / pow(pi(), 2) END AS wy FROM g, range(-3, 5) t(i)),
    side AS (SELECT k, r, c, floor(x) + i AS cx, floor(y) + i AS cy, wx / sum(wx) OVER p AS wx, wy / sum(wy) OVER p AS wy FROM tap WINDOW p AS (PARTITION BY k, r, c)),
    seen AS (SELECT a.k, a.r, a.c, sum(a.wx * b.wy * p.depth) AS s FROM side a JOIN side b USING (k, r, c) JOIN pixels p ON p.l_suppkey = a.k AND p.col = a.cx AND p."row" = b.cy GROUP BY ALL)
    SELECT k AS l_suppkey, asked.r AS "row", asked.c AS col, round(coalesce(s, 0) + 1e-8, 5) + 0.0 AS depth FROM asked LEFT JOIN seen USING (k, r, c)""",
)
def warp_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's image moved by that homography, by Lanczos weights."""
    return warps.warped_smooth(pixels(spark, sf_dir), moved(spark, sf_dir), KEY, "depth").withColumn("depth", steady("depth", 5) + 0.0)
