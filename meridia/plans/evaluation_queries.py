"""Queries of correspondences, revisits, anchors, curves and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import evaluation
from meridia.operators.matching import lag_join
from meridia.plans.fixtures import FRAMES, POINTS, frames, points, table
from meridia.plans.registry import query
from meridia.plans.window_queries import _MEANS, _means

_COVISIBLE = POINTS + """, proj AS (SELECT part, CAST(round_even(y, 0) AS BIGINT) AS v, CAST(round_even(z, 0) AS BIGINT) AS u, x AS z, l_orderkey * 10 + l_linenumber AS ordinal FROM points WHERE l_orderkey % 2 = 0),
front AS (SELECT part, v, u, min(z) AS projected FROM proj WHERE z > 1e-8 GROUP BY ALL),
obs AS (SELECT part, CAST(round_even(y, 0) AS BIGINT) AS v, CAST(round_even(z, 0) AS BIGINT) AS u, min(x) AS depth FROM points WHERE l_orderkey % 2 = 1 GROUP BY ALL),
cov AS (SELECT part, v, u, projected, depth AS observed FROM front JOIN obs USING (part, v, u) WHERE depth > 0 AND projected <= depth * 1.05::DOUBLE)"""


def _covisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    at = {"v": F.rint("y").cast("long"), "u": F.rint("z").cast("long")}
    projected = p.where("l_orderkey % 2 = 0").select("part", at["v"].alias("v"), at["u"].alias("u"), F.col("x").alias("z"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    observed = p.where("l_orderkey % 2 = 1").groupBy("part", at["v"].alias("v"), at["u"].alias("u")).agg(F.min("x").alias("depth"))
    return evaluation.covisible(projected, observed, ["part"])


@query("covisible_reprojection", f"WITH {_COVISIBLE} SELECT * FROM cov")
def covisible_reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covisible(spark, sf_dir)


@query(
    "pair_depth_errors",
    f"""WITH {_COVISIBLE}, r AS (SELECT part, abs(projected - observed) / greatest(observed, 1e-8) AS r, observed / greatest(projected, 1e-8) AS q FROM cov)
    SELECT part, count(*) AS n, round(avg(r), 6) AS abs_rel, round(median(r), 6) AS abs_rel_median, round(quantile_cont(r, 0.95), 6) AS abs_rel_p95, round(median(abs(ln(greatest(q, 1e-8)))), 6) AS abs_log, round(median(q), 6) AS scale_ratio FROM r GROUP BY part""",
)
def pair_depth_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.pair_depth_errors(_covisible(spark, sf_dir), ["part"])
    return out.select("part", "n", *[F.round(c, 6).alias(c) for c in ("abs_rel", "abs_rel_median", "abs_rel_p95", "abs_log", "scale_ratio")])


@query(
    "curve_summary",
    f"""WITH {_MEANS} SELECT model, metric, dur, CASE WHEN count(mean) = count(*) THEN 'ok' ELSE 'not_covered' END AS status, count(*) AS expected, count(mean) AS evaluated, round(max(mean) FILTER (WHERE "window" = 0), 6) AS "first",
      round(last(mean ORDER BY "window"), 6) AS "last", round(max(mean) FILTER (WHERE "window" = 0) - last(mean ORDER BY "window"), 6) + 0.0 AS fall, round(min(mean), 6) AS worst FROM means GROUP BY ALL""",
)
def curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.curve_summary(_means(spark, sf_dir), ["model", "metric", "dur"])
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("model", "metric", "dur", "status", "expected", "evaluated", r("first"), r("last"), (F.round("fall", 6) + 0.0).alias("fall"), r("worst"))


@query(
    "pose_class_groups",
    f"""WITH {FRAMES}, p AS (SELECT a.case_id, sqrt((b.x - a.x) ** 2 + (b.z - a.z) ** 2) * (a.frame_index % 3) AS tr, abs(b.yaw - a.yaw) * (a.frame_index % 3) AS rot, a.y AS v FROM frames a JOIN frames b ON b.case_id = a.case_id AND b.frame_index = a.frame_index + 4)
    SELECT case_id, CASE WHEN tr <= 1e-6 AND rot <= 1e-4 THEN 'same_pose' ELSE 'different_pose' END AS pose_class, count(*) AS n, round(avg(v), 6) AS mean FROM p GROUP BY ALL""",
)
def pose_class_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lag_join(frames(spark, sf_dir), ["case_id"], "frame_index", 4, ["x", "y", "z", "yaw"])
    dx, dz, third = F.col("x_next") - F.col("x"), F.col("z_next") - F.col("z"), F.col("frame_index") % 3
    kind = evaluation.pose_class(F.sqrt(dx * dx + dz * dz) * third, F.abs(F.col("yaw_next") - F.col("yaw")) * third)
    return pairs.groupBy("case_id", kind.alias("pose_class")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"))


@query(
    "anchor_identity_macro",
    """WITH s AS (SELECT l_suppkey, l_partkey % 7 AS anchor, CASE WHEN l_orderkey % 5 = 0 OR (l_suppkey % 3 = 0 AND l_partkey % 7 = 2) THEN NULL ELSE l_discount * 10 END AS v FROM lineitem), a AS (SELECT l_suppkey, anchor, avg(v) AS m, count(v) AS n, count(*) AS e FROM s GROUP BY ALL)
    SELECT l_suppkey, count(*) AS anchors, round(CASE WHEN count(m) = count(*) THEN avg(m) END, 6) AS complete, round(avg(m), 6) AS conditional, round(min(m), 6) AS least, round(sum(n) / sum(e), 6) AS coverage FROM a GROUP BY ALL""",
)
def anchor_identity_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    missing = (c("l_orderkey") % 5 == 0) | ((c("l_suppkey") % 3 == 0) & (c("l_partkey") % 7 == 2))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (c("l_partkey") % 7).alias("anchor"), F.when(~missing, c("l_discount") * 10).alias("v"), F.lit(1).cast("long").alias("e"))
    out = evaluation.anchor_macro(rows, ["l_suppkey"], "anchor", "v", "e")
    return out.select("l_suppkey", "anchors", *[F.round(x, 6).alias(x) for x in ("complete", "conditional", "least", "coverage")])


@query(
    "anchor_recovery",
    """SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > 10) AS expected, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 10) AS recovered, round(count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 10) / count(*) FILTER (WHERE l_quantity > 10), 6) AS rate,
      round(avg(CASE WHEN l_tax > 0.01 THEN l_tax END), 6) AS displacement, CASE WHEN count(*) FILTER (WHERE l_quantity > 10) > 0 AND sum(CASE WHEN l_quantity = 13 AND l_suppkey % 4 = 1 THEN 1 ELSE 0 END) = 0 THEN 'ok' ELSE 'not_covered' END AS status FROM lineitem GROUP BY l_suppkey""",
)
def anchor_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.greatest(c("l_quantity") - 10, F.lit(0.0)).alias("expected_points"), ((c("l_returnflag") == "R") & (c("l_quantity") > 10)).alias("recovered"),
        F.when(c("l_tax") > 0.01, c("l_tax")).alias("displacement"), F.when((c("l_quantity") == 13) & (c("l_suppkey") % 4 == 1), 1).otherwise(0).alias("unknown_points"),
    )
    out = evaluation.recovery(rows, ["l_suppkey"])
    return out.select("l_suppkey", "expected", "recovered", F.round("rate", 6).alias("rate"), F.round("displacement", 6).alias("displacement"), "status")


@query(
    "revisit_verdict",
    """WITH p AS (SELECT l_orderkey, l_tax <= 0.06 AS passed, CASE WHEN l_returnflag = 'R' THEN 'weak' WHEN l_returnflag = 'A' THEN 'moderate' ELSE 'strong' END AS grade, CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 3 ELSE 4 END AS o, l_discount AS fraction, l_tax, l_quantity FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, fraction) AS rn FROM p)
    SELECT l_orderkey, bool_and(passed) AS passed, max(grade) FILTER (WHERE rn = 1) AS grade, max(fraction) FILTER (WHERE rn = 1) + 0.0 AS fraction, max(l_tax) AS translation, max(l_quantity) AS rotation FROM r GROUP BY ALL""",
)
def revisit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    grade = F.when(c("l_returnflag") == "R", "weak").when(c("l_returnflag") == "A", "moderate").otherwise("strong")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (c("l_tax") <= 0.06).alias("passed"), grade.alias("grade"), (c("l_discount") + 0.0).alias("fraction"), c("l_tax").alias("translation"), c("l_quantity").alias("rotation"))
    return evaluation.revisit_verdict(rows, ["l_orderkey"])


@query(
    "best_anchor",
    "WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rn FROM lineitem WHERE l_returnflag <> 'R') SELECT l_orderkey, l_linenumber, l_quantity FROM r WHERE rn = 1",
)
def best_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", F.col("l_returnflag") != "R", "l_linenumber")


@query("lower_median", "SELECT l_suppkey, quantile_disc(l_extendedprice, 0.5) AS median FROM lineitem GROUP BY l_suppkey")
def lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.lower_median(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice")


@query(
    "intervals_coalesced",
    f"""WITH {FRAMES}, i AS (SELECT case_id, frame_index AS a, CASE WHEN frame_index % 4 = 0 THEN frame_index + 1 ELSE coalesce(lead(frame_index) OVER (PARTITION BY case_id ORDER BY frame_index), frame_index + 1) END AS b, CASE WHEN yaw > 0 THEN 'W' ELSE 'S' END AS k FROM frames),
    n AS (SELECT *, CASE WHEN k = lag(k) OVER w AND a = lag(b) OVER w THEN 0 ELSE 1 END AS fresh FROM i WINDOW w AS (PARTITION BY case_id ORDER BY a, b)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY a, b) AS run FROM n)
    SELECT case_id, any_value(k) AS k, min(a) AS a, max(b) AS b FROM r GROUP BY case_id, run""",
)
def intervals_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.col("frame_index")
    after = F.coalesce(F.lead("frame_index").over(Window.partitionBy("case_id").orderBy("frame_index")), i + 1)
    rows = frames(spark, sf_dir).select("case_id", i.alias("a"), F.when(i % 4 == 0, i + 1).otherwise(after).alias("b"), F.when(F.col("yaw") > 0, "W").otherwise("S").alias("k"))
    return evaluation.coalesced(rows, ["case_id"], "a", "b", "k")


_LABELS = """(SELECT case_id, frame_index, mv AND dz / greatest(sp, 1e-12) > 0.5 AS f, mv AND dx / greatest(sp, 1e-12) < -0.5 AS l, mv AND dz / greatest(sp, 1e-12) < -0.5 AS b, mv AND dx / greatest(sp, 1e-12) > 0.5 AS r FROM (
  SELECT *, sp > 0.01::DOUBLE * avg(sp) OVER (PARTITION BY case_id) AS mv FROM (SELECT *, sqrt(dx * dx + dz * dz) AS sp FROM (
    SELECT case_id, frame_index, lead({x}) OVER w - {x} AS dx, lead({z}) OVER w - {z} AS dz, lead(frame_index) OVER w - frame_index AS gap FROM frames WINDOW w AS (PARTITION BY case_id ORDER BY frame_index)) WHERE gap IS NOT NULL)) WHERE gap = 2)"""


@query(
    "action_accuracy",
    f"""WITH {FRAMES}, p AS {_LABELS.format(x='x', z='y')}, q AS {_LABELS.format(x='x', z='z')}
    SELECT q.case_id, count(*) AS steps, round(100 * avg(CASE WHEN p.f = q.f AND p.l = q.l AND p.b = q.b AND p.r = q.r THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM q JOIN p USING (case_id, frame_index) WHERE q.f OR q.l OR q.b OR q.r GROUP BY ALL""",
)
def action_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    labels = lambda z: evaluation.action_labels(f.select("case_id", "frame_index", "x", F.col(z).alias("z")), ["case_id"], "frame_index", 2)
    out = evaluation.action_accuracy(labels("y"), labels("z"), ["case_id"], "frame_index")
    return out.select("case_id", "steps", F.round("accuracy", 6).alias("accuracy"))


@query(
    "arc_length_samples",
    f"""WITH {FRAMES}, s AS (SELECT case_id, frame_index, x, z, lead(x) OVER w AS x1, lead(z) OVER w AS z1, sqrt((lead(x) OVER w - x) ** 2 + (lead(z) OVER w - z) ** 2) AS len FROM frames WINDOW w AS (PARTITION BY case_id ORDER BY frame_index)),
    c AS (SELECT *, sum(len) OVER (PARTITION BY case_id ORDER BY frame_index) AS stop FROM s WHERE len IS NOT NULL), t AS (SELECT *, max(stop) OVER (PARTITION BY case_id) AS total FROM c),
    q AS (SELECT case_id, i AS sample, i * max(total) / 15 AS d FROM t, range(16) r(i) GROUP BY case_id, i),
    m AS (SELECT q.case_id, q.sample, q.d, arg_min(t, t.frame_index) AS seg FROM q JOIN t ON t.case_id = q.case_id AND t.len > 0 AND t.stop >= q.d - 1e-7 GROUP BY ALL)
    SELECT case_id, sample, round(d, 4) AS distance, round(seg.x + greatest(0, least(1, (d - (seg.stop - seg.len)) / seg.len)) * (seg.x1 - seg.x), 4) AS x FROM m""",
)
def arc_length_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.arc_length_samples(frames(spark, sf_dir), ["case_id"], "frame_index", ["x", "z"], 16)
    return out.select("case_id", F.col("sample").cast("long").alias("sample"), F.round("distance", 4).alias("distance"), F.round("x", 4).alias("x"))


@query("shortlist")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a supplier's parts, five at most; the greedy choice has no SQL, the tests compare with a loop."""
    c = F.col
    boxes = table(spark, sf_dir, "lineitem").select("l_suppkey", (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_quantity").alias("x0"), (c("l_discount") * 300).alias("y0"), (c("l_quantity") * 1.5 + 5).alias("x1"), (c("l_discount") * 300 + 6 + c("l_tax") * 100).alias("y1"))
    return evaluation.shortlist(boxes, "l_suppkey", 0.7, 5)


@query(
    "centre_crop",
    """WITH s AS (SELECT p_partkey, CAST(600 + p_size * 37 AS INTEGER) AS w, CAST(400 + (p_partkey % 50) * 31 AS INTEGER) AS h FROM part), k AS (SELECT *, w / h >= 1280 / 720 AS wide FROM s),
    c AS (SELECT *, CASE WHEN wide THEN least(w, CAST(round_even(h * (CAST(1280 AS DOUBLE) / 720), 0) AS INTEGER)) ELSE w END AS cw, CASE WHEN wide THEN h ELSE least(h, CAST(round_even(w / (CAST(1280 AS DOUBLE) / 720), 0) AS INTEGER)) END AS ch FROM k)
    SELECT p_partkey, CAST(CASE WHEN wide THEN (w - cw) // 2 ELSE 0 END AS INTEGER) AS "left", CAST(CASE WHEN wide THEN 0 ELSE (h - ch) // 2 END AS INTEGER) AS top, cw AS width, ch AS height, round(1280 / cw, 6) AS scale_x, round(720 / ch, 6) AS scale_y FROM c""",
)
def centre_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "part").select("p_partkey", (600 + F.col("p_size") * 37).cast("int").alias("w"), (400 + (F.col("p_partkey") % 50) * 31).cast("int").alias("h"))
    out = sized.select("p_partkey", evaluation.centre_crop(F.col("w"), F.col("h")).alias("c")).select("p_partkey", "c.*")
    return out.withColumns({"scale_x": F.round("scale_x", 6), "scale_y": F.round("scale_y", 6)})


@query(
    "trimmed_chamfer",
    f"""WITH {POINTS}, a AS (SELECT DISTINCT part, x, y, z FROM points WHERE l_linenumber <= 2), b AS (SELECT DISTINCT part, x, y, z FROM points WHERE l_linenumber > 2),
    d AS (SELECT a.part, a.x, a.y, a.z, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d2 FROM a JOIN b USING (part) GROUP BY ALL), t AS (SELECT part, quantile_cont(sqrt(d2), 0.95) AS top FROM d GROUP BY part)
    SELECT part, count(*) AS n, round(avg(least(sqrt(d2), top)), 6) AS mean FROM d JOIN t USING (part) GROUP BY part""",
)
def trimmed_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two lines of all orders against all other lines; the sides are the whole table together."""
    p = points(spark, sf_dir)
    side = lambda where: p.where(where).select("part", "x", "y", "z").distinct()
    near = evaluation.nearest_distances(side("l_linenumber <= 2").withColumn("id", F.struct("x", "y", "z")), side("l_linenumber > 2"), ("part",), ["x", "y", "z"], "id", 1.0)
    out = evaluation.trimmed_mean(near, ["part"], "distance")
    return out.select("part", "n", F.round("mean", 6).alias("mean"))
