"""Queries of diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.operators import diagnostics, ingest
from meridia.plans.fixtures import FRAMES, MISSING, POINTS, frames, measurement_missing, points, steady, table
from meridia.plans.registry import query

c = F.col
_R = "round({} + 1e-9, 6)"


@query("mean_by_target", f"SELECT l_suppkey, l_partkey % 50 AS target, {_R.format('avg(l_discount)')} AS value FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL")
def mean_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (c("l_partkey") % 50).alias("target"), F.when(c("l_returnflag") != "R", c("l_discount")).otherwise(float("nan")).alias("value"))
    return diagnostics.target_means(rows, ["l_suppkey"], "target", "value").select("l_suppkey", "target", steady("value", 6).alias("value"))


@query(
    "status_windows",
    f"""WITH {MISSING}, b AS (SELECT i AS w, CASE WHEN i = 4 THEN 17.25::DOUBLE ELSE i * 5.0::DOUBLE END AS a, CASE WHEN i = 4 THEN 22.25::DOUBLE ELSE i * 5.0::DOUBLE + 5 END AS b FROM range(5) r(i)),
    k AS (SELECT DISTINCT model, metric, case_id FROM measurement_missing), j AS (SELECT k.*, w, a, b.b, count(value) AS n, avg(value) AS mean FROM k CROSS JOIN b LEFT JOIN measurement_missing m ON m.model = k.model AND m.metric = k.metric AND m.case_id = k.case_id AND m.t >= a AND (CASE WHEN w = 4 THEN m.t <= b.b ELSE m.t < b.b END) GROUP BY ALL)
    SELECT model, metric, case_id, CAST(w AS INTEGER) AS "window", a AS start, b AS stop, n, CASE WHEN n > 0 THEN 'ok' ELSE 'not_covered' END AS status, {_R.format('mean')} AS mean FROM j""",
)
def status_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.status_windows(measurement_missing(spark, sf_dir), ["model", "metric", "case_id"], "t", "value", 22.25)
    return out.withColumn("mean", steady("mean", 6))


@query(
    "trace_reuse",
    f"""WITH r AS (SELECT l_suppkey AS case_id, l_partkey % 20 AS s, l_linenumber AS g, l_discount AS v, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 20, l_linenumber ORDER BY l_orderkey DESC, l_tax DESC, l_discount DESC) AS rn FROM lineitem)
    SELECT case_id, g AS target, {_R.format('avg(v)')} AS value, count(*) AS pairs FROM r WHERE rn = 1 GROUP BY ALL""",
)
def trace_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair records nested in one JSON trace a supplier: found by their shape, the last of a pair kept, then averaged by target frame."""
    record = F.struct("l_orderkey", "l_tax", "l_discount", F.struct((c("l_partkey") % 20).alias("source_frame_index"), c("l_linenumber").alias("target_frame_index"), c("l_discount").alias("abs_rel")).alias("r"))
    traces = table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("case_id")).agg(F.sort_array(F.collect_list(record)).alias("all"))
    nested = F.to_json(F.struct(F.struct(F.transform("all", lambda x: x["r"]).alias("pairs"), F.lit(1).alias("n")).alias("medium"), F.lit("ok").alias("status")))
    fields = ("source_frame_index", "target_frame_index")
    found = diagnostics.json_records(traces.select("case_id", nested.alias("trace")), ["case_id"], "trace", fields).withColumnRenamed("path", "at")
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind).alias(name)
    pairs = found.select("case_id", "at", *[get(f, "bigint") for f in fields], get("abs_rel", "double"))
    last = ingest.latest(pairs, ["case_id", *fields], ["at"])
    # Means and counts of a target come out of one aggregate: the pairs are found once.
    means = last.groupBy("case_id", "target_frame_index").agg(diagnostics.finite_mean("abs_rel").alias("value"), F.count("*").alias("pairs")).where("value IS NOT NULL")
    return means.select("case_id", c("target_frame_index").cast("int").alias("target"), steady("value", 6).alias("value"), "pairs")


@query(
    "revisit_means",
    f"""SELECT l_suppkey, count(*) AS expected, CASE WHEN count(q) = count(*) THEN {_R.format('avg(q)')} END AS q, {_R.format('avg(q)')} AS q_conditional, count(q) AS q_count, {_R.format('avg(p)')} AS p, {_R.format('avg(p)')} AS p_conditional, count(p) AS p_count
    FROM (SELECT l_suppkey, CASE WHEN l_quantity > 1 THEN l_quantity END AS q, l_discount AS p FROM lineitem) GROUP BY l_suppkey""",
)
def revisit_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(c("l_quantity") > 1, c("l_quantity")).alias("q"), c("l_discount").alias("p"))
    out = diagnostics.revisit_means(rows, ["l_suppkey"], ["q", "p"])
    return out.withColumns({n: steady(n, 6) for n in ("q", "q_conditional", "p", "p_conditional")})


_PIXELS = """px AS (SELECT l_suppkey AS k, l_linenumber AS anchor, CASE WHEN l_quantity > 45 THEN 0 ELSE l_quantity END AS ref, CASE WHEN l_linenumber = 6 AND l_suppkey % 3 = 0 THEN NULL ELSE l_discount * 100 + 1 END AS est, l_returnflag <> 'R' AS seen, l_partkey % 9 AS u, l_orderkey % 7 AS v FROM lineitem)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    est = F.when((c("l_linenumber") == 6) & (c("l_suppkey") % 3 == 0), F.lit(None)).otherwise(c("l_discount") * 100 + 1)
    ref = F.when(c("l_quantity") > 45, F.lit(0.0)).otherwise(c("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("k"), c("l_linenumber").alias("anchor"), ref.alias("ref"), est.alias("est"), (c("l_returnflag") != "R").alias("seen"), (c("l_partkey") % 9).alias("u"), (c("l_orderkey") % 7).alias("v"))


@query(
    "anchor_depth_errors",
    f"""WITH {_PIXELS}, s AS (SELECT k, median(ref / est) AS scale FROM px WHERE ref > 0 AND seen AND est > 0 GROUP BY k),
    a AS (SELECT px.k, anchor, count(*) FILTER (WHERE ref > 0) AS expected, avg(abs(scale * est - ref) / ref) FILTER (WHERE ref > 0 AND seen AND est > 0 AND scale IS NOT NULL) AS e FROM px LEFT JOIN s USING (k) GROUP BY ALL)
    SELECT k, count(*) FILTER (WHERE expected > 0) AS expected_anchors, count(e) AS evaluated_anchors, CASE WHEN count(e) = count(*) FILTER (WHERE expected > 0) THEN {_R.format('avg(e)')} END AS macro, {_R.format('avg(e)')} AS conditional_macro,
      CASE WHEN count(e) = count(*) FILTER (WHERE expected > 0) AND count(*) FILTER (WHERE expected > 0) > 0 THEN 'ok' ELSE 'not_covered' END AS status FROM a GROUP BY k""",
)
def anchor_depth_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir)
    scales = diagnostics.sampled_errors(px, ["k"], "ref", "est", c("seen"), ["u", "v"])
    out = diagnostics.anchor_macro(diagnostics.anchor_errors(px, scales, ["k"], "anchor", "ref", "est", c("seen")), ["k"])
    return out.withColumns({n: steady(n, 6) for n in ("macro", "conditional_macro")})


@query(
    "point_sampled_errors",
    f"""WITH {_PIXELS}, s AS (SELECT k, median(ref / est) AS scale, count(DISTINCT (u, v)) AS pixels FROM px WHERE ref > 0 AND seen AND est > 0 GROUP BY k)
    SELECT px.k, count(*) FILTER (WHERE ref > 0) AS sources, count(*) FILTER (WHERE ref > 0 AND seen) AS in_output, count(*) FILTER (WHERE ref > 0 AND seen AND est > 0) AS evaluated, coalesce(max(pixels), 0) AS pixels, {_R.format('max(scale)')} AS scale,
      {_R.format('avg(abs(scale * est - ref) / ref) FILTER (WHERE ref > 0 AND seen AND est > 0)')} AS abs_rel, {_R.format('count(*) FILTER (WHERE ref > 0 AND seen AND est > 0) / nullif(count(*) FILTER (WHERE ref > 0 AND seen), 0)')} AS coverage FROM px LEFT JOIN s USING (k) GROUP BY px.k""",
)
def point_sampled_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.sampled_errors(_pixels(spark, sf_dir), ["k"], "ref", "est", c("seen"), ["u", "v"])
    return out.withColumns({n: steady(n, 6) for n in ("scale", "abs_rel", "coverage")})


@query(
    "track_error_summary",
    f"""WITH {FRAMES}, e AS (SELECT case_id, sqrt((x - y) ** 2 + (y - z) ** 2) AS t, abs(yaw) / 2 AS r FROM frames)
    SELECT case_id, {_R.format('sqrt(avg(t * t))')} AS translation_rmse, {_R.format('avg(t)')} AS translation_mean, {_R.format('median(t)')} AS translation_median, {_R.format('quantile_cont(t, 0.95)')} AS translation_p95, {_R.format('avg(r)')} AS rotation_mean, {_R.format('median(r)')} AS rotation_median, {_R.format('quantile_cont(r, 0.95)')} AS rotation_p95 FROM e GROUP BY case_id""",
)
def track_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    away = F.sqrt((c("x") - c("y")) * (c("x") - c("y")) + (c("y") - c("z")) * (c("y") - c("z")))
    out = diagnostics.track_errors(frames(spark, sf_dir), ["case_id"], away, F.abs("yaw") / 2)
    return out.select("case_id", *[steady(n, 6).alias(n) for n in out.columns[1:]])


@query(
    "flicker",
    f"""WITH p AS (SELECT l_orderkey % 10 AS k, l_orderkey AS px, l_linenumber - 1 AS f, max(l_quantity) * 5 AS v FROM lineitem GROUP BY ALL), d AS (SELECT a.k, b.f, avg(abs(b.v - a.v)) AS d FROM p a JOIN p b ON b.px = a.px AND b.f = a.f + 2 WHERE a.f % 2 = 0 GROUP BY ALL)
    SELECT k, {_R.format('100 * (1 - avg(d) / 255)')} AS flicker FROM d GROUP BY k""",
)
def flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = table(spark, sf_dir, "lineitem").groupBy((c("l_orderkey") % 10).alias("k"), c("l_orderkey").alias("px"), (c("l_linenumber") - 1).alias("f")).agg((F.max("l_quantity") * 5).alias("v"))
    return diagnostics.flicker(px, ["k"], "f", "px", "v").withColumn("flicker", steady("flicker", 6))


@query(
    "sharpness",
    f"""WITH p AS (SELECT l_linenumber AS k, CAST(l_quantity AS INTEGER) AS r, l_suppkey % 40 AS q, sum(CAST(l_discount * 100 AS INTEGER)) / count(*) AS v FROM lineitem GROUP BY ALL), s AS (SELECT * FROM p WHERE r % 4 = 0 AND q % 4 = 0),
    x AS (SELECT a.k, count(*) AS n, var_pop(b.v - a.v) AS d FROM s a JOIN s b ON a.k = b.k AND a.r = b.r AND b.q = a.q + 4 GROUP BY a.k), y AS (SELECT a.k, count(*) AS n, var_pop(b.v - a.v) AS d FROM s a JOIN s b ON a.k = b.k AND a.q = b.q AND b.r = a.r + 4 GROUP BY a.k)
    SELECT k, {_R.format('CASE WHEN x.n > 0 AND y.n > 0 THEN x.d + y.d ELSE 0 END')} AS sharpness FROM (SELECT DISTINCT k FROM s) LEFT JOIN x USING (k) LEFT JOIN y USING (k)""",
)
def sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = table(spark, sf_dir, "lineitem").groupBy(c("l_linenumber").alias("k"), c("l_quantity").cast("int").alias("r"), (c("l_suppkey") % 40).alias("q")).agg((F.sum(F.round(c("l_discount") * 100).cast("int")) / F.count("*")).alias("v"))
    return diagnostics.sharpness(px, ["k"], "r", "q", "v").withColumn("sharpness", steady("sharpness", 6))


@query("mask_iou", "SELECT l_suppkey, coalesce(round(count(*) FILTER (WHERE l_quantity > 30 AND l_returnflag = 'R') / nullif(count(*) FILTER (WHERE l_quantity > 30 OR l_returnflag = 'R'), 0) + 1e-9, 6), 0) AS iou FROM lineitem GROUP BY ALL")
def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.mask_iou(table(spark, sf_dir, "lineitem"), ["l_suppkey"], c("l_quantity") > 30, c("l_returnflag") == "R").select("l_suppkey", steady("iou", 6).alias("iou"))


@query(
    "route_distance",
    f"""WITH {FRAMES}, n AS (SELECT case_id, x, y, frame_index, row_number() OVER (PARTITION BY case_id ORDER BY frame_index) AS i FROM frames), e AS (SELECT a.case_id, a.x AS ax, a.y AS ay, b.x - a.x AS ex, b.y - a.y AS ey FROM n a JOIN n b ON a.case_id = b.case_id AND b.i = a.i + 1 WHERE b.i <= 6),
    s AS (SELECT n.case_id, n.frame_index, n.x - ax AS dx, n.y - ay AS dy, ex, ey, CASE WHEN ex * ex + ey * ey > 1e-12 THEN greatest(0, least(1, ((n.x - ax) * ex + (n.y - ay) * ey) / (ex * ex + ey * ey))) ELSE 0 END AS sh FROM n LEFT JOIN e USING (case_id))
    SELECT case_id, frame_index, {_R.format('min(sqrt((dx - sh * ex) ** 2 + (dy - sh * ey) ** 2))')} AS distance FROM s GROUP BY ALL""",
)
def route_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame against the route through the first six frames of its case; a route is one short array."""
    f = frames(spark, sf_dir)
    first = f.withColumn("i", F.row_number().over(Window.partitionBy("case_id").orderBy("frame_index"))).where("i <= 6")
    lines = first.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))
    return f.join(lines, "case_id").select("case_id", "frame_index", steady(diagnostics.polyline_distance([c("x"), c("y")], c("line"), ["x", "y"]), 6).alias("distance"))


@query(
    "canonical_frames",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 400 < 357 AND l_suppkey % 500 > 0 THEN CAST(round_even((l_partkey % 400) * (l_suppkey % 500 - 1) / CAST(356 AS DOUBLE), 0) AS BIGINT) END AS frame FROM lineitem",
)
def canonical_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", diagnostics.video_index(c("l_partkey") % 400, F.lit(357), c("l_suppkey") % 500).alias("frame"))


@query(
    "anchor_grades",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 3 < 32 OR l_partkey % 100 < 32 THEN 'insufficient_support' WHEN l_discount * 10 >= 0.5 AND l_tax * 10 >= 0.5 AND coalesce(CASE WHEN l_suppkey % 5 > 0 THEN l_discount * 3 END <= 0.25, false) AND l_tax * 4 <= 0.25 THEN 'consistent' ELSE 'risk' END AS grade,
      l_discount >= 0.02 AND coalesce(CASE WHEN l_suppkey % 5 > 0 THEN l_tax END <= 0.05, false) AND l_quantity / 100 <= 0.2 AS passed FROM lineitem""",
)
def anchor_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lambda x: F.when(c("l_suppkey") % 5 > 0, x)
    there = {"valid": c("l_quantity") * 3, "inside": c("l_discount") * 10, "residual": known(c("l_discount") * 3)}
    back = {"valid": c("l_partkey") % 100, "inside": c("l_tax") * 10, "residual": c("l_tax") * 4}
    passed = diagnostics.anchor_passes(c("l_discount"), known(c("l_tax")), c("l_quantity") / 100, 0.02, 0.05, 0.2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", diagnostics.anchor_grade([there, back]).alias("grade"), passed.alias("passed"))


@query(
    "normalized_centres",
    f"""WITH {FRAMES}, o AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, first_value(z) OVER w AS z0 FROM frames WINDOW w AS (PARTITION BY case_id ORDER BY frame_index)),
    e AS (SELECT *, max(sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0) + (z - z0) * (z - z0))) OVER (PARTITION BY case_id) AS e FROM o), s AS (SELECT *, CASE WHEN e > 1e-12 THEN 1 / e ELSE 1 END AS scale FROM e)
    SELECT case_id, frame_index, {_R.format('scale')} AS scale, {_R.format('x0 + (x - x0) * scale')} AS x, {_R.format('y0 + (y - y0) * scale')} AS y, {_R.format('z0 + (z - z0) * scale')} AS z FROM s""",
)
def normalized_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.normalized_centres(frames(spark, sf_dir), ["case_id"], "frame_index", ["x", "y", "z"])
    return out.select("case_id", "frame_index", *[steady(n, 6).alias(n) for n in ("scale", "x", "y", "z")])


@query(
    "camera_intrinsics",
    f"""WITH k AS (SELECT p_partkey, 500.0::DOUBLE + p_size AS f, 640 + p_partkey % 200 AS w, 480 + p_partkey % 100 AS h, p_size AS l, p_size % 7 AS t FROM part)
    SELECT p_partkey, {_R.format('f * (320 / w)')} AS fx, {_R.format('f * (240 / h)')} AS fy, {_R.format('w / 2 * (320 / w) - l')} AS cx, {_R.format('h / 2 * (240 / h) - t')} AS cy FROM k""",
)
def camera_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, f = 640 + c("p_partkey") % 200, 480 + c("p_partkey") % 100, 500.0 + c("p_size")
    k = diagnostics.intrinsics_after(f, f, w / 2, h / 2, (w, h), (F.lit(320), F.lit(240)), (c("p_size"), c("p_size") % 7))
    out = table(spark, sf_dir, "part").select("p_partkey", k.alias("k")).select("p_partkey", "k.*")
    return out.select("p_partkey", *[steady(n, 6).alias(n) for n in ("fx", "fy", "cx", "cy")])


@query(
    "pixel_rays",
    f"""WITH r AS (SELECT p_partkey, (p_partkey % 64 + 0.5 - 32) / 50 AS a, (p_size + 0.5 - 24) / 50 AS b, radians(p_size * 3) AS w, p_size / 10.0::DOUBLE AS ox FROM part),
    d AS (SELECT *, cos(w) * a + sin(w) AS x, b AS y, cos(w) - sin(w) * a AS z FROM r), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM d)
    SELECT p_partkey, {_R.format('x / n')} AS dx, {_R.format('y / n')} AS dy, {_R.format('z / n')} AS dz, {_R.format('(1.5::DOUBLE * z - 2 * y) / n')} AS mx, {_R.format('(2 * x - ox * z) / n')} AS my, {_R.format('(ox * y - 1.5::DOUBLE * x) / n')} AS mz, {_R.format('cos(w)')} AS r0, {_R.format('-sin(w)')} AS r2, {_R.format('-sin(w)')} AS gl FROM n""",
)
def pixel_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.radians(c("p_size") * 3)
    turn = [[F.cos(a), F.lit(0.0), F.sin(a)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)], [-F.sin(a), F.lit(0.0), F.cos(a)]]
    k = {"fx": F.lit(50.0), "fy": F.lit(50.0), "cx": F.lit(32.0), "cy": F.lit(24.0)}
    ray = diagnostics.plucker(c("p_partkey") % 64, c("p_size"), k, turn, [c("p_size") / 10.0, F.lit(1.5), F.lit(2.0)])
    out = table(spark, sf_dir, "part").select("p_partkey", ray.alias("r"), diagnostics.rotation_6d(turn).alias("six"), diagnostics.opengl_rotation(turn)[0][2].alias("gl"))
    names = ("dx", "dy", "dz", "mx", "my", "mz")
    return out.select("p_partkey", *[steady(c("r")[i], 6).alias(n) for i, n in enumerate(names)], steady(c("six")[0], 6).alias("r0"), steady(c("six")[2], 6).alias("r2"), steady("gl", 6).alias("gl"))


@query(
    "object_names",
    """SELECT p_partkey, format('group_{:04d}', p_partkey) AS g, p_partkey AS hash, concat('Images are in temporal order: Image 1 = ', upper(p_brand), '; Image 2 = ', upper(p_type), '.', chr(10), chr(10), 'look') AS role,
      regexp_matches(CASE p_partkey % 4 WHEN 0 THEN 'Glass door' WHEN 1 THEN 'chair' WHEN 2 THEN 'wallpaper' ELSE '' END, '(?i)wall|floor|ceiling|window|glass|mirror|transparent|remove|^$') AS excluded FROM part""",
)
def object_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.get(F.array(*[F.lit(x) for x in ("Glass door", "chair", "wallpaper", "")]), (c("p_partkey") % 4).cast("int"))
    hexa = F.concat(F.lit(" 0X"), F.hex("p_partkey"), F.lit(" "))
    role = diagnostics.role_text(F.array("p_brand", "p_type"), F.lit("look"))
    return table(spark, sf_dir, "part").select("p_partkey", diagnostics.group_name(F.concat(F.lit("group_"), c("p_partkey").cast("string"))).alias("g"), diagnostics.object_hash(hexa).alias("hash"), role.alias("role"), diagnostics.excluded_label(label).alias("excluded"))


@query("review_order", "SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, s_acctbal DESC, s_suppkey) AS INTEGER) AS place FROM supplier")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("template", c("s_suppkey") % 3)
    return diagnostics.review_order(s, "s_nationkey", "template", "s_acctbal", ["s_suppkey"]).select("s_suppkey", "s_nationkey", "place")


_SHARED = POINTS + """, cells AS (SELECT p.part, CAST(floor(x / 2) AS BIGINT) AS x, CAST(floor(y) AS BIGINT) AS y, CAST(floor(z) AS BIGINT) AS z, CASE WHEN p.l_orderkey % 97 = 0 THEN 'seen' WHEN p.l_linenumber <= 3 THEN 'first' ELSE 'revisit' END AS side FROM points p),
near AS (SELECT DISTINCT part, x + i AS x, y + j AS y, z + k AS z FROM cells, range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k) WHERE side = 'seen'),
shared AS ((SELECT part, x, y, z FROM cells WHERE side = 'first' INTERSECT SELECT part, x, y, z FROM cells WHERE side = 'revisit') EXCEPT SELECT * FROM near)"""


@query(
    "shared_unseen",
    f"""WITH {_SHARED}, h AS (SELECT c.part, count(*) FILTER (WHERE side = 'first') AS first_pixels, count(s.part) FILTER (WHERE side = 'first') AS first_shared, count(*) FILTER (WHERE side = 'revisit') AS revisit_pixels, count(s.part) FILTER (WHERE side = 'revisit') AS revisit_shared
      FROM cells c LEFT JOIN shared s ON c.part = s.part AND c.x = s.x AND c.y = s.y AND c.z = s.z WHERE side <> 'seen' GROUP BY c.part)
    SELECT h.*, (SELECT count(*) FROM shared s WHERE s.part = h.part) AS shared, {_R.format('first_shared / first_pixels')} AS first_share, {_R.format('revisit_shared / revisit_pixels')} AS revisit_share FROM h""",
)
def shared_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumns({"x": F.floor(c("x") / 2), "y": F.floor("y"), "z": F.floor("z")})
    side = F.when(c("l_orderkey") % 97 == 0, "seen").when(c("l_linenumber") <= 3, "first").otherwise("revisit")
    p = p.withColumn("side", side)
    out = diagnostics.shared_unseen(*[p.where(c("side") == s) for s in ("first", "revisit", "seen")], ["part"], ["x", "y", "z"], 1)
    return out.withColumns({n: steady(n, 6) for n in ("first_share", "revisit_share")})


@query("shared_objects", "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber % 2 = 0 AND l_partkey % 10 > 0 INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber % 2 = 1")
def shared_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a supplier on even and on odd lines: two views that are the whole table together."""
    items = table(spark, sf_dir, "lineitem")
    return diagnostics.shared_objects(items.where("l_linenumber % 2 = 0"), items.where("l_linenumber % 2 = 1"), ["l_suppkey"], "l_partkey", c("l_partkey") % 10 == 0)


@query(
    "trajectory_shape",
    f"""WITH {FRAMES}, a AS (SELECT case_id, x - first_value(x) OVER w AS ax, y - first_value(y) OVER w AS ay, z - first_value(z) OVER w AS az, x - lag(x) OVER w AS sx, y - lag(y) OVER w AS sy, z - lag(z) OVER w AS sz FROM frames WINDOW w AS (PARTITION BY case_id ORDER BY frame_index)),
    r AS (SELECT case_id, sqrt(ax * ax + az * az) AS h, sqrt(ax * ax + ay * ay + az * az) AS d, abs(ay) AS v, sqrt(sx * sx + sz * sz) AS sh, abs(sy) AS sv, sqrt(sx * sx + sy * sy + sz * sz) AS s FROM a), q AS (SELECT *, quantile_cont(sh, 0.25) OVER (PARTITION BY case_id) AS q FROM r)
    SELECT case_id, {_R.format('max(h)')} AS horizontal, {_R.format('max(d)')} AS distance, {_R.format('max(v) / greatest(max(h), 1e-6)')} AS vertical_ratio, {_R.format('coalesce(quantile_cont(CASE WHEN sh > greatest(q, 1e-7) THEN sv / greatest(sh, 1e-8) END, 0.95), 0)')} AS slope_p95, {_R.format('max(s) / greatest(quantile_cont(s, 0.9), 1e-8)')} AS spike FROM q GROUP BY case_id""",
)
def trajectory_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.trajectory_shape(frames(spark, sf_dir), ["case_id"], "frame_index", "x", "y", "z")
    return out.select("case_id", *[steady(n, 6).alias(n) for n in out.columns[1:]])


@query(
    "fused_voxels",
    f"""WITH {POINTS}, p AS (SELECT DISTINCT part, x, y, z FROM points), r AS (SELECT *, sqrt((x - 25.3) * (x - 25.3) + (y - 4.7) * (y - 4.7) + (z - 3.9) * (z - 3.9)) AS l FROM (SELECT part, x, y, z FROM p)), f AS (SELECT *, greatest(0, l - 1.1::DOUBLE) AS f FROM r), n AS (SELECT *, least(greatest(1, ceil(f / 2.0::DOUBLE)), 256) AS n FROM f WHERE l > 1e-12 AND f > 0),
    s AS (SELECT part, x, y, z, f / l / n * i AS a FROM n, range(0, 257) g(i) WHERE i <= n), free AS (SELECT DISTINCT part, CAST(floor((25.3::DOUBLE + a * (x - 25.3)) / 2) AS BIGINT) AS x, CAST(floor((4.7::DOUBLE + a * (y - 4.7)) / 2) AS BIGINT) AS y, CAST(floor((3.9::DOUBLE + a * (z - 3.9)) / 2) AS BIGINT) AS z FROM s),
    o AS (SELECT DISTINCT part, CAST(floor(x / 2) AS BIGINT) AS x, CAST(floor(y / 2) AS BIGINT) AS y, CAST(floor(z / 2) AS BIGINT) AS z FROM points)
    SELECT *, 'occupied' AS state FROM o UNION ALL SELECT *, 'free' FROM (SELECT * FROM free EXCEPT SELECT * FROM o)""",
)
def fused_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.fused_voxels(points(spark, sf_dir), ["part"], ["x", "y", "z"], {"x": 25.3, "y": 4.7, "z": 3.9}, 2.0, 1.1)


@query("parent_cases", "SELECT c.c_custkey, c.c_custkey // 3 AS parent, p.c_acctbal AS parent_c_acctbal FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey // 3")
def parent_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "customer").withColumn("parent", F.floor(c("c_custkey") / 3))
    return diagnostics.with_parent(cases, "c_custkey", "parent", ["c_acctbal"]).select("c_custkey", "parent", "parent_c_acctbal")


@query("known_objects", "SELECT l_orderkey, l_linenumber, p_name, p_name IS NOT NULL AS known FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2")
def known_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") * 2).alias("p_partkey"))
    return diagnostics.named_objects(objects, table(spark, sf_dir, "part"), "p_partkey", "p_name").select("l_orderkey", "l_linenumber", "p_name", "known")


@query(
    "validity_ratios",
    """WITH c AS (SELECT s_suppkey AS case_id, 200 + s_suppkey % 60 AS e, 200 + s_suppkey % 60 - s_suppkey % 4 AS d FROM supplier),
    p AS (SELECT *, CASE WHEN case_id % 15 <> 10 THEN 'ok' ELSE 'invalid_plan' END AS status, CASE WHEN case_id % 3 = 0 THEN 2 ELSE 1 END AS step, CASE WHEN case_id % 15 = 10 THEN e - 1 WHEN case_id % 3 = 0 THEN (e + 1) // 2 ELSE e END AS n FROM c),
    o AS (SELECT l_suppkey AS case_id, 'pose' AS kind, (l_orderkey + l_linenumber) % 260 AS f FROM lineitem WHERE l_returnflag <> 'R' UNION SELECT l_suppkey, 'depth', l_partkey % 300 FROM lineitem WHERE l_returnflag = 'R'),
    k AS (SELECT p.case_id, count(CASE WHEN kind = 'pose' AND f < e AND f % step = 0 THEN 1 END) AS pi, count(CASE WHEN kind = 'pose' AND NOT (f < e AND f % step = 0) THEN 1 END) AS po,
        count(CASE WHEN kind = 'depth' AND f < e AND f % step = 0 THEN 1 END) AS di, count(CASE WHEN kind = 'depth' AND NOT (f < e AND f % step = 0) THEN 1 END) AS dout FROM p LEFT JOIN o USING (case_id) GROUP BY p.case_id)
    SELECT case_id, status, CAST(n AS BIGINT) AS expected_geometry, CASE WHEN status = 'ok' THEN d / e END AS video_decode_ratio, CASE WHEN status = 'ok' THEN pi / n END AS pose_output_ratio, CASE WHEN status = 'ok' THEN di / n END AS depth_output_ratio,
    CASE WHEN status = 'ok' THEN po END AS pose_out_of_range, CASE WHEN status = 'ok' THEN dout END AS depth_out_of_range, CASE WHEN status = 'ok' THEN d = e AND pi = n AND di = n AND po = 0 AND dout = 0 END AS complete FROM p JOIN k USING (case_id)""",
)
def validity_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier a case: its returned lines give depth frames and the others pose frames; a third of the cases want every second frame, some have a plan that starts at 1."""
    case, expected = c("s_suppkey"), (200 + c("s_suppkey") % 60).cast("long")
    plan = F.when(case % 15 == 10, F.sequence(F.lit(1).cast("long"), expected - 1)).when(case % 3 == 0, F.sequence(F.lit(0).cast("long"), expected - 1, F.lit(2).cast("long")))
    decoded = (expected - case % 4).cast("long")
    cases = table(spark, sf_dir, "supplier").select(case.alias("case_id"), expected.alias("expected"), decoded.alias("decoded"), (decoded / expected).alias("decode_ratio"), plan.alias("plan"))
    lines = table(spark, sf_dir, "lineitem")
    frame = lambda rows, kind, f: rows.select(c("l_suppkey").alias("case_id"), F.lit(kind).alias("kind"), f.cast("long").alias("frame_index"))
    pose = frame(lines.where("l_returnflag <> 'R'"), "pose", (c("l_orderkey") + c("l_linenumber")) % 260)
    depth = frame(lines.where("l_returnflag = 'R'"), "depth", c("l_partkey") % 300)
    return diagnostics.validity_ratios(cases, pose.union(depth))
