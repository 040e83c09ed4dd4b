"""Queries of gates, knots, verdicts and text contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import text
from meridia.functions.numeric import knots
from meridia.operators import curation, ingest
from meridia.plans.fixtures import FRAMES, frames, table
from meridia.plans.registry import query

# Scores of a mask's area, in percent of the picture.
AREA_KNOTS = ((0.0, 0.0), (0.3, 2.0), (1.0, 5.0), (2.0, 8.0), (5.0, 10.0))
BALANCE_KNOTS = ((0.0, 0.35), (0.25, 0.65), (0.5, 1.0))
GATE = {
    "minimum_translation_m": 5.0, "maximum_translation_m": 200.0, "minimum_rotation_deg": 5.0, "maximum_rotation_deg": 150.0,
    "maximum_absolute_vertical_component_m": 120.0, "minimum_absolute_right_ratio": 0.1,
}


def _knots_sql(value: str, points) -> str:
    steps = " ".join(f"WHEN {value} <= {x1}::DOUBLE THEN {y0}::DOUBLE + ({value} - {x0}::DOUBLE) / ({x1}::DOUBLE - {x0}::DOUBLE) * ({y1}::DOUBLE - {y0}::DOUBLE)" for (x0, y0), (x1, y1) in zip(points[:-1], points[1:], strict=True))
    return f"(CASE WHEN {value} <= {points[0][0]}::DOUBLE THEN {points[0][1]}::DOUBLE {steps} ELSE {points[-1][1]}::DOUBLE END)"


_AREA = "(l_quantity / 8)"
_OTHER = "(l_quantity * (0.2::DOUBLE + 5 * l_discount))"
_LOW, _HIGH = f"least({_AREA}, {_OTHER})", f"greatest({_AREA}, {_OTHER})"


@query(
    "knot_scores",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, {_LOW} AS lo, {_HIGH} AS hi FROM lineitem), b AS (SELECT *, lo / hi AS balance FROM a)
    SELECT l_orderkey, l_linenumber, round(least(13, 1.3::DOUBLE * greatest(0, least(10, {_knots_sql('lo', AREA_KNOTS)} * CASE WHEN balance < 0.5 THEN {_knots_sql('balance', BALANCE_KNOTS)} ELSE 1 END))), 6) AS score FROM b""",
)
def knot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q / 8).alias("a"), (q * (0.2 + 5 * d)).alias("b"))
    rows = rows.select("l_orderkey", "l_linenumber", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    balance = F.col("lo") / F.col("hi")
    base = knots(F.col("lo"), AREA_KNOTS) * F.when(balance < 0.5, knots(balance, BALANCE_KNOTS)).otherwise(1.0)
    return rows.select("l_orderkey", "l_linenumber", F.round(F.least(F.lit(13.0), 1.3 * F.greatest(F.lit(0.0), F.least(F.lit(10.0), base))), 6).alias("score"))


_GATE_PAIRS = FRAMES + """, p AS (
  SELECT a.case_id, a.frame_index, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, abs(b.yaw - a.yaw) AS rot, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) AS dist
  FROM frames a JOIN frames b ON b.case_id = a.case_id AND b.frame_index = a.frame_index + 8)"""


def _gate_checks() -> dict:
    c = F.col
    parts = {
        "translation_m": F.round("dist", 9), "rotation_deg": c("rot"), "absolute_vertical_component_m": F.abs(F.round("dy", 9)),
        "absolute_right_ratio": F.coalesce(F.round(F.abs(F.try_divide(c("dx"), c("dist"))), 9), F.lit(0.0)),
    }
    return curation.gate(parts, GATE)


@query(
    "pose_gate",
    f"""WITH {_GATE_PAIRS}, g AS (SELECT case_id, frame_index, [CASE WHEN round(dist, 9) < 5 THEN 'minimum_translation_m' END, CASE WHEN round(dist, 9) > 200 THEN 'maximum_translation_m' END, CASE WHEN rot < 5 THEN 'minimum_rotation_deg' END, CASE WHEN rot > 150 THEN 'maximum_rotation_deg' END,
      CASE WHEN abs(round(dy, 9)) > 120 THEN 'maximum_absolute_vertical_component_m' END, CASE WHEN coalesce(round(abs(dx / dist), 9), 0) < 0.1::DOUBLE THEN 'minimum_absolute_right_ratio' END] AS f FROM p)
    SELECT case_id, frame_index, array_to_string([x FOR x IN f IF x IS NOT NULL], ',') AS failed, len([x FOR x IN f IF x IS NOT NULL]) = 0 AS passed FROM g""",
)
def pose_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    from meridia.operators.matching import lag_join

    pairs = lag_join(f, ["case_id"], "frame_index", 8, ["x", "y", "z", "yaw"])
    d = {n: F.col(f"{c}_next") - F.col(c) for n, c in (("dx", "x"), ("dy", "y"), ("dz", "z"))}
    pairs = pairs.select("case_id", "frame_index", *[v.alias(k) for k, v in d.items()], F.abs(F.col("yaw_next") - F.col("yaw")).alias("rot"))
    pairs = pairs.withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    checks = _gate_checks()
    return pairs.select("case_id", "frame_index", F.array_join(curation.failures(checks), ",").alias("failed"), curation.passed(checks).alias("passed"))


_LOWER = "lower(split_part(text, '.', 1))"


@query(
    "policy_failure_codes",
    """WITH c AS (SELECT l_orderkey, l_linenumber, [CASE WHEN l_quantity < 5 THEN 'small' END, CASE WHEN l_discount > 0.08 THEN 'overlap' END, CASE WHEN l_tax > 0.07 THEN 'edge' END, CASE WHEN l_returnflag = 'R' THEN 'low' END] AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, array_to_string([x FOR x IN c IF x IS NOT NULL], ',') AS codes FROM c""",
)
def policy_failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    checks = {"area": c("l_quantity") >= 5, "overlap": c("l_discount") <= 0.08, "edge": c("l_tax") <= 0.07, "tracked": c("l_returnflag") != "R"}
    codes = curation.rename_once(curation.failures(checks), {"area": "small", "tracked": "low"})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(codes, ",").alias("codes"))


@query(
    "motion_calibration",
    "SELECT p_partkey, round(quantile_cont(p_retailprice, 0.1) OVER w, 6) AS p10, round(quantile_cont(p_retailprice, 0.5) OVER w, 6) AS p50, round(quantile_cont(p_retailprice, 0.9) OVER w, 6) AS p90 FROM part WINDOW w AS (PARTITION BY p_brand)",
)
def motion_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curation.calibration(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query(
    "rank_in_template",
    'SELECT p_partkey, CAST(coalesce(CASE WHEN p_size % 7 = 0 THEN p_size END, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS BIGINT) AS "rank" FROM part',
)
def rank_in_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("existing", F.when(F.col("p_size") % 7 == 0, F.col("p_size")))
    return curation.rank_existing(rows, ["p_brand"], ["p_partkey"], "existing").select("p_partkey", "rank")


@query("slate_changes", "SELECT o_orderkey, o_orderpriority, 'frozen' AS side FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0 UNION ALL SELECT o_orderkey, o_orderpriority, 'current' FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0")
def slate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return curation.slate_changes(o.where("o_orderkey % 13 <> 0"), o.where("o_orderkey % 11 <> 0"))


@query(
    "hazard_verdict",
    "SELECT d.doc_id, CASE WHEN coalesce(l.toxic = 1, false) OR coalesce(l.quality = 0, false) OR coalesce(d.n_chars > 20000, false) THEN 'reject' ELSE 'pass' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def hazard_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", curation.verdict({"toxic": F.col("toxic") == 1, "poor": F.col("quality") == 0, "long": F.col("n_chars") > 20000}).alias("verdict"))


@query(
    "strength_grade",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'invalid' WHEN least(l_quantity / 50, l_discount * 10) >= 0.4 THEN 'strong' WHEN least(l_quantity / 50, l_discount * 10) >= 0.1 THEN 'moderate' ELSE 'weak' END AS grade FROM lineitem",
)
def strength_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", curation.strength(c("l_quantity") / 50, c("l_discount") * 10, c("l_returnflag") != "R").alias("grade"))


@query(
    "caption_contract",
    r"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS c FROM documents),
    n AS (SELECT doc_id, c, len(regexp_extract_all(c, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) AS n FROM c)
    SELECT doc_id, n AS words, array_to_string([x FOR x IN [CASE WHEN n < 80 OR n > 150 THEN 'length' END, CASE WHEN regexp_matches(c, '^(?:this[ \t\n\x0B\f\r]+(?:image|video|frame|scene)|the[ \t\n\x0B\f\r]+(?:image|video|frame)|in[ \t\n\x0B\f\r]+this[ \t\n\x0B\f\r]+(?:image|video|frame))\b', 'i') THEN 'meta' END,
      CASE WHEN regexp_matches(c, '\b(?:on|to)[ \t\n\x0B\f\r]+the[ \t\n\x0B\f\r]+(?:left|right)\b|\b(?:foreground|background)\b', 'i') THEN 'image_plane' END] IF x IS NOT NULL], ',') AS problems FROM n""",
)
def caption_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    caption = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(text.squeezed(caption)).alias("words"), F.array_join(text.caption_problems(caption), ",").alias("problems"))


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "prompt_normalize",
    rf"""WITH s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '.')) AS s, generate_subscripts(string_split(coalesce(text, ''), '.'), 1) - 1 AS sentence FROM documents),
    p AS (SELECT doc_id, sentence, trim(regexp_replace(lower(s), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS p FROM s), w AS (SELECT *, regexp_extract_all(p, '[a-z0-9]+(?:-[a-z0-9]+)?') AS w FROM p)
    SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, p AS prompt FROM w WHERE len(w) BETWEEN 1 AND 4 AND NOT list_has_any(w, {_listed(("and", "or", *text.POSITION))}) AND (NOT list_has_any(w, {_listed(text.UNBOUNDED)}) OR list_has_any(w, {_listed(text.BOUNDED)}))""",
)
def prompt_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every text that are prompts."""
    sentences = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), r"\.", -1)).alias("sentence", "s"))
    return sentences.select("doc_id", "sentence", text.prompt(F.col("s")).alias("prompt")).where("prompt IS NOT NULL")


@query(
    "anchor_taxonomy",
    f"""WITH n AS (SELECT p_partkey, [['road', 'sign', 'wall', 'lamp', 'sky', 'rock'][p_partkey % 6 + 1], ['door', 'track', 'stone', 'floor', 'window', 'left', 'fence'][p_partkey % 7 + 1]] AS w FROM part), b AS (SELECT *, (NOT list_has_any(w, {_listed(text.UNBOUNDED)}) OR list_has_any(w, {_listed(text.BOUNDED)})) AS bounded FROM n),
    o AS (SELECT p_partkey, bounded, w[1] AS a, w[2] AS b, (NOT list_contains({_listed(text.UNBOUNDED)}, w[1]) OR list_contains({_listed(text.BOUNDED)}, w[1])) AS fa, (w[2] <> 'left' AND (NOT list_contains({_listed(text.UNBOUNDED)}, w[2]) OR list_contains({_listed(text.BOUNDED)}, w[2]))) AS fb FROM b)
    SELECT p_partkey, bounded, CASE WHEN fa AND fb THEN a || ',' || b END AS prompts FROM o""",
)
def anchor_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda *words: F.get(F.array(*[F.lit(w) for w in words]), (k % len(words)).cast("int"))
    one, two = pick("road", "sign", "wall", "lamp", "sky", "rock"), pick("door", "track", "stone", "floor", "window", "left", "fence")
    return table(spark, sf_dir, "part").select("p_partkey", text.bounded_anchor(F.concat_ws(" ", one, two)).alias("bounded"), F.array_join(text.prompts(F.array(one, F.concat(F.lit(" "), F.upper(two)), one)), ",").alias("prompts"))


@query("slugify", "SELECT page_id, regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("last_numbers", r"SELECT page_id, CAST(nullif(regexp_extract(url, '(\d+)\D*$', 1), '') AS BIGINT) AS n, regexp_matches(url, '^[^/\\]+$') AS safe FROM pages")
def last_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.last_number(F.col("url")).alias("n"), text.safe_name(F.col("url")).alias("safe"))


@query(
    "submission_checks",
    """SELECT c_custkey, array_to_string([x FOR x IN [CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'segment' END, CASE WHEN length(c_name) > 16 THEN 'name' END,
      CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'no_orders' END] IF x IS NOT NULL], ',') AS issues FROM customer""",
)
def submission_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    have = table(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    rows = table(spark, sf_dir, "customer").join(have, "c_custkey", "left")
    checks = {"balance": c("c_acctbal") >= 0, "segment": c("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), "name": F.char_length("c_name") <= 16, "no_orders": c("has").isNotNull()}
    return rows.select("c_custkey", F.array_join(curation.failures(checks), ",").alias("issues"))


@query("stale_stages", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 OR o_custkey % 5 = 0")
def stale_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    receipts = ingest.stale(stages.where("o_orderkey % 4 = 0 AND o_custkey % 5 <> 0"), stages.select("o_orderkey", F.lit("").alias("fingerprint")), "o_orderkey", ["o_custkey", "o_orderstatus"])
    return ingest.stale(stages, receipts, "o_orderkey", ["o_custkey", "o_orderstatus"]).select("o_orderkey")
