"""Queries of time windows and of deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import sampling, timewindows
from meridia.plans import rules
from meridia.plans.fixtures import FRAMES, MEASUREMENT, MISSING, frames, measurement, measurement_missing, steady, table
from meridia.plans.registry import query

#: Two durations: one that windows fill exactly, and one whose tail overlaps.
LONG, SHORT = 60.0, 22.25
_BOUNDS = """bounds(dur, w, a, b, tail) AS (
  SELECT 60.0::DOUBLE, i, i * 5.0::DOUBLE, i * 5.0::DOUBLE + 5, i = 11 FROM range(12) r(i)
  UNION ALL SELECT 22.25::DOUBLE, i, CASE WHEN i = 4 THEN 17.25::DOUBLE ELSE i * 5.0::DOUBLE END, CASE WHEN i = 4 THEN 22.25::DOUBLE ELSE i * 5.0::DOUBLE + 5 END, i = 4 FROM range(5) r(i))"""
_MEANS = MISSING + ", " + _BOUNDS + """, keys AS (SELECT DISTINCT model, metric FROM measurement_missing),
means AS (
  SELECT k.model, k.metric, dur, w AS "window", a AS start, b AS stop,
    (SELECT avg(value) FROM measurement_missing m WHERE m.model = k.model AND m.metric = k.metric AND m.t >= a AND (CASE WHEN tail THEN m.t <= b + 1e-8 ELSE m.t < b END)) AS mean
  FROM keys k, bounds)"""


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurement_missing(spark, sf_dir)
    both = [timewindows.window_means(m, ["model", "metric"], "t", "value", d).withColumn("dur", F.lit(d)) for d in (LONG, SHORT)]
    return both[0].unionByName(both[1]).withColumn("window", F.col("window").cast("long"))


@query("tail_window_means", f'WITH {_MEANS} SELECT model, metric, dur, "window", start, stop, round(mean + 1e-9, 6) AS mean FROM means')
def tail_window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).select("model", "metric", "dur", "window", "start", "stop", steady("mean", 6).alias("mean"))


@query(
    "window_changes",
    f"""WITH {_MEANS} SELECT model, metric, dur, "window", round(first_value(mean) OVER w - mean + 1e-9, 6) + 0.0 AS from_first, round(lag(mean) OVER w - mean + 1e-9, 6) + 0.0 AS from_previous
    FROM means WINDOW w AS (PARTITION BY model, metric, dur ORDER BY "window")""",
)
def window_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timewindows.window_changes(_means(spark, sf_dir), ["model", "metric", "dur"])
    return out.select("model", "metric", "dur", "window", (steady("from_first", 6) + 0.0).alias("from_first"), (steady("from_previous", 6) + 0.0).alias("from_previous"))


@query(
    "window_retention",
    f"""WITH {_MEANS}, f AS (SELECT *, max(CASE WHEN "window" = 0 THEN mean END) OVER (PARTITION BY model, metric, dur) AS w0 FROM means),
    g AS (SELECT model, metric, dur, avg(mean) AS level, avg(greatest(0, w0 - mean)) FILTER (WHERE "window" > 0 AND mean IS NOT NULL AND w0 IS NOT NULL) AS fall, max(w0) AS w0 FROM f GROUP BY ALL)
    SELECT model, metric, dur, CASE WHEN w0 IS NOT NULL AND fall IS NOT NULL THEN round(level + 1e-9, 6) END AS level, round(100 - fall + 1e-9, 6) AS retention FROM g""",
)
def window_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timewindows.retention(_means(spark, sf_dir), ["model", "metric", "dur"])
    return out.select("model", "metric", "dur", steady("level", 6).alias("level"), steady("retention", 6).alias("retention"))


#: The temporal indicators, dealt over the events; every seventh pair of model and indicator has none.
_INDICATORS = [*rules.TEMPORAL["quality"], *rules.TEMPORAL["control"], *[x for pair in rules.TEMPORAL_PAIRS.values() for x in pair], "scale"]


def _mean_sql(value: str, names: tuple[str, ...]) -> str:
    return f"avg({value}) FILTER (WHERE name IN ({', '.join(repr(n) for n in names)}))"


@query(
    "indicator_retention",
    f"""WITH {MISSING}, {_BOUNDS}, named AS (SELECT *, list_value({", ".join(repr(n) for n in _INDICATORS)})[1 + event_id % {len(_INDICATORS)}] AS indicator FROM measurement_missing WHERE (model + event_id % {len(_INDICATORS)}) % 7 <> 0),
    keys AS (SELECT DISTINCT model, indicator FROM named),
    means AS (SELECT k.model, k.indicator, dur, w, avg(value) AS mean FROM keys k CROSS JOIN bounds LEFT JOIN named m ON m.model = k.model AND m.indicator = k.indicator AND m.t >= a AND (CASE WHEN tail THEN m.t <= b + 1e-8 ELSE m.t < b END) GROUP BY ALL),
    f AS (SELECT *, max(CASE WHEN w = 0 THEN mean END) OVER (PARTITION BY model, indicator, dur) AS w0 FROM means),
    g0 AS (SELECT model, indicator AS name, dur, avg(mean) AS every, 100 - avg(greatest(0, w0 - mean)) FILTER (WHERE w > 0 AND mean IS NOT NULL AND w0 IS NOT NULL) AS kept FROM f GROUP BY ALL),
    g AS (SELECT model, name, dur, CASE WHEN kept IS NOT NULL THEN every END AS level, kept FROM g0),
    h AS (SELECT model, dur, CASE WHEN name LIKE 'depth%' THEN 'depth' WHEN name LIKE 'reproj%' THEN 'feature' ELSE name END AS name, avg(level) AS level, avg(kept) AS kept FROM g GROUP BY ALL),
    d AS (SELECT model, dur, {", ".join(f"{_mean_sql('level', v)} AS level_{n}, {_mean_sql('kept', v)} AS kept_{n}" for n, v in rules.TEMPORAL.items())},
      {_mean_sql('level', rules.ACTION_CONTROL)} AS level_moves, {_mean_sql('kept', rules.ACTION_CONTROL)} AS kept_moves FROM h GROUP BY ALL),
    e AS (SELECT * REPLACE (CASE WHEN model % 2 = 0 THEN level_moves ELSE level_control END AS level_control, CASE WHEN model % 2 = 0 THEN kept_moves ELSE kept_control END AS kept_control) FROM d)
    SELECT model, dur, {", ".join(f"round(level_{n} + 1e-8, 5) AS {n}_level, round(kept_{n} + 1e-8, 5) AS {n}_retention" for n in rules.TEMPORAL)},
      round((0.3 * level_quality + 0.7 * kept_quality + 0.3 * level_control + 0.7 * kept_control + 0.3 * level_geometry + 0.7 * kept_geometry) / 3 + 1e-8, 5) AS score FROM e""",
)
def indicator_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions and score of every model at both durations; models of even number are driven by actions alone."""
    n = len(_INDICATORS)
    m = measurement_missing(spark, sf_dir).where(F.expr(f"(model + event_id % {n}) % 7 <> 0"))
    m = m.withColumn("indicator", F.get(F.array(*[F.lit(x) for x in _INDICATORS]), (F.col("event_id") % n).cast("int")))
    parts = [timewindows.window_means(m, ["model", "indicator"], "t", "value", d).withColumn("dur", F.lit(d)) for d in (LONG, SHORT)]
    by = timewindows.retention(parts[0].unionByName(parts[1]), ["model", "indicator", "dur"])
    out = timewindows.dimension_retention(by, ["model", "dur"], "indicator", rules.TEMPORAL, rules.TEMPORAL_PAIRS, rules.INDICATOR["level"], rules.INDICATOR["retention"], F.col("model") % 2 == 0, {"control": rules.ACTION_CONTROL})
    shown = [steady(F.col(f"dimensions.{d}.{f}"), 5).alias(f"{d}_{f}") for d in rules.TEMPORAL for f in ("level", "retention")]
    return out.select("model", "dur", *shown, steady("score", 5).alias("score"))


@query(
    "interval_join",
    f"""WITH {MEASUREMENT}, {_BOUNDS} SELECT event_id, w AS "window" FROM measurement, bounds WHERE dur = 22.25 AND t >= a AND (CASE WHEN tail THEN t <= b + 1e-8 ELSE t < b END)""",
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timewindows.in_windows(measurement(spark, sf_dir), "t", SHORT).select("event_id", F.col("window").cast("long").alias("window"))


_LINSPACE = "CASE WHEN n <= {m} THEN true ELSE list_contains([CASE WHEN k = {m} - 1 THEN n - 1 ELSE CAST(floor(k * (CAST(n - 1 AS DOUBLE) / ({m} - 1))) AS BIGINT) END FOR k IN range({m})], rn) END"


@query(
    "linspace_subsample",
    f"""WITH {FRAMES}, r AS (SELECT case_id, frame_index, row_number() OVER (PARTITION BY case_id ORDER BY frame_index) - 1 AS rn, count(*) OVER (PARTITION BY case_id) AS n FROM frames)
    SELECT case_id, frame_index FROM r WHERE {_LINSPACE.format(m=20)}""",
)
def linspace_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.subsample(frames(spark, sf_dir), ["case_id"], ["frame_index"], 20).select("case_id", "frame_index")


_NEAREST = FRAMES + """, cand AS (
  SELECT l.case_id, l.frame_index AS "left", l.frame_index + {d} AS target, (SELECT max(frame_index) FROM frames x WHERE x.case_id = l.case_id) AS last FROM frames l),
near AS (
  SELECT c.case_id, c."left", arg_min(r.frame_index, abs(r.frame_index - c.target) * 1000000 + r.frame_index) AS "right"
  FROM cand c JOIN frames r ON r.case_id = c.case_id AND r.frame_index > c."left" WHERE c.target <= c.last GROUP BY ALL)"""


@query("nearest_after_join", f'WITH {_NEAREST.format(d=32)} SELECT case_id, "left", "right" FROM near')
def nearest_after_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.nearest_after(frames(spark, sf_dir), ["case_id"], "frame_index", 32)


@query(
    "pair_schedule",
    f"""WITH {_NEAREST.format(d=32)}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY "left", "right") - 1 AS rn, count(*) OVER (PARTITION BY case_id) AS n FROM near),
    kept AS (SELECT case_id, "left", "right" FROM r WHERE {_LINSPACE.format(m=16)})
    SELECT case_id, 'medium' AS baseline, "left" AS source, "right" AS target FROM kept UNION ALL SELECT case_id, 'medium', "right", "left" FROM kept""",
)
def pair_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.pair_schedule(frames(spark, sf_dir), ["case_id"], "frame_index", {"medium": (32, 16)})


@query(
    "context_heldout_split",
    """WITH c AS (SELECT o_custkey, count(*) + 20 AS n FROM orders GROUP BY ALL),
    h AS (SELECT o_custkey, n, list_transform(range(4), lambda i: CAST(round_even((i + 0.5) * (n - 1) / 4, 0) AS BIGINT)) AS held FROM c),
    a AS (SELECT *, [x FOR x IN range(n) IF NOT list_contains(held, x)] AS rest FROM h),
    s AS (SELECT o_custkey, held, list_transform(range(8), lambda i: rest[CAST(round_even(i * (len(rest) - 1) / 7, 0) AS BIGINT) + 1]) AS ctx FROM a)
    SELECT o_custkey, 'heldout' AS part, unnest(held) AS frame FROM s UNION ALL SELECT o_custkey, 'context', unnest(ctx) FROM s""",
)
def context_heldout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg((F.count("*") + 20).alias("n"))
    split = n.select("o_custkey", sampling.context_heldout(F.col("n"), 8, 4).alias("s"))
    part = lambda name: split.select("o_custkey", F.lit(name).alias("part"), F.explode(f"s.{name}").alias("frame"))
    return part("heldout").unionByName(part("context"))


@query(
    "sampling_plan",
    f"""WITH {FRAMES}, p AS (
      SELECT case_id, frame_index, 'uniform' AS reason FROM frames WHERE frame_index % 4 = 0
      UNION SELECT case_id, min(frame_index), 'endpoint' FROM frames GROUP BY case_id UNION SELECT case_id, max(frame_index), 'endpoint' FROM frames GROUP BY case_id
      UNION SELECT case_id, frame_index, 'event' FROM frames WHERE yaw > 150)
    SELECT case_id, frame_index, string_agg(reason, ',' ORDER BY reason) AS reasons FROM p GROUP BY ALL""",
)
def sampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    ends = f.groupBy("case_id").agg(F.min("frame_index").alias("a"), F.max("frame_index").alias("b")).select("case_id", F.explode(F.array("a", "b")).alias("frame_index"))
    plan = sampling.plan_with_reasons([("uniform", f.where("frame_index % 4 = 0")), ("endpoint", ends), ("event", f.where("yaw > 150"))], ["case_id"], "frame_index")
    return plan.select("case_id", "frame_index", F.array_join("reasons", ",").alias("reasons"))


@query(
    "quarter_positions",
    """WITH c AS (SELECT o_custkey, min(o_orderkey % 50) AS a, max(o_orderkey % 90) AS b FROM orders GROUP BY ALL)
    SELECT DISTINCT o_custkey, CAST(least(b, greatest(a + 1, floor(a + q * (b - a) + 0.5))) AS BIGINT) AS position FROM c, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(q) WHERE b > a""",
)
def quarter_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.min(F.col("o_orderkey") % 50).alias("a"), F.max(F.col("o_orderkey") % 90).alias("b"))
    return span.select("o_custkey", F.explode(sampling.quarters(F.col("a"), F.col("b"))).alias("position"))


@query(
    "generation_windows",
    "WITH c AS (SELECT o_custkey, count(*) * 10 AS n FROM orders GROUP BY ALL), k AS (SELECT *, greatest(0, ceil((n - 24) / 16.0)) AS more FROM c) SELECT o_custkey, CAST(i * 16 AS BIGINT) AS start, CAST(i * 16 + 24 AS BIGINT) AS stop FROM k, range(200) r(i) WHERE i <= more",
)
def generation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg((F.count("*") * 10).alias("n"))
    spans = n.select("o_custkey", F.explode(sampling.overlapping_windows(F.col("n"), 24, 8)).alias("w"))
    return spans.select("o_custkey", F.col("w.start").cast("long").alias("start"), F.col("w.stop").cast("long").alias("stop"))


@query(
    "topk_candidates",
    'WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, round(l_quantity * (l_discount + 0.02), 6) AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(l_quantity * (l_discount + 0.02), 6) DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, score, CAST(rn AS INTEGER) AS "rank" FROM r WHERE rn <= 20',
)
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * (F.col("l_discount") + 0.02), 6).alias("score"))
    return sampling.top_k(rows, ["l_suppkey"], F.col("score"), ["l_orderkey", "l_linenumber"], 20)


@query(
    "apportionment",
    """WITH p AS (SELECT o_custkey, o_orderpriority, count(*) AS w FROM orders GROUP BY ALL), e AS (SELECT *, w / CAST(sum(w) OVER (PARTITION BY o_custkey) AS DOUBLE) * 100 AS x FROM p),
    f AS (SELECT *, floor(x) AS whole, 100 - sum(floor(x)) OVER (PARTITION BY o_custkey) AS missing, row_number() OVER (PARTITION BY o_custkey ORDER BY round(x - floor(x), 9) DESC, o_orderpriority) AS rn FROM e)
    SELECT o_custkey, o_orderpriority, CAST(whole + CASE WHEN rn <= missing THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""",
)
def apportionment(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("w"))
    return sampling.apportion(parts, ["o_custkey"], "o_orderpriority", "w", 100)


@query(
    "session_means",
    """WITH e AS (SELECT user_id, event_type, value, epoch_us(ts) AS us FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS s FROM f)
    SELECT user_id, min(us) AS start, max(us) + 43200000000 AS stop, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean FROM g GROUP BY user_id, s""",
)
def session_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events at most twelve hours apart."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = timewindows.sessions(e, ["user_id"], "ts", "12 hours", "value")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n", steady("mean", 6).alias("mean"))
