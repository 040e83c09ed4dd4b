"""Queries of leaves, trees, tiers, ranks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.numeric import error_score, finite, lenient_avg, lenient_mean, strict_avg, unit_score
from meridia.operators import scoring
from meridia.operators.ingest import duplicates
from meridia.plans import rules
from meridia.plans.fixtures import LEAVES, MEASUREMENT, MISSING, leaf_values, measurement, measurement_missing
from meridia.plans.registry import query


def _fold_sql(tree) -> str:
    if isinstance(tree, str):
        return tree
    parts = [_fold_sql(t) for t in (tree.values() if isinstance(tree, dict) else tree)]
    return f"(({' + '.join(parts)}) / {len(parts)})"


_PIVOT = ", ".join(f"avg(score) FILTER (WHERE leaf = '{r[0]}') AS {r[0]}" for r in rules.RULES)
_CASE_PIVOT = ", ".join(f"max(score) FILTER (WHERE leaf = '{r[0]}') AS {r[0]}" for r in rules.RULES)
TIERS = LEAVES + f""", leaf_means AS (SELECT model, "group", {_PIVOT} FROM scored GROUP BY ALL),
case_leaves AS (SELECT model, case_id, {_CASE_PIVOT} FROM scored GROUP BY ALL),
case_counts AS (SELECT model, case_id, count(*) % 3 AS n_same, count(*) % 2 AS n_different FROM measurement GROUP BY ALL),
case_branches AS (
  SELECT c.model, c.case_id, {_fold_sql(rules.TREES['same_pose'])} AS same_pose, {_fold_sql(rules.TREES['different_pose'])} AS different_pose, n_same, n_different
  FROM case_leaves c JOIN case_counts USING (model, case_id)),
case_direct AS (
  SELECT model, CASE WHEN (CASE WHEN same_pose IS NULL THEN 0 ELSE n_same END) + (CASE WHEN different_pose IS NULL THEN 0 ELSE n_different END) > 0 THEN
    (coalesce(same_pose, 0) * (CASE WHEN same_pose IS NULL THEN 0 ELSE n_same END) + coalesce(different_pose, 0) * (CASE WHEN different_pose IS NULL THEN 0 ELSE n_different END))
    / ((CASE WHEN same_pose IS NULL THEN 0 ELSE n_same END) + (CASE WHEN different_pose IS NULL THEN 0 ELSE n_different END)) END AS d FROM case_branches),
direct AS (SELECT model, avg(d) AS direct FROM case_direct GROUP BY model),
control AS (SELECT model, CASE WHEN model % 5 = 0 THEN 'action_only' ELSE 'pose_and_action' END AS control_profile,
  avg(100 * (1 - greatest(0, least(1, value / 5000)))) FILTER (WHERE event_id % 4 = 0) AS translation, avg(100 * (1 - greatest(0, least(1, value / 4000)))) FILTER (WHERE event_id % 4 = 1) AS rotation,
  avg(100 * greatest(0, least(1, value / 400))) FILTER (WHERE event_id % 4 = 2) AS move, avg(100 * greatest(0, least(1, value / 300))) FILTER (WHERE event_id % 4 = 3) AS turn FROM measurement GROUP BY model),
quality AS (SELECT model, """ + ", ".join(f"avg(100 * greatest(0, least(1, value / 350))) FILTER (WHERE event_id % 5 = {i}) AS {q}" for i, q in enumerate(rules.QUALITY)) + """ FROM measurement GROUP BY model),
horizons AS (SELECT model, avg(value / 5) FILTER (WHERE case_id % 2 = 0) AS "short", avg(value / 6) FILTER (WHERE case_id % 3 <> 0) AS "long" FROM measurement GROUP BY model),
folded AS (SELECT model, "group", """ + ", ".join(f'{_fold_sql(rules.TREES[t])} AS "{t}"' for t in ("return", "query", "identity", "geometry", "T5")) + """ FROM leaf_means),
tiers AS (
  SELECT model, "group",
    CASE WHEN control_profile = 'action_only' THEN list_avg([x FOR x IN [move, turn] IF x IS NOT NULL]) ELSE list_avg([x FOR x IN [translation, rotation, move, turn] IF x IS NOT NULL]) END AS T1,
    (aesthetic + imaging + flicker + smoothness + hps) / 5 AS T2,
    "return" * 0.3 + "query" * 0.4 + identity * 0.3 AS T3, (direct + geometry) / 2 AS T4, T5, "short" * 0.3 + "long" * 0.7 AS T6
  FROM folded JOIN direct USING (model) JOIN control USING (model) JOIN quality USING (model) JOIN horizons USING (model)),
overall AS (SELECT *, T1 * 0.25 + T2 * 0.25 + T3 * 0.1 + T4 * 0.1 + T5 * 0.1 + T6 * 0.2 AS overall FROM tiers)"""
_TIER_NAMES = [*rules.OVERALL, "overall"]


def model_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, group, T1 .. T6, overall) over the measurement view."""
    m = measurement(spark, sf_dir)
    scores = scoring.normalise(leaf_values(spark, sf_dir), spark)
    means = scoring.wide(scores, ["model", "group"])
    counts = m.groupBy("model", "case_id").agg((F.count("*") % 3).alias("n_same"), (F.count("*") % 2).alias("n_different"))
    cases = scoring.wide(scores, ["model", "case_id"]).select("model", "case_id", *[scoring.fold(rules.TREES[b]).alias(b) for b in ("same_pose", "different_pose")])
    direct = scoring.persistence(cases.join(counts, ["model", "case_id"]))
    part = lambda i, n, score: lenient_avg(F.when(F.col("event_id") % n == i, score))
    v = F.col("value")
    control = m.groupBy("model").agg(
        F.first(F.when(F.col("model") % 5 == 0, "action_only").otherwise("pose_and_action")).alias("control_profile"),
        part(0, 4, error_score(v, 5000.0)).alias("translation"), part(1, 4, error_score(v, 4000.0)).alias("rotation"), part(2, 4, unit_score(v / 400)).alias("move"), part(3, 4, unit_score(v / 300)).alias("turn"),
    )
    quality = m.groupBy("model").agg(*[part(i, 5, unit_score(v / 350)).alias(q) for i, q in enumerate(rules.QUALITY)])
    horizons = m.groupBy("model").agg(F.avg(F.when(F.col("case_id") % 2 == 0, v / 5)).alias("short"), F.avg(F.when(F.col("case_id") % 3 != 0, v / 6)).alias("long"))
    return scoring.tiers(means, direct, control, quality, horizons)


@query("leaf_scores", f"WITH {LEAVES} SELECT model, case_id, leaf, round(score, 6) AS score FROM scored")
def leaf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.normalise(leaf_values(spark, sf_dir), spark).select("model", "case_id", "leaf", F.round("score", 6).alias("score"))


@query("leaf_means", f'WITH {LEAVES} SELECT model, "group", leaf, round(avg(score), 6) AS score, count(score) AS valid FROM scored GROUP BY ALL')
def leaf_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scoring.normalise(leaf_values(spark, sf_dir), spark)
    return scores.groupBy("model", "group", "leaf").agg(F.round(lenient_avg(F.col("score")), 6).alias("score"), F.count("score").alias("valid"))


@query("model_tiers", f'WITH {TIERS} SELECT model, "group", ' + ", ".join(f"round({t}, 5) AS {t}" for t in _TIER_NAMES) + " FROM overall")
def tiers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_tiers(spark, sf_dir).select("model", "group", *[F.round(t, 5).alias(t) for t in _TIER_NAMES])


@query(
    "rank_overall",
    f'WITH {TIERS} SELECT model, "group", round(overall, 5) AS overall, '
    + ", ".join(f'CASE WHEN {t} IS NULL THEN NULL ELSE CAST(rank() OVER (PARTITION BY "group" ORDER BY {t} DESC NULLS LAST) AS INTEGER) END AS {t}_rank' for t in _TIER_NAMES)
    + " FROM overall",
)
def rank_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = scoring.ranked(model_tiers(spark, sf_dir), _TIER_NAMES)
    return ranked.select("model", "group", F.round("overall", 5).alias("overall"), *[f"{t}_rank" for t in _TIER_NAMES]).orderBy(*scoring.leaderboard_order())


@query(
    "mean_kinds",
    f"WITH {MISSING} SELECT model, metric, round(avg(value), 6) AS lenient, round(CASE WHEN count(value) = count(*) THEN avg(value) END, 6) AS strict, count(value) AS valid, count(*) AS n FROM measurement_missing GROUP BY ALL",
)
def mean_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurement_missing(spark, sf_dir)
    v = finite(F.col("value"))
    return m.groupBy("model", "metric").agg(F.round(lenient_avg(F.col("value")), 6).alias("lenient"), F.round(strict_avg(v), 6).alias("strict"), F.count(v).alias("valid"), F.count("*").alias("n"))


@query(
    "summary_percentiles",
    f"WITH {MEASUREMENT} SELECT model, metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95, round(sqrt(avg(value * value)), 6) AS rms FROM measurement GROUP BY ALL",
)
def summary_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.round(F.expr(f"percentile(value, {p})"), 6)
    return measurement(spark, sf_dir).groupBy("model", "metric").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), q(0.5).alias("median"), q(0.05).alias("p05"), q(0.95).alias("p95"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms")
    )


@query(
    "rollup_totals",
    f"WITH {MEASUREMENT} SELECT coalesce(\"group\", 'all') AS \"group\", coalesce(metric, 'all') AS metric, count(*) AS n, round(avg(value), 6) AS mean FROM measurement GROUP BY ROLLUP (\"group\", metric)",
)
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measurement(spark, sf_dir).rollup("group", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(F.coalesce("group", F.lit("all")).alias("group"), F.coalesce("metric", F.lit("all")).alias("metric"), "n", "mean")


@query(
    "report_paths",
    f"""WITH {MEASUREMENT}, cases AS (SELECT model, case_id, avg(value) / 500 AS v, count(*) AS n FROM measurement GROUP BY ALL)
    SELECT c.model, c.case_id, l.leaf, CASE WHEN l.ok AND n % l.gap <> 0 THEN round(v, 6) END AS value FROM cases c,
    (VALUES {", ".join(f"('{r[0]}', {str(r[1] == 'evidence_query' or r[1] == 'da3_reconstruction').lower()}, {3 if r[1] == 'evidence_query' else 5})" for r in rules.RULES)}) AS l(leaf, ok, gap)""",
)
def report_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = measurement(spark, sf_dir).groupBy("model", "case_id").agg((F.avg("value") / 500).alias("v"), F.count("*").alias("n"))
    # A path that ends early holds text where the report would nest further.
    nested: dict = {}
    for _, metric, path, *_ in rules.RULES:
        if metric in ("evidence_query", "da3_reconstruction"):
            at = nested.setdefault(metric, {})
            *way, last = path.split(".")
            for part in way:
                at = at.setdefault(part, {})
            at[last] = None
    build = lambda node: F.struct(*[(F.col("v") if sub is None else build(sub)).alias(k) for k, sub in node.items()])
    gap = {"evidence_query": 3, "da3_reconstruction": 5}
    full = F.to_json(F.struct(F.struct(*[F.when(F.col("n") % gap[m] != 0, build(node)).alias(m) for m, node in nested.items()]).alias("metrics")))
    leaves = scoring.report_leaves(cases.withColumn("payload", full), "payload", ["model", "case_id"])
    return leaves.select("model", "case_id", "leaf", F.round("value", 6).alias("value"))


@query("run_status", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus IN ('P')) THEN 'incomplete' ELSE 'complete' END AS run_status FROM orders GROUP BY ALL")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return scoring.run_status(o.select("o_custkey", F.when(F.col("o_orderstatus") == "P", rules.INCOMPLETE[0]).otherwise("ok").alias("status")), ["o_custkey"])


@query(
    "merge_reports",
    f"""WITH {MEASUREMENT}, prev AS (SELECT case_id, metric, count(*) AS v, max(model) % 2 AS ctx FROM measurement WHERE event_id % 3 <> 0 GROUP BY case_id, metric),
    cur AS (SELECT case_id, metric, 100 + count(*) AS v, 0 AS ctx FROM measurement WHERE event_id % 3 = 0 GROUP BY case_id, metric)
    SELECT case_id, metric, v FROM cur UNION ALL SELECT p.case_id, p.metric, p.v FROM prev p WHERE p.ctx = 0 AND p.case_id IN (SELECT case_id FROM cur) AND NOT EXISTS (SELECT 1 FROM cur c WHERE c.case_id = p.case_id AND c.metric = p.metric)""",
)
def merge_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurement(spark, sf_dir)

    def side(rows: DataFrame, more: int, context) -> DataFrame:
        counted = rows.groupBy("case_id", "metric").agg((F.count("*") + more).alias("v"), context.alias("ctx"))
        return counted.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "v"))).alias("m"), F.max("ctx").alias("ctx"))

    previous = side(m.where("event_id % 3 <> 0"), 0, F.max("model") % 2)
    current = side(m.where("event_id % 3 = 0"), 100, F.max(F.lit(0).cast("long")))
    merged = scoring.merge_maps(previous, current, "case_id", "ctx", "m")
    return merged.select("case_id", F.explode("merged").alias("metric", "v"))


@query("duplicate_keys", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey", "o_orderpriority"])


@query(
    "preference_score",
    f"WITH {MEASUREMENT} SELECT event_id, round(100 * greatest(0, least(1, (value / 50 - 2 - CAST(-5.21 AS DOUBLE)) / (CAST(8.61 AS DOUBLE) - CAST(-5.21 AS DOUBLE)))), 6) AS score, round(list_avg([value, value / 2]), 6) AS both FROM measurement",
)
def preference_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.functions.numeric import linear_score

    low, high = (F.lit(b) for b in rules.PREFERENCE)
    v = F.col("value")
    return measurement(spark, sf_dir).select("event_id", F.round(linear_score(v / 50 - 2, low, high, F.lit(1)), 6).alias("score"), F.round(lenient_mean(v, v / 2, F.lit(float("nan"))), 6).alias("both"))
