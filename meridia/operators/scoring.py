"""Leaf scores, trees of strict means, tiers, overall score and ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions.numeric import lenient_avg, lenient_mean, linear_score, strict_mean, unit_score
from meridia.plans import rules

Tree = str | Sequence | Mapping


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules, of a fixed few rows, as a table."""
    return spark.createDataFrame(rules.RULES, "leaf string, metric string, path string, mode string, lo double, hi double, direction int")


def report_leaves(reports: DataFrame, payload: str, carry: Sequence[str]) -> DataFrame:
    """(carried columns, leaf, value) of every rule from a JSON column; a path that is broken off gives null."""
    v = F.try_parse_json(F.col(payload))
    items = [F.struct(F.lit(leaf).alias("leaf"), F.try_variant_get(v, f"$.metrics.{metric}.{path}", "double").alias("value")) for leaf, metric, path, *_ in rules.RULES]
    return reports.select(*carry, F.explode(F.array(*items)).alias("e")).select(*carry, "e.*")


def normalise(leaves: DataFrame, spark: SparkSession) -> DataFrame:
    """leaves (.., leaf, value) with the score that the leaf's rule gives; unknown leaves get null."""
    table = F.broadcast(rule_table(spark).select("leaf", "mode", "lo", "hi", "direction"))  # a fixed few rows
    score = F.when(F.col("mode") == "unit", unit_score(F.col("value"))).otherwise(linear_score(F.col("value"), F.col("lo"), F.col("hi"), F.col("direction")))
    return leaves.join(table, "leaf", "left").withColumn("score", score).drop("mode", "lo", "hi", "direction")


def fold(tree: Tree) -> Column:
    """A tree as one expression over leaf columns: strict means all the way up."""
    if isinstance(tree, str):
        return F.col(tree)
    return strict_mean(*[fold(t) for t in (tree.values() if isinstance(tree, Mapping) else tree)])


def wide(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with the lenient mean of each leaf's score as a column."""
    return scores.groupBy(*keys).pivot("leaf", [r[0] for r in rules.RULES]).agg(lenient_avg(F.col("score")))


def weighted(parts: Mapping[str, float]) -> Column:
    """Weighted sum of columns; null if any is."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.col(name) * weight
    return total


def persistence(cases: DataFrame, model: str = "model") -> DataFrame:
    """(model, direct): score of each case from (same_pose, n_same, different_pose, n_different), weighted by
    the counts of branches that have a score and a count, then the mean over the cases that have one."""
    n = lambda s, c: F.when(F.col(s).isNotNull(), F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    total = n("same_pose", "n_same") + n("different_pose", "n_different")
    weighed = F.coalesce(F.col("same_pose"), F.lit(0.0)) * n("same_pose", "n_same") + F.coalesce(F.col("different_pose"), F.lit(0.0)) * n("different_pose", "n_different")
    return cases.withColumn("case_direct", F.when(total > 0, weighed / total)).groupBy(model).agg(F.avg("case_direct").alias("direct"))


def tiers(leaf_means: DataFrame, direct: DataFrame, control: DataFrame, quality: DataFrame, horizons: DataFrame, model: str = "model") -> DataFrame:
    """(model, group, T1 .. T6, overall) from the parts of each tier by model.

    T1 is lenient over its parts (only move and turn for the profile action_only), T2
    strict; T3, T4 and T5 fold trees of strict means; T6 needs both horizons. overall is
    null if a tier is.
    """
    parts = {name: fold(tree).alias(name) for name, tree in rules.TREES.items() if name not in ("same_pose", "different_pose")}
    folded = leaf_means.select(model, "group", *parts.values())
    joined = folded.join(direct, model, "left").join(control, model, "left").join(quality, model, "left").join(horizons, model, "left")
    t1 = F.when(F.col("control_profile") == "action_only", lenient_mean(F.col("move"), F.col("turn"))).otherwise(lenient_mean(*[F.col(c) for c in rules.CONTROL]))
    scored = joined.select(
        model,
        "group",
        t1.alias("T1"),
        strict_mean(*[F.col(c) for c in rules.QUALITY]).alias("T2"),
        weighted(rules.T3).alias("T3"),
        strict_mean(F.col("direct"), F.col("geometry")).alias("T4"),
        F.col("T5"),
        weighted(rules.T6).alias("T6"),
    )
    return scored.withColumn("overall", weighted(rules.OVERALL))


def ranked(scores: DataFrame, columns: Sequence[str], group: str = "group") -> DataFrame:
    """scores with the competition rank of each column in its group, the largest first; nulls have none."""
    rank = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy(group).orderBy(F.col(c).desc_nulls_last())))
    return scores.withColumns({f"{c}_rank": rank(c) for c in columns})


def leaderboard_order(group: str = "group", overall: str = "overall", model: str = "model") -> list[Column]:
    """Order of a leaderboard: group, overall from the largest with null as -1, model."""
    return [F.col(group), F.coalesce(F.col(overall), F.lit(-1.0)).desc(), F.col(model)]


def run_status(metrics: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """(keys, run_status): incomplete if a metric's status is among those that leave a run incomplete."""
    return metrics.groupBy(*keys).agg(F.when(F.bool_or(F.col(status).isin(*rules.INCOMPLETE)), "incomplete").otherwise("complete").alias("run_status"))


def merge_maps(previous: DataFrame, current: DataFrame, key: str, context: str, values: str) -> DataFrame:
    """(key, merged): the maps of both where contexts agree, the current side last; else only the current one."""
    p, c = previous.alias("p"), current.alias("c")
    same = F.col(f"p.{context}").eqNullSafe(F.col(f"c.{context}")) & F.col(f"p.{values}").isNotNull()
    older = F.map_filter(F.col(f"p.{values}"), lambda k, v: ~F.map_contains_key(F.col(f"c.{values}"), k))
    merged = F.when(same, F.map_concat(older, F.col(f"c.{values}"))).otherwise(F.col(f"c.{values}"))
    return c.join(p, F.col(f"p.{key}") == F.col(f"c.{key}"), "left").select(F.col(f"c.{key}").alias(key), merged.alias("merged"))
