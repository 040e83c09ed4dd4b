"""Gates, verdicts, candidate ranking and checks of submissions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds that a gate may set, and those it must.
GATE_KEYS = (
    "minimum_translation_m", "maximum_translation_m", "minimum_rotation_deg", "maximum_rotation_deg",
    "minimum_forward_component_m", "minimum_lateral_component_m", "maximum_lateral_component_m",
    "minimum_absolute_forward_component_m", "maximum_absolute_forward_component_m",
    "minimum_absolute_right_component_m", "maximum_absolute_right_component_m", "maximum_absolute_vertical_component_m",
    "minimum_forward_ratio", "maximum_absolute_forward_ratio", "minimum_absolute_right_ratio", "maximum_absolute_right_ratio",
    "maximum_absolute_vertical_ratio", "minimum_direction_angle_deg", "maximum_direction_angle_deg",
)
REQUIRED_KEYS = GATE_KEYS[:4]


def gate(component: Mapping[str, Column], thresholds: Mapping[str, float]) -> dict[str, Column]:
    """Checks by threshold name: minimum_x asks for component x of at least it, maximum_x of at most.

    component has the measured columns by the name after minimum_ or maximum_. A gate with
    a key that is unknown, a missing required one or a value that isn't finite and positive is an error.
    """
    unknown, missing = set(thresholds) - set(GATE_KEYS), set(REQUIRED_KEYS) - set(thresholds)
    if unknown or missing or any(not 0 < v < float("inf") for v in thresholds.values()):
        raise ValueError(f"gate: unknown {sorted(unknown)}, missing {sorted(missing)}, or a value out of range")
    checks = {}
    for name, value in thresholds.items():
        side, _, part = name.partition("_")
        checks[name] = component[part] >= value if side == "minimum" else component[part] <= value
    return checks


def passed(checks: Mapping[str, Column]) -> Column:
    """Whether all checks hold."""
    return F.array_size(F.array_compact(F.array(*[F.when(~c, 1) for c in checks.values()]))) == 0


def failures(checks: Mapping[str, Column]) -> Column:
    """The names of the checks that don't hold, in order; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))


def rename_once(codes: Column, names: Mapping[str, str]) -> Column:
    """codes renamed where a new name is known, each kept where it comes first."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_distinct(F.transform(codes, lambda c: F.coalesce(F.element_at(table, c), c)))


def strength(coverage: Column, fraction: Column, valid: Column) -> Column:
    """Grade: invalid without a valid contract, strong from 0.40 coverage on, moderate from 0.10, else weak."""
    return F.when(~valid, "invalid").when(F.least(coverage, fraction) >= 0.40, "strong").when(F.least(coverage, fraction) >= 0.10, "moderate").otherwise("weak")


def calibration(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the 10th, 50th and 90th percentile of their key's values."""
    q = rows.groupBy(key).agg(F.expr(f"percentile({value}, array(0.1, 0.5, 0.9))").alias("q"))
    return rows.join(q.select(key, F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90")), key)


def rank_existing(rows: DataFrame, keys: list[str], order: list[str], existing: str) -> DataFrame:
    """rows with rank: the one they have, or their place in their key's order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.coalesce(F.col(existing), F.row_number().over(w)).cast("long"))


def slate_changes(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of one slate that the other lacks, with the side they are on; none if the slate is unchanged."""
    return frozen.exceptAll(current).withColumn("side", F.lit("frozen")).unionByName(current.exceptAll(frozen).withColumn("side", F.lit("current")))


def missing_and_extra(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """(on, issue): keys expected but not there, and there but not expected."""
    lacking = expected.select(*on).distinct().join(actual.select(*on).distinct(), on, "left_anti").withColumn("issue", F.lit("missing"))
    return lacking.unionByName(actual.select(*on).distinct().join(expected.select(*on).distinct(), on, "left_anti").withColumn("issue", F.lit("extra")))


def verdict(flags: Mapping[str, Column]) -> Column:
    """reject if a hazard is set, else pass; whatever status a review gives itself."""
    found = F.lit(False)
    for f in flags.values():
        found = found | F.coalesce(f, F.lit(False))
    return F.when(found, "reject").otherwise("pass")
