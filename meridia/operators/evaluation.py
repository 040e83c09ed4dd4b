"""Correspondences, revisits, anchors and curves of evaluated videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators import matching, neighbours
from meridia.session import cut_lineage

from meridia.functions.numeric import finite

# Tiers, and the metrics that each needs.
TIER_METRICS = {
    "T1": ("control",),
    "T2": ("imaging_quality", "aesthetic_quality", "motion_smoothness"),
    "T3": ("q0_return", "evidence_query", "anchor_identity"),
    "T4": ("completion_revisit",),
    "T5": ("depth_temporal_consistency", "covisible_reprojection", "regional_scale_inconsistency", "da3_reconstruction"),
    "T6": ("control", "imaging_quality", "aesthetic_quality", "depth_temporal_consistency", "covisible_reprojection", "regional_scale_inconsistency"),
}


def metrics_of(tiers: str | None = None) -> list[str]:
    """Metrics that some tiers need (names by comma or space; all without any), validity first."""
    wanted = [t.upper() for t in (tiers or " ".join(TIER_METRICS)).replace(",", " ").split()]
    if not wanted or set(wanted) - set(TIER_METRICS):
        raise ValueError(f"tiers must be among {', '.join(TIER_METRICS)}")
    return ["validity", *dict.fromkeys(m for t in TIER_METRICS if t in wanted for m in TIER_METRICS[t])]


def covisible(projected: DataFrame, observed: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """(keys, v, u, projected, observed): front-most projected points on pixels with an observed depth.

    projected has keys, u, v, z and ordinal; observed has keys, u, v, depth. Ties keep the
    first ordinal. Points behind the observed surface are hidden and dropped; points in
    front of it stay, as inconsistencies.
    """
    front = projected.where("z > 1e-8").groupBy(*keys, "v", "u").agg(F.min(F.struct("z", "ordinal")).alias("m")).select(*keys, "v", "u", F.col("m.z").alias("projected"))
    seen = observed.where(finite(F.col("depth")) > 0).select(*keys, "v", "u", F.col("depth").alias("observed"))
    return front.join(seen, [*keys, "v", "u"]).where(F.col("projected") <= F.col("observed") * (1 + tolerance))


def pair_depth_errors(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, abs_rel, abs_rel_median, abs_rel_p95, abs_log, scale_ratio) of co-visible depths."""
    ratio = F.col("observed") / F.greatest("projected", F.lit(1e-8))
    rows = pairs.select(*keys, (F.abs(F.col("projected") - F.col("observed")) / F.greatest("observed", F.lit(1e-8))).alias("r"), ratio.alias("q"), F.abs(F.log(F.greatest(ratio, F.lit(1e-8)))).alias("g"))
    q = lambda c, p: F.expr(f"percentile({c}, {p})")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("r").alias("abs_rel"), q("r", 0.5).alias("abs_rel_median"), q("r", 0.95).alias("abs_rel_p95"), q("g", 0.5).alias("abs_log"), q("q", 0.5).alias("scale_ratio"))


def curve_summary(means: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, expected, evaluated, first, last, fall, worst) of window means; not_covered if one is missing."""
    first = F.max(F.when(F.col("window") == 0, F.col("mean")))
    last = F.max_by("mean", "window")
    return means.groupBy(*keys).agg(
        F.when(F.count("mean") == F.count("*"), "ok").otherwise("not_covered").alias("status"),
        F.count("*").alias("expected"), F.count("mean").alias("evaluated"), first.alias("first"), last.alias("last"), (first - last).alias("fall"), F.min("mean").alias("worst"),
    )


def pose_class(translation: Column, rotation: Column) -> Column:
    """same_pose or different_pose, by how far the requested poses are apart."""
    return F.when((translation <= 1e-6) & (rotation <= 1e-4), "same_pose").otherwise("different_pose")


def anchor_macro(similarities: DataFrame, case: list[str], anchor: str, value: str, expected: str) -> DataFrame:
    """(case, anchors, complete, conditional, least, coverage): mean over anchors of their means. complete is
    null if an anchor has no value; conditional is over those that have one."""
    by = similarities.groupBy(*case, anchor).agg(F.avg(finite(F.col(value))).alias("m"), F.count(finite(F.col(value))).alias("n"), F.sum(expected).alias("e"))
    return by.groupBy(*case).agg(
        F.count("*").alias("anchors"), F.when(F.count("m") == F.count("*"), F.avg("m")).alias("complete"), F.avg("m").alias("conditional"), F.min("m").alias("least"), F.try_divide(F.sum("n"), F.sum("e")).alias("coverage"),
    )


def recovery(observations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, recovered, rate, displacement, status) of tracked anchors; rows have expected_points, recovered, displacement and unknown_points."""
    expected = F.count_if(F.col("expected_points") > 0)
    recovered = F.count_if(F.coalesce(F.col("recovered"), F.lit(False)))
    return observations.groupBy(*keys).agg(
        expected.alias("expected"), recovered.alias("recovered"), F.when(expected > 0, recovered / expected).alias("rate"), F.avg("displacement").alias("displacement"),
        F.when((expected > 0) & (F.sum("unknown_points") == 0), "ok").otherwise("not_covered").alias("status"),
    )


def revisit_verdict(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, passed, grade, fraction, translation, rotation): whether all pairs pass, the weakest by grade and then fraction, and the largest errors."""
    order = F.array_position(F.array(*[F.lit(g) for g in ("invalid", "weak", "moderate", "strong")]), F.col("grade"))
    weakest = F.min(F.struct(order.alias("o"), F.col("fraction"), F.col("grade")))
    return pairs.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), weakest.alias("w"), F.max("translation").alias("translation"), F.max("rotation").alias("rotation")).select(
        *keys, "passed", F.col("w.grade").alias("grade"), F.col("w.fraction").alias("fraction"), "translation", "rotation"
    )


def best_by(rows: DataFrame, keys: list[str], score: str, usable: Column, ordinal: str) -> DataFrame:
    """(keys, ordinal, score): the usable row with the best score; of equals the first."""
    best = F.max(F.struct(F.col(score), (-F.col(ordinal)).alias("back")))
    return rows.where(usable).groupBy(*keys).agg(best.alias("m")).select(*keys, (-F.col("m.back")).alias(ordinal), F.col(f"m.{score}").alias(score))


def lower_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): of an even number of values the lower middle one."""
    w = Window.partitionBy(*keys)
    ordered = rows.withColumns({"_n": F.count(value).over(w), "_i": F.row_number().over(w.orderBy(F.col(value).asc_nulls_last()))})
    return ordered.where(F.col("_i") == F.floor((F.col("_n") + 1) / 2)).select(*keys, F.col(value).alias("median"))


def coalesced(intervals: DataFrame, keys: list[str], start: str, stop: str, label: str) -> DataFrame:
    """(keys, label, start, stop): touching intervals of one label as one."""
    w = Window.partitionBy(*keys).orderBy(start, stop)
    joins = F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.lag(stop).over(w) == F.col(start))
    numbered = intervals.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_run").agg(F.first(label).alias(label), F.min(start).alias(start), F.max(stop).alias(stop)).drop("_run")


def action_labels(track: DataFrame, keys: list[str], index: str, step: int) -> DataFrame:
    """(keys, index, forward, left, back, right, moving): directions of the steps of a track to its next row,
    where that is `step` frames on; a direction holds from half of the step's length, if the step is over a
    hundredth of the mean one. Columns x and z are in the camera's frame of the earlier row."""
    w = Window.partitionBy(*keys).orderBy(index)
    dx, dz = F.lead("x").over(w) - F.col("x"), F.lead("z").over(w) - F.col("z")
    steps = track.select(*keys, index, dx.alias("dx"), dz.alias("dz"), (F.lead(index).over(w) - F.col(index)).alias("gap")).where("gap IS NOT NULL").withColumn("speed", F.sqrt(F.col("dx") * F.col("dx") + F.col("dz") * F.col("dz")))
    steps = steps.withColumn("moving", F.col("speed") > 0.01 * F.avg("speed").over(Window.partitionBy(*keys)))
    unit = lambda c: F.col(c) / F.greatest("speed", F.lit(1e-12))
    held = lambda c: F.col("moving") & c
    out = steps.where(F.col("gap") == step)
    return out.select(*keys, index, held(unit("dz") > 0.5).alias("forward"), held(unit("dx") < -0.5).alias("left"), held(unit("dz") < -0.5).alias("back"), held(unit("dx") > 0.5).alias("right"), "moving")


def action_accuracy(predicted: DataFrame, requested: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, steps, accuracy): share of the requested moves, in percent, whose four labels are all met."""
    names = ("forward", "left", "back", "right")
    both = requested.where(" OR ".join(f"`{n}`" for n in names)).join(predicted.select(*keys, index, *[F.col(n).alias(f"p_{n}") for n in names]), [*keys, index])
    met = F.col("forward") == F.col("p_forward")
    for n in names[1:]:
        met = met & (F.col(n) == F.col(f"p_{n}"))
    return both.groupBy(*keys).agg(F.count("*").alias("steps"), (100 * F.avg(met.cast("double"))).alias("accuracy"))


def arc_length_samples(track: DataFrame, keys: list[str], index: str, coordinates: list[str], n: int) -> DataFrame:
    """(keys, sample, distance, coordinates): n points evenly along each path, by the length travelled.

    Every segment gives the samples that end in it by arithmetic, so nothing is joined by range.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    square = sum(((F.lead(c).over(w) - F.col(c)) * (F.lead(c).over(w) - F.col(c)) for c in coordinates), F.lit(0.0))
    rows = track.select(*keys, index, *coordinates, *[F.lead(c).over(w).alias(f"_{c}") for c in coordinates], F.sqrt(square).alias("_length"))
    rows = rows.withColumn("_stop", F.sum("_length").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumns({"_total": F.max("_stop").over(Window.partitionBy(*keys)), "_last": F.lead("_length").over(w).isNull()}).where("_length > 0")
    begin = F.col("_stop") - F.col("_length")
    # Samples after the segment's begin up to its end; the first segment has sample 0, the last one all to the end.
    at = lambda x: F.floor(x / F.col("_total") * (n - 1) + 1e-9).cast("int")
    low = F.when(begin <= 1e-12, 0).otherwise(at(begin) + 1)
    high = F.when(F.col("_last"), n - 1).otherwise(at(F.col("_stop")))
    spread = rows.withColumn("sample", F.explode(F.when(low <= high, F.sequence(low, high))))
    distance = F.col("sample") * F.col("_total") / (n - 1)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (distance - begin) / F.col("_length")))
    return spread.select(*keys, "sample", distance.alias("distance"), *[(F.col(c) + share * (F.col(f"_{c}") - F.col(c))).alias(c) for c in coordinates])


def shortlist(boxes: DataFrame, group: str, overlap: float, most: int) -> DataFrame:
    """(group, id, area): boxes by area from the largest, without those that overlap a kept one by IoU, `most` at the most.

    Each choice depends on those before, so a group is handled in one task; it holds the
    candidates of one picture.
    """
    import numpy as np
    import pyarrow as pa

    kind = boxes.schema[group].dataType.simpleString()

    def choose(table: pa.Table) -> pa.Table:
        x0, y0, x1, y1, ids = (table.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1", "id"))
        area = (x1 - x0) * (y1 - y0)
        kept: list[int] = []
        for i in np.lexsort((ids, -area)).tolist():
            k = np.array(kept, np.int64)
            shared = np.clip(np.minimum(x1[i], x1[k]) - np.maximum(x0[i], x0[k]), 0, None) * np.clip(np.minimum(y1[i], y1[k]) - np.maximum(y0[i], y0[k]), 0, None)
            if not (shared >= overlap * (area[i] + area[k] - shared)).any():
                kept.append(i)
            if len(kept) == most:
                break
        return table.select([group, "id"]).take(pa.array(kept, pa.int64())).append_column("area", pa.array(area[kept], pa.float64()))

    return boxes.select(group, "id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).groupBy(group).applyInArrow(choose, f"{group} {kind}, id long, area double")


def centre_crop(width: Column, height: Column, target_width: int = 1280, target_height: int = 720) -> Column:
    """Struct (left, top, width, height, scale_x, scale_y) of the largest centred crop of the target's shape; sizes round half to even."""
    aspect = target_width / target_height
    wide = width / height >= aspect
    w = F.when(wide, F.least(width, F.rint(height * aspect).cast("int"))).otherwise(width)
    h = F.when(wide, height).otherwise(F.least(height, F.rint(width / aspect).cast("int")))
    half = lambda a, b: F.when(b, F.floor(a / 2)).otherwise(0).cast("int")
    return F.struct(half(width - w, wide).alias("left"), half(height - h, ~wide).alias("top"), w.alias("width"), h.alias("height"), (target_width / w).alias("scale_x"), (target_height / h).alias("scale_y"))


def nearest_distances(left: DataFrame, right: DataFrame, keys: tuple[str, ...], coordinates: list[str], id_: str, start: float) -> DataFrame:
    """(keys, id, distance) of each left point to the nearest right point of its key; none for a key without right points.

    `start` is the width of the narrowest cells of the search, which changes its work and not its result.
    """
    near = neighbours.nearest_k(left, right, list(keys), coordinates, 1, start)
    return left.join(near.select(*keys, *coordinates, "distance"), [*keys, *coordinates]).select(*keys, id_, "distance")


def trimmed_mean(rows: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """(keys, n, mean) of values held to their percentile at `share`."""
    top = rows.groupBy(*keys).agg(F.expr(f"percentile({value}, {share})").alias("_top"))
    return rows.join(top, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.least(value, "_top")).alias("mean"))
