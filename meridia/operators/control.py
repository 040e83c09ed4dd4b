"""Control of a run against its request, consistency by baseline, and the record of the requested horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.numeric import finite


def _length(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def control_summary(track: DataFrame, keys: list[str], index: str, executed: list[str], requested: list[str], rotation_error: str, scale: str, frames: str, stride: int) -> DataFrame:
    """(keys, status, and the control figures) of tracks whose poses are aligned with their requests.

    A row has both positions, the rotation error in degrees, the track's scale and the number of `frames` asked for. Primary rows,
    those at multiples of stride, give the means, the root mean square and the 95th
    percentile; all rows give ate (root mean square distance, not scaled), the ratio of path
    lengths, the share of frames with a pose. status is missing_samples if a multiple of stride under `frames` has no
    row, too_few if fewer than two primary rows are there, and ok else; the means are null unless ok.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    apart = _length([F.col(a) - F.col(b) for a, b in zip(executed, requested, strict=True)])
    step = lambda names: F.coalesce(_length([F.col(c) - F.lag(c).over(w) for c in names]), F.lit(0.0))
    primary = F.col(index) % stride == 0
    rows = track.select(*keys, primary.alias("_primary"), (primary & (F.col(index) < F.col(frames))).alias("_asked"), F.col(frames).alias("_frames"), apart.alias("_apart"), (apart / F.col(scale)).alias("_t"), F.col(rotation_error).alias("_r"), F.col(scale).alias("_scale"), step(executed).alias("_done"), step(requested).alias("_path"))
    mine = lambda c: F.when(F.col("_primary"), c)
    t, r = mine(F.col("_t")), mine(F.col("_r"))
    out = rows.groupBy(*keys).agg(
        F.max("_frames").alias("_frames"), F.count_if("_asked").alias("_have"), F.count_if("_primary").alias("primary"), F.count("*").alias("_n"),
        F.avg(t).alias("translation_mean"), F.avg(r).alias("rotation_mean"), F.sqrt(F.avg(t * t)).alias("translation_rmse"), F.percentile(r, 0.95).alias("rotation_p95"),
        F.sqrt(F.avg(F.col("_apart") * F.col("_apart"))).alias("ate"), F.max("_scale").alias("_scale"), (F.sum("_done") / F.greatest(F.sum("_path"), F.lit(1e-6))).alias("path_ratio"),
    )
    status = F.when(F.col("_have") < F.ceil(F.col("_frames") / F.lit(stride)), "missing_samples").when(F.col("primary") < 2, "too_few").otherwise("ok")
    shown = [F.when(status == "ok", F.col(c)).alias(c) for c in ("translation_mean", "rotation_mean", "translation_rmse", "rotation_p95")]
    return out.select(*keys, status.alias("status"), "primary", *shown, "ate", (F.col("ate") / F.col("_scale")).alias("ate_normalized"), "path_ratio", (F.col("_n") / F.col("_frames")).alias("usable_ratio"))


def node_coverage(events: DataFrame, track: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, events, covered, coverage): the share of a case's events, rows of (keys, index or null), whose frame has a pose."""
    there = track.select(*keys, index).distinct().withColumn("_there", F.lit(True))
    joined = events.select(*keys, index).join(there, [*keys, index], "left")
    return joined.groupBy(*keys).agg(F.count("*").alias("events"), F.count("_there").alias("covered"), (F.count("_there") / F.count("*")).alias("coverage"))


def consistency_by_baseline(pairs: DataFrame, keys: list[str], baseline: str, points: str, available: str, reasons: str, fields: list[str]) -> DataFrame:
    """(keys, baseline, status, counts, failure_reasons, and of each field its mean, median and p95 over the pairs).

    A row is a scheduled pair: its number of `points`, whether it is `available`, an array of
    `reasons`, and its own errors. Usable pairs have points; only their finite errors count. status is ok with a usable pair and not_covered without.
    """
    usable = F.col(points) > 0
    stats = []
    for f in fields:
        value = F.when(usable, finite(F.col(f)))
        stats += [F.avg(value).alias(f"{f}_mean"), F.percentile(value, 0.5).alias(f"{f}_median"), F.percentile(value, 0.95).alias(f"{f}_p95")]
    counted = pairs.groupBy(*keys, baseline).agg(F.count("*").alias("scheduled"), F.count_if(available).alias("available"), F.count_if(usable).alias("usable"), F.coalesce(F.sum(F.when(usable, F.col(points))), F.lit(0)).alias("points"), *stats)
    named = pairs.select(*keys, baseline, F.explode(reasons).alias("_reason")).groupBy(*keys, baseline, "_reason").count()
    histogram = named.groupBy(*keys, baseline).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_reason", "count")))).alias("failure_reasons"))
    status = F.when(F.col("usable") > 0, "ok").otherwise("not_covered")
    none = F.create_map().cast("map<string, bigint>")
    out = counted.join(histogram, [*keys, baseline], "left").withColumn("failure_reasons", F.coalesce("failure_reasons", none))
    return out.select(*keys, baseline, status.alias("status"), *[c for c in out.columns if c not in (*keys, baseline)])


def horizon_record(cases: DataFrame, curves: DataFrame, keys: list[str], incomplete: tuple[str, ...], expected: tuple[str, ...]) -> DataFrame:
    """(keys, status, duration, statuses, schedule) of the requested horizon, whatever was decoded.

    cases has (keys, timestamps array, fps, events map of name to frame, pairs map of name to struct(first,
    revisit) of event names); curves has (keys, metric, status), and a metric of `expected` without a row is not_available. The first
    status of `incomplete` that a curve has is the record's, else ok if all are, else
    not_covered. Timestamps must ascend from 0 and be two at least, and fps be over 0: else
    the status is invalid_input and the rest null. schedule has of each pair its two times and the time between; a pair of unknown events has nulls.
    """
    t = F.col("timestamps")
    last = F.size(t) - 1
    steps = F.forall(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.coalesce(F.get(t, i) > F.get(t, i - 1), F.lit(False)))
    sound = (last >= 1) & (F.get(t, F.lit(0)) == 0) & steps & F.forall(t, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & (F.col("fps") > 0) & (F.col("fps") < float("inf"))
    at = lambda event: F.get(t, F.element_at("events", event).cast("int"))
    schedule = F.transform_values("pairs", lambda _, p: F.struct(at(p["first"]).alias("first_time"), at(p["revisit"]).alias("revisit_time"), (at(p["revisit"]) - at(p["first"])).alias("interval")))
    known = curves.where(F.col("metric").isin(*expected)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", "status"))).alias("_by"))
    status_of = lambda m: F.coalesce(F.element_at("_by", F.lit(m)), F.lit("not_available"))
    statuses = F.create_map(*[x for m in expected for x in (F.lit(m), status_of(m))])
    every = F.map_values("statuses")
    status = F.when(F.forall(every, lambda s: s == "ok"), "ok").otherwise("not_covered")
    for s in reversed(incomplete):
        status = F.when(F.array_contains(every, s), s).otherwise(status)
    out = cases.join(known, keys, "left").withColumn("statuses", statuses).withColumn("_sound", F.coalesce(sound, F.lit(False)))
    kept = {"duration": F.get(t, last), "statuses": F.col("statuses"), "schedule": schedule}
    return out.select(*keys, F.when(F.col("_sound"), status).otherwise("invalid_input").alias("status"), *[F.when(F.col("_sound"), v).alias(n) for n, v in kept.items()])
