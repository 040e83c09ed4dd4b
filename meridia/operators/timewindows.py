"""Tail-anchored time windows, changes between them and retention."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.numeric import finite


def window_bounds(duration: Column, size: float = 5.0) -> Column:
    """Array of (window, start, stop): starts at multiples of size, and one at duration - size if none is there."""
    last = F.greatest(duration - size, F.lit(0.0))
    n = F.floor((last + 1e-9) / size).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n), lambda i: i * F.lit(size))
    tail = F.when(F.abs(n * size - last) > 1e-8 + 1e-5 * last, F.array_append(starts, last)).otherwise(starts)
    return F.transform(tail, lambda s, i: F.struct(i.alias("window"), s.alias("start"), F.least(s + size, duration).alias("stop"), (i == F.size(tail) - 1).alias("tail")))


def in_windows(samples: DataFrame, time: str, duration: float, size: float = 5.0) -> DataFrame:
    """samples with the window of each; a sample in an overlap has a row for both, one in none has no row.

    Windows are half open; the last is closed, to 1e-8. A sample finds its windows by
    arithmetic (the regular one by division, the tail by comparison), so there is no join.
    """
    t = F.col(time)
    held = F.filter(window_bounds(F.lit(float(duration)), size), lambda w: (t >= w["start"]) & F.when(w["tail"], t <= w["stop"] + 1e-8).otherwise(t < w["stop"]))
    return samples.withColumn("w", F.explode(held)).select(*samples.columns, "w.window", "w.start", "w.stop")


def window_means(samples: DataFrame, keys: list[str], time: str, value: str, duration: float, size: float = 5.0) -> DataFrame:
    """(keys, window, start, stop, mean) for every window of every key; null where it has no finite sample."""
    means = in_windows(samples, time, duration, size).groupBy(*keys, "window").agg(F.avg(finite(F.col(value))).alias("mean"))
    frame = samples.select(*keys).distinct().withColumn("w", F.explode(window_bounds(F.lit(float(duration)), size))).select(*keys, "w.window", "w.start", "w.stop")
    return frame.join(means, [*keys, "window"], "left")


def window_changes(means: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """means with from_first and from_previous, turned by sign; from_previous is null after a gap."""
    w = Window.partitionBy(*keys).orderBy("window")
    first = F.first("mean").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return means.withColumns({"from_first": sign * (first - F.col("mean")), "from_previous": sign * (F.lag("mean").over(w) - F.col("mean"))})


def retention(means: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, retention): mean of the windows, and 100 less the mean drop below the first.

    Both are null with fewer than two windows, a null first or no later mean.
    """
    w = Window.partitionBy(*keys)
    marked = means.withColumn("first_mean", F.max(F.when(F.col("window") == 0, F.col("mean"))).over(w))
    later = F.when(F.col("window") > 0, F.greatest(F.lit(0.0), F.col("first_mean") - F.col("mean")))
    later = F.when(F.col("mean").isNotNull() & F.col("first_mean").isNotNull(), later)
    out = marked.groupBy(*keys).agg(F.count("*").alias("n"), F.max("first_mean").alias("first_mean"), F.avg("mean").alias("level"), F.avg(later).alias("drop"))
    valid = (F.col("n") >= 2) & F.col("first_mean").isNotNull() & F.col("drop").isNotNull()
    return out.select(*keys, F.when(valid, F.col("level")).alias("level"), F.when(valid, 100 - F.col("drop")).alias("retention"))


def dimension_retention(retained: DataFrame, keys: list[str], indicator: str, dimensions: Mapping[str, tuple[str, ...]], pairs: Mapping[str, tuple[str, ...]], level: float = 0.3, kept: float = 0.7, only: Column | None = None, without: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(keys, dimensions, score) of (keys, indicator, level, retention) rows, one an indicator.

    An indicator of `pairs` is the mean of its own parts, and a dimension the mean of its
    indicators, of level and of retention apart; missing or null ones are left out, and without
    any the whole is missing. `dimensions` maps each name to (level, retention) or null. score is the
    mean over the dimensions of level * their level + kept * their retention, null if
    one is missing. Where the condition `only` on the keys holds, dimensions take their indicators from `without` if it names them.
    """
    part = F.struct(F.col("level").alias("level"), F.col("retention").alias("retention"))
    known = F.when(F.col("level").isNotNull() & F.col("retention").isNotNull(), F.struct(F.col(indicator).alias("key"), part.alias("value")))
    by = retained.groupBy(*keys).agg(F.map_from_entries(F.collect_list(known)).alias("_by"))

    def combined(parts: list[Column]) -> Column:
        held = F.array_compact(F.array(*parts))
        mean = lambda f: F.aggregate(held, F.lit(0.0), lambda a, x: a + x[f]) / F.size(held)
        return F.when(F.size(held) > 0, F.struct(mean("level").alias("level"), mean("retention").alias("retention")))

    def of(name: str) -> Column:
        return combined([of(x) for x in pairs[name]]) if name in pairs else F.element_at("_by", F.lit(name))

    made = {n: combined([of(x) for x in names]) for n, names in dimensions.items()}
    for n, names in (without or {}).items():
        made[n] = F.when(only, combined([of(x) for x in names])).otherwise(made[n])
    out = by.select(*keys, F.struct(*[v.alias(n) for n, v in made.items()]).alias("dimensions"))
    total, whole = F.lit(0.0), F.lit(True)
    for n in made:
        d = F.col(f"dimensions.{n}")
        total, whole = total + level * d["level"] + kept * d["retention"], whole & d.isNotNull()
    return out.withColumn("score", F.when(whole, total / len(made)))


def sessions(samples: DataFrame, keys: list[str], time: str, gap: str, value: str) -> DataFrame:
    """(keys, start, stop, n, mean) of sessions: samples of a key at most `gap` after the one before are one; stop is the last sample's time and the gap.

    On a stream with a watermark the same expression keeps its sessions as state.
    """
    w = F.session_window(time, gap)
    out = samples.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.avg(finite(F.col(value))).alias("mean"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "mean")
