"""Deterministic samples, schedules, splits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linspace(n: Column, m: int) -> Column:
    """Positions of m of n rows, evenly spread from the first to the last, cut to integers; all n if there are no more than m."""
    few = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    if m == 1:
        many = F.array(F.lit(0).cast("long"))
    else:
        many = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.floor(k * ((n - 1).cast("double") / (m - 1)) + F.lit(0.0)).cast("long"))
        many = F.concat(F.slice(many, 1, m - 1), F.array(n.cast("long") - 1))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= m, few).otherwise(many)


def subsample(rows: DataFrame, keys: list[str], order: list[str], m: int) -> DataFrame:
    """At most m rows of each key by linspace over its order; order must tell rows apart."""
    w = Window.partitionBy(*keys)
    at = (F.row_number().over(w.orderBy(*order)) - 1).cast("long")
    numbered = rows.withColumns({"_at": at, "_n": F.count("*").over(w)})
    return numbered.where(F.array_contains(linspace(F.col("_n"), m), F.col("_at"))).drop("_at", "_n")


def nearest_after(points: DataFrame, keys: list[str], index: str, delta: int) -> DataFrame:
    """(keys, left, right): for each index the later one nearest to index + delta, of two the earlier.

    An index whose target is beyond the key's last has no pair. Both neighbours of the
    target come from two sorted windows over points and targets, each read once, not from a range join.
    """
    of = [F.col(k) for k in keys]
    pool = points.select(*of, F.col(index).cast("long").alias("i")).distinct()
    last = F.max("i").over(Window.partitionBy(*keys))
    rows = pool.withColumn("last", last)
    # Targets sort behind the point at the same index, so that this point is found below as well.
    both = rows.select(*of, F.col("i").alias("at"), F.lit(0).alias("target"), F.col("i").alias("point"), F.lit(None).cast("long").alias("left"))
    both = both.unionByName(rows.where(F.col("i") + delta <= F.col("last")).select(*of, (F.col("i") + delta).alias("at"), F.lit(1).alias("target"), F.lit(None).cast("long").alias("point"), F.col("i").alias("left")))
    w = Window.partitionBy(*keys)
    upto = lambda *order: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.last("point", ignorenulls=True).over(upto("at", "target"))
    above = F.last("point", ignorenulls=True).over(upto(F.desc("at"), F.desc("target")))
    found = both.withColumns({"below": below, "above": above}).where("target = 1")
    near = F.when((F.col("below") > F.col("left")) & (F.col("above").isNull() | (F.col("at") - F.col("below") <= F.col("above") - F.col("at"))), F.col("below")).otherwise(F.col("above"))
    return found.select(*of, "left", near.alias("right"))


def pair_schedule(points: DataFrame, keys: list[str], index: str, plans: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, baseline, source, target): each plan's (delta, most) pairs, spread evenly and in both directions."""
    out = None
    for name, (delta, most) in plans.items():
        base = subsample(nearest_after(points, keys, index, delta), keys, ["left", "right"], most).withColumn("baseline", F.lit(name))
        both = base.withColumn("p", F.explode(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("target")), F.struct(F.col("right").alias("source"), F.col("left").alias("target")))))
        both = both.select(*keys, "baseline", "p.source", "p.target")
        out = both if out is None else out.unionByName(both)
    return out


def context_heldout(n: Column, context: int, heldout: int) -> Column:
    """Struct (heldout, context) of frame positions of n frames: held-out ones evenly inside, then context
    ones evenly over what is left, ends included; halves round to even. Null with too few frames."""
    held = F.transform(F.sequence(F.lit(0), F.lit(heldout - 1)), lambda i: F.rint((i + 0.5) * (n - 1) / heldout).cast("long"))
    left = F.array_except(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), held)
    kept = F.transform(F.sequence(F.lit(0), F.lit(context - 1)), lambda i: F.get(left, F.rint(i * (F.size(left) - 1) / (context - 1)).cast("int")))
    return F.when(n >= context + heldout, F.struct(held.alias("heldout"), kept.alias("context")))


def plan_with_reasons(picks: list[tuple[str, DataFrame]], keys: list[str], index: str) -> DataFrame:
    """(keys, index, reasons): all picked indices with the sorted reasons why."""
    out = None
    for reason, df in picks:
        one = df.select(*keys, F.col(index).cast("long").alias(index), F.lit(reason).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys, index).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def quarters(start: Column, end: Column) -> Column:
    """Distinct positions at a quarter, half, three quarters and the end of start..end, halves up, all after start; null unless end lies after start."""
    at = F.transform(F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 1.0)]), lambda q: F.least(end, F.greatest(start + 1, F.floor(start + q * (end - start) + 0.5))).cast("long"))
    return F.when(end > start, F.array_sort(F.array_distinct(at)))


def overlapping_windows(n: Column, size: int, overlap: int) -> Column:
    """(start, stop) of windows of `size` over n frames, each sharing `overlap` with the one before; the last may reach beyond n."""
    if size <= overlap:
        raise ValueError("windows must be larger than what they share")
    step = size - overlap
    more = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), more), lambda i: F.struct((i * step).alias("start"), (i * step + size).alias("stop")))


def top_k(rows: DataFrame, keys: list[str], score: Column, ties: list[str], k: int) -> DataFrame:
    """The k rows of each key with the largest score; ties by the given columns. Rank filters let Spark keep k rows a task first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc_nulls_last(), *ties))
    return rows.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def apportion(parts: DataFrame, keys: list[str], name: str, weight: str, total: int, least: Column | int = 0) -> DataFrame:
    """(keys, name, share): `least` to each part, what is left of total by weight, whole parts first, then the largest remainders.

    Keys whose total is under the sum of what is least have null shares.
    """
    w = Window.partitionBy(*keys)
    rows = parts.withColumn("least", F.lit(least) if isinstance(least, int) else least)
    rows = rows.withColumn("left", F.lit(total) - F.sum("least").over(w))
    rows = rows.withColumn("exact", F.when(F.col("left") >= 0, F.col(weight) / F.sum(weight).over(w) * F.col("left"))).withColumns({"whole": F.floor("exact"), "rest": F.col("exact") - F.floor("exact")})
    rows = rows.withColumn("missing", F.col("left") - F.sum("whole").over(w))
    place = F.row_number().over(w.orderBy(F.round("rest", 9).desc(), name))
    return rows.select(*keys, name, (F.col("least") + F.col("whole") + F.when(place <= F.col("missing"), 1).otherwise(0)).cast("long").alias("share"))
