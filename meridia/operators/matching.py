"""Joins that Spark lacks: nearest, interpolating, lagged, radius and reciprocal."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.vectors import slerp


def asof_interpolate(queries: DataFrame, track: DataFrame, keys: list[str], time: str, values: list[str], rotation: list[str] | None = None) -> DataFrame:
    """(keys, time, values, rotation) of the track at the queries' times; null outside its range.

    Values are interpolated linearly, a rotation, given as the columns of a quaternion,
    along the shorter arc. Queries and track are laid into windows sorted by key and time,
    one in each direction and each read once, where a query sees the track rows around
    it; there is no range join. A query at a track row's time takes that row's values.
    """
    rotation = rotation or []
    point = F.struct(F.col(time).alias("t"), *[F.col(v) for v in (*values, *rotation)])
    rows = track.select(*keys, time, point.alias("p"), F.lit(0).alias("q"))
    rows = rows.unionByName(queries.select(*keys, time).distinct().withColumns({"p": F.lit(None).cast(rows.schema["p"].dataType), "q": F.lit(1)}))
    upto = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.last("p", ignorenulls=True).over(upto(time, "q"))
    after = F.last("p", ignorenulls=True).over(upto(F.desc(time), F.desc("q")))
    found = rows.withColumns({"a": before, "b": after}).where("q = 1")
    here = F.col(time) == F.col("a.t")
    share = F.try_divide(F.col(time) - F.col("a.t"), F.col("b.t") - F.col("a.t"))
    value = lambda v: F.when(here, F.col(f"a.{v}")).otherwise(F.col(f"a.{v}") + share * (F.col(f"b.{v}") - F.col(f"a.{v}")))
    if rotation:
        found = found.withColumn("_turned", slerp([F.col(f"a.{r}") for r in rotation], [F.col(f"b.{r}") for r in rotation], share))
    turned = [F.when(here, F.col(f"a.{r}")).otherwise(F.get("_turned", F.lit(i))).alias(r) for i, r in enumerate(rotation)]
    return found.select(*keys, time, *[value(v).alias(v) for v in values], *turned)


def timestamp_to_frame(time: Column, fps: float, frames: Column) -> Column:
    """Nearest frame of a time, halves to even; null beyond the last frame's time by more than 0.51 frames."""
    at = F.rint(time * fps)
    inside = (time >= -0.51 / fps) & (time <= (frames - 1) / fps + 0.51 / fps)
    return F.when(inside, F.greatest(F.lit(0), F.least(at, frames - 1)).cast("long"))


def lag_join(series: DataFrame, keys: list[str], index: str, delta: int, values: list[str]) -> DataFrame:
    """(keys, index, values, values_next): each row with the row at index + delta, where there is one."""
    later = series.select(*keys, (F.col(index) - delta).alias(index), *[F.col(v).alias(f"{v}_next") for v in values])
    return series.select(*keys, index, *values).join(later, [*keys, index])


def with_reasons(base: DataFrame, sides: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """base with an array `reasons` that names each side without a row for it. Sides are made distinct on the key first."""
    out = base
    for name, side in sides.items():
        out = out.join(side.select(*on).distinct().withColumn(f"_{name}", F.lit(True)), on, "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{name}").isNull(), F.lit(f"missing_{name}")) for name in sides]))
    return out.withColumn("reasons", missing).drop(*[f"_{name}" for name in sides])


def _neighbours(cells: list[str]) -> Column:
    """All cells around one, itself included."""
    steps = [F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(cells, offset, strict=True)]) for offset in product((-1, 0, 1), repeat=len(cells))]
    return F.explode(F.array(*steps))


def within_radius(left: DataFrame, right: DataFrame, coordinates: list[str], radius: float, left_id: str, right_id: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, left_id, right_id, distance) of all pairs of a key within radius, through a grid of that width.

    The left side visits its neighbouring cells; the right side is dealt once. Points that
    share a cell meet in a join that adaptive execution can split.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    cells = [f"_{c}" for c in coordinates]
    a = left.select(*keys, F.col(left_id).alias("left_id"), *[F.col(c).alias(f"l_{c}") for c in coordinates], *[cell(c).alias(f"_{c}") for c in coordinates])
    a = a.withColumn("n", _neighbours(cells)).select(*keys, "left_id", *[f"l_{c}" for c in coordinates], "n.*")
    b = right.select(*keys, F.col(right_id).alias("right_id"), *[F.col(c).alias(f"r_{c}") for c in coordinates], *[cell(c).alias(f"_{c}") for c in coordinates])
    square = sum(((F.col(f"l_{c}") - F.col(f"r_{c}")) * (F.col(f"l_{c}") - F.col(f"r_{c}")) for c in coordinates), F.lit(0.0))
    return a.join(b, [*keys, *cells]).withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius).select(*keys, "left_id", "right_id", "distance")


def beyond_radius(left: DataFrame, right: DataFrame, cells: list[str], reach: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The left cells with no right cell of their key within `reach` cells along every axis."""
    wide = right.select(*keys, *cells).distinct()
    steps = F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(cells, offset, strict=True)]) for offset in product(range(-reach, reach + 1), repeat=len(cells))])
    covered = wide.select(*keys, F.explode(steps).alias("n")).select(*keys, "n.*").distinct()
    return left.join(covered, [*keys, *cells], "left_anti")


def mutual_matches(pairs: DataFrame, a: str, b: str, distance: str, ratio: float) -> DataFrame:
    """(a, b, distance): pairs nearest to one another both ways, each nearest clearly nearer than the second by ratio; one without a second is no match."""

    def best(one: str, other: str) -> DataFrame:
        w = Window.partitionBy(one).orderBy(distance, other)
        ordered = pairs.withColumns({"_rank": F.row_number().over(w), "_second": F.lead(distance).over(w)})
        return ordered.where((F.col("_rank") == 1) & (F.col(distance) < ratio * F.col("_second"))).select(a, b, distance)

    return best(a, b).join(best(b, a).select(a, b), [a, b])


def greedy_matches(pairs: DataFrame, group: str, a: str, b: str, score: str) -> DataFrame:
    """(group, a, b, score): one-to-one matches, the best score first, within each group.

    The choice depends on all before it, so a group is matched in one task in Arrow; a
    group holds the candidates of one view pair. Ties go to the smaller a, then b.
    """
    import numpy as np
    import pyarrow as pa

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def match(table: pa.Table) -> pa.Table:
        rank = np.lexsort((table.column(b).to_numpy(), table.column(a).to_numpy(), -table.column(score).to_numpy()))
        left, right = table.column(a).to_pylist(), table.column(b).to_pylist()
        used_a, used_b, kept = set(), set(), []
        for i in rank.tolist():
            if left[i] not in used_a and right[i] not in used_b:
                used_a.add(left[i])
                used_b.add(right[i])
                kept.append(i)
        return table.take(pa.array(kept, pa.int64()))

    schema = ", ".join(f"{c} {kinds[c]}" for c in (group, a, b, score))
    return pairs.select(group, a, b, score).groupBy(group).applyInArrow(match, schema)


def nearest_pose(left: DataFrame, right: DataFrame, keys: list[str], coordinates: list[str], angle: str, index: str, weight: float) -> DataFrame:
    """(keys, index, nearest, cost): for each left row the right row of its key, other than itself, with the least distance + weight * angle; ties to the smaller index.

    A key is one video. Its right rows travel as one array to its left rows, each of which
    looks through it, so pairs are never rows and nothing but the two sides is shuffled.
    """
    names = (*coordinates, angle)
    listed = right.groupBy(*keys).agg(F.collect_list(F.struct(F.col(index).alias("i"), *[F.col(c).cast("double").alias(c) for c in names])).alias("_all"))
    square = lambda r: sum(((F.col(c) - r[c]) * (F.col(c) - r[c]) for c in coordinates), F.lit(0.0))
    cost = lambda r: F.round(F.sqrt(square(r)) + weight * F.abs(F.col(angle) - r[angle]), 9)
    best = F.array_min(F.transform(F.filter("_all", lambda r: r["i"] != F.col(index)), lambda r: F.struct(cost(r).alias("cost"), r["i"].alias("nearest"))))
    paired = left.select(*keys, index, *names).join(listed, keys).select(*keys, index, best.alias("m"))
    return paired.where(F.col("m").isNotNull()).select(*keys, index, "m.nearest", "m.cost")
