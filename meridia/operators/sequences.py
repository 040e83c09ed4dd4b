"""Ordered series: differences, runs, votes, stateful plans and alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_length(track: DataFrame, keys: list[str], index: str, coordinates: list[str]) -> DataFrame:
    """track with step (distance from the row before, 0 for the first) and travelled (their running sum)."""
    w = Window.partitionBy(*keys).orderBy(index)
    square = sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in coordinates), F.lit(0.0))
    stepped = track.withColumn("step", F.coalesce(F.sqrt(square), F.lit(0.0)))
    return stepped.withColumn("travelled", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def axes_dynamics(track: DataFrame, keys: list[str], index: str, positions: list[str], dt: float) -> DataFrame:
    """(keys, of each position its _speed, _acceleration and _jerk at the largest) from first, second and third differences, in one pass over the track."""
    w = Window.partitionBy(*keys).orderBy(index)
    steps, largest = [], []
    for p in positions:
        x = [F.lag(p, i).over(w) if i else F.col(p) for i in range(4)]
        differences = {"speed": (x[0] - x[1]) / dt, "acceleration": (x[0] - 2 * x[1] + x[2]) / dt**2, "jerk": (x[0] - 3 * x[1] + 3 * x[2] - x[3]) / dt**3}
        steps += [d.alias(f"{p}_{n}") for n, d in differences.items()]
        largest += [F.max(F.abs(f"{p}_{n}")).alias(f"{p}_{n}") for n in differences]
    return track.select(*keys, *steps).groupBy(*keys).agg(*largest)


def dynamics(track: DataFrame, keys: list[str], index: str, position: str, dt: float) -> DataFrame:
    """(keys, largest speed, acceleration, jerk) of one coordinate."""
    return axes_dynamics(track, keys, index, [position], dt).toDF(*keys, "speed", "acceleration", "jerk")


def runs(series: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """(keys, run, label, first, last, length): maximal runs of one label; first and last are the leading order column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = series.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length"))


def vote_keys(moves: DataFrame, keys: list[str], axes: dict[str, tuple[str, str]], coordinates: tuple[str, ...], threshold: float = 0.5) -> DataFrame:
    """(keys, pressed): the keys that a window's moves vote for.

    Each move counts by its direction alone: for an axis's first key if the unit vector
    reaches beyond threshold along it, for the second if beyond threshold against it. A
    key is pressed if its votes less the other's are more than half the moves. axes gives
    the two keys of a coordinate; a move's length is that of all its coordinates, those without keys too.
    """
    norm = F.greatest(F.sqrt(sum((F.col(c) * F.col(c) for c in coordinates), F.lit(0.0))), F.lit(1e-12))
    votes = [(F.count_if(F.col(c) / norm > threshold) - F.count_if(F.col(c) / norm < -threshold)).alias(f"_{c}") for c in axes]
    counted = moves.groupBy(*keys).agg(F.count("*").alias("_n"), *votes)
    won = [F.when(2 * F.col(f"_{c}") > F.col("_n"), F.lit(a)).when(2 * F.col(f"_{c}") < -F.col("_n"), F.lit(b)) for c, (a, b) in axes.items()]
    return counted.select(*keys, F.array_compact(F.array(*won)).alias("pressed"))


def merge_short_runs(runs_: DataFrame, group: str, least: int) -> DataFrame:
    """(group, run, label, length): the shortest run joins its longer neighbour until all have `least` or one is left.

    Each merge depends on the one before, so a group's runs are merged in one task; they
    are the runs of one clip. Ties: the first shortest run, and the earlier neighbour.
    """
    kinds = {f.name: f.dataType.simpleString() for f in runs_.schema.fields}

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run")
        items = [[a, int(b)] for a, b in zip(frame["label"], frame["length"], strict=True)]
        while len(items) > 1 and min(n for _, n in items) < least:
            i = min(range(len(items)), key=lambda k: (items[k][1], k))
            near = [k for k in (i - 1, i + 1) if 0 <= k < len(items)]
            j = max(near, key=lambda k: (items[k][1], -k))
            items[j][1] += items[i][1]
            del items[i]
            joined = []
            for label, n in items:
                if joined and joined[-1][0] == label:
                    joined[-1][1] += n
                else:
                    joined.append([label, n])
            items = joined
        return pd.DataFrame({group: frame[group].iloc[0], "run": range(1, len(items) + 1), "label": [a for a, _ in items], "length": [n for _, n in items]})

    return runs_.select(group, "run", "label", "length").groupBy(group).applyInPandas(merge, f"{group} {kinds[group]}, run long, label {kinds['label']}, length long")


def block_actions(track: DataFrame, group: str, index: str, value: str, step: float, block: int) -> DataFrame:
    """(group, block, action, debt): per block the number of whole steps that follow the track, errors carried on.

    action is what must be done in the block to keep up, in steps, towards zero; what is
    left over goes into the next block's debt. The carry makes it sequential: whole blocks
    are summed by Spark first, and only one row a block meets in a group's task.
    """
    w = Window.partitionBy(group).orderBy(index)
    moved = track.select(group, F.floor(F.col(index) / block).cast("long").alias("block"), (F.col(value) - F.lag(value).over(w)).alias("d"))
    blocks = moved.groupBy(group, "block").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("move"))
    kind = blocks.schema[group].dataType.simpleString()

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        debt, actions, debts = 0.0, [], []
        for move in frame["move"]:
            debt += move
            n = int(np.trunc(debt / step))
            debt -= n * step
            actions.append(n)
            debts.append(debt)
        return pd.DataFrame({group: frame[group], "block": frame["block"], "action": actions, "debt": debts})

    return blocks.groupBy(group).applyInPandas(plan, f"{group} {kind}, block long, action long, debt double")


def positive_scale(pairs: DataFrame, keys: list[str], executed: list[str], requested: list[str]) -> DataFrame:
    """(keys, scale): least-squares scale of executed onto requested, at least 0, and 1 where nothing was executed."""
    xy = sum((F.col(e) * F.col(r) for e, r in zip(executed, requested, strict=True)), F.lit(0.0))
    xx = sum((F.col(e) * F.col(e) for e in executed), F.lit(0.0))
    return pairs.groupBy(*keys).agg(F.sum(xy).alias("xy"), F.sum(xx).alias("xx")).select(*keys, F.when(F.col("xx") > 1e-12, F.greatest(F.lit(0.0), F.col("xy") / F.col("xx"))).otherwise(1.0).alias("scale"))


def align(pairs: DataFrame, keys: list[str], source: list[str], target: list[str], scaled: bool = True) -> DataFrame:
    """(keys, n, scale, rotation, translation): the similarity that brings source points closest to target points.

    Means and the 3x3 covariance are aggregated by Spark; only those 16 numbers a key go
    through NumPy, in Arrow batches, for the singular values.
    """
    product = {f"c{i}{j}": F.covar_pop(t, s) for i, t in enumerate(target) for j, s in enumerate(source)}
    means = {f"s{i}": F.avg(c) for i, c in enumerate(source)} | {f"t{i}": F.avg(c) for i, c in enumerate(target)}
    spread = sum((F.var_pop(c) for c in source), F.lit(0.0))
    moments = pairs.groupBy(*keys).agg(F.count("*").alias("n"), spread.alias("spread"), *[v.alias(k) for k, v in (product | means).items()])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cov = f[[f"c{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3)
            u, d, vt = np.linalg.svd(cov)
            sign = np.ones((len(f), 3))
            sign[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
            rotation = (u * sign[:, None, :]) @ vt
            spread = f["spread"].to_numpy()
            scale = np.where(spread > 1e-12, (d * sign).sum(axis=1) / np.maximum(spread, 1e-12), 1.0) if scaled else np.ones(len(f))
            s, t = (f[[f"{p}{i}" for i in range(3)]].to_numpy() for p in "st")
            moved = t - scale[:, None] * (rotation @ s[:, :, None])[:, :, 0]
            yield f[keys].assign(n=f["n"], scale=scale, rotation=list(rotation.reshape(-1, 9)), translation=list(moved))

    kinds = ", ".join(f"{k} {moments.schema[k].dataType.simpleString()}" for k in keys)
    return moments.mapInPandas(solve, f"{kinds}, n long, scale double, rotation array<double>, translation array<double>")


def unwrapped(track: DataFrame, keys: list[str], index: str, angle: str) -> DataFrame:
    """track with the angle in degrees made continuous: whole turns are added where it jumps by more than half of one."""
    w = Window.partitionBy(*keys).orderBy(index)
    jump = F.coalesce(F.col(angle) - F.lag(angle).over(w), F.lit(0.0))
    turned = track.withColumn("_turns", -F.rint(jump / 360.0))
    return turned.withColumn("unwrapped", F.col(angle) + 360.0 * F.sum("_turns").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_turns")


def yaw_of(x: Column, z: Column) -> Column:
    """Heading in degrees of a direction on the ground."""
    return F.degrees(F.atan2(x, z))
