"""Pairs of frames and views: enumeration, mirroring, overlap and set checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_pairs(frames: DataFrame, keys: list[str], index: str, least: int, most: int, carry: list[str]) -> DataFrame:
    """(keys, i, j, carried, carried_next): pairs of rows of a key whose indices are least to most apart.

    Each row is dealt to the blocks of `most` + 1 indices that its partners can be in, so the
    join is by equality and grows with the pairs it returns.
    """
    block = most + 1
    a = frames.select(*keys, F.col(index).alias("i"), *carry, F.explode(F.array(F.floor(F.col(index) / block), F.floor(F.col(index) / block) + 1)).alias("_b"))
    b = frames.select(*keys, F.col(index).alias("j"), *[F.col(c).alias(f"{c}_next") for c in carry], F.floor(F.col(index) / block).alias("_b"))
    return a.join(b, [*keys, "_b"]).where((F.col("j") - F.col("i")).between(least, most)).drop("_b")


def mirrored(turn: Column, end: Column) -> Column:
    """Array of (first, revisit): frames before a turn with their mirror image behind it, each pair once."""
    firsts = F.sequence(turn - 1, F.lit(1), F.lit(-1))
    pairs = F.transform(firsts, lambda f: F.struct(f.alias("first"), (turn + F.rint((turn - f) / turn * (end - turn))).cast("int").alias("revisit")))
    return F.filter(F.array_distinct(pairs), lambda p: (p["revisit"] > turn) & (p["revisit"] < end))


def overlap_share(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, n, shared, share): how many of a key's left rows have an item that its right rows have too."""
    known = right.select(*keys, item).distinct().withColumn("_in", F.lit(1))
    return left.join(known, [*keys, item], "left").groupBy(*keys).agg(F.count("*").alias("n"), F.count("_in").alias("shared")).withColumn("share", F.col("shared") / F.col("n"))


def either_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, columns: list[tuple[str, str]]) -> DataFrame:
    """(left_id, right_id) of rows that agree on any of the column pairs, each pair of ids once.

    A pair is taken from the first column pair it agrees on, by the least of the values
    that it has in common there, so the results of the equality joins are apart and
    nothing has to hold them to be made distinct.
    """
    places = range(len(columns))
    sets = lambda side, id_, n: side.groupBy(id_).agg(*[F.collect_set(c[n]).alias(f"_{'lr'[n]}{i}") for i, c in enumerate(columns)])
    a, b = sets(left, left_id, 0).where(F.col(left_id).isNotNull()), sets(right, right_id, 1).where(F.col(right_id).isNotNull())
    out = None
    for i in places:
        one = a.withColumn("_k", F.explode(f"_l{i}")).join(b.withColumn("_k", F.explode(f"_r{i}")), "_k")
        least = ((F.size(f"_l{i}") == 1) | (F.size(f"_r{i}") == 1)) | (F.col("_k") == F.array_min(F.array_intersect(f"_l{i}", f"_r{i}")))
        earlier = [~F.arrays_overlap(f"_l{n}", f"_r{n}") for n in places[:i]]
        for keep in (least, *earlier):
            one = one.where(keep)
        one = one.select(left_id, right_id)
        out = one if out is None else out.unionByName(one)
    return out


def set_equality(expected: DataFrame, actual: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, expected, actual, shared, complete): whether both sides hold the same indices."""
    e = expected.select(*keys, index).distinct().withColumn("_e", F.lit(1))
    a = actual.select(*keys, index).distinct().withColumn("_a", F.lit(1))
    both = F.count(F.when(F.col("_e").isNotNull() & F.col("_a").isNotNull(), 1))
    out = e.join(a, [*keys, index], "full_outer").groupBy(*keys).agg(F.count("_e").alias("expected"), F.count("_a").alias("actual"), both.alias("shared"))
    return out.withColumn("complete", (F.col("expected") == F.col("shared")) & (F.col("actual") == F.col("shared")))


def triplets(n: Column, stride: int) -> Column:
    """Starts of three frames in a row, every stride-th."""
    return F.when(n >= 3, F.sequence(F.lit(0), (n - 3).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def strided_with_ends(a: Column, b: Column, stride: int) -> Column:
    """Indices from a to b, every stride-th, and both ends; none where b lies before a or one is missing."""
    return F.when(a.isNotNull() & b.isNotNull() & (b >= a), F.array_sort(F.array_union(F.sequence(a, b, F.lit(stride)), F.array(a, b)))).otherwise(F.array().cast("array<bigint>"))


def attempts(rows: DataFrame, keys: list[str], order: str, passed: Column) -> DataFrame:
    """(keys, tried, chosen): the first attempt that passes, or null, and how many there were."""
    return rows.groupBy(*keys).agg(F.count("*").alias("tried"), F.min(F.when(passed, F.col(order))).alias("chosen"))


def spaced(rows: DataFrame, keys: list[str], index: str, width: int, most: int = 5) -> DataFrame:
    """(keys, index, place): at most `most` of a key's rows from the last one down, each the largest index at least `width` below the one before.

    The indices of a key, the frames of one video, are folded as one sorted array in a single pass.
    """
    kind = dict(rows.dtypes)[index]
    fits = lambda acc, i: (F.size(acc) < most) & ((F.size(acc) == 0) | (i <= F.element_at(F.concat(acc, F.array(i)), F.greatest(F.size(acc), F.lit(1))) - width))
    step = lambda acc, i: F.when(fits(acc, i), F.array_append(acc, i)).otherwise(acc)
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(index), asc=False).alias("_all"))
    chosen = F.aggregate("_all", F.array().cast(f"array<{kind}>"), step)
    return listed.select(*keys, F.posexplode(chosen).alias("_at", index)).select(*keys, index, (F.col("_at") + 1).alias("place"))


def latest_passing(rows: DataFrame, keys: list[str], index: str, passes: Callable[[DataFrame], DataFrame], stride: int = 4) -> DataFrame:
    """(keys, index): the largest index of each key whose row passes, found coarsely and then finely.

    Every stride-th row from the last one down is tested; the rows between the latest
    that passes and the tested one above it are tested next, and the latest of both is taken. passes keeps the
    rows that pass of those it is given, so a dear test runs on few. A key where no coarse row passes has no row.
    """
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(index))) - 1)
    coarse = passes(numbered.where(F.col("_n") % stride == 0)).groupBy(*keys).agg(F.min("_n").alias("_best"), F.max(index).alias("_coarse"))
    between = numbered.where(F.col("_n") % stride != 0).join(coarse, keys).where((F.col("_n") < F.col("_best")) & (F.col("_n") > F.col("_best") - stride))
    fine = passes(between.drop("_best", "_coarse")).groupBy(*keys).agg(F.max(index).alias("_fine"))
    return coarse.join(fine, keys, "left").select(*keys, F.coalesce("_fine", "_coarse").alias(index))


def slerp_yaw(a: Column, b: Column, share: Column) -> Column:
    """Heading in degrees between two, the short way round."""
    gap = F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0
    return F.pmod(a + share * gap + 180.0, F.lit(360.0)) - 180.0


def srgb(linear: Column) -> Column:
    """Display value 0..1 of a linear light value; values outside are held to the ends."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), linear))
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
