"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._shared import checkpointed, give_back, release

#: Edges that a task contracts at once.
_EDGES = 1 << 20


def joined(label: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The labels of rows, each the least row of its component, once the pairs are joined too."""
    while len(xs):
        least = np.minimum(label[xs], label[ys])
        np.minimum.at(label, label[xs], least)
        np.minimum.at(label, label[ys], least)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[xs] != label[ys]
        xs, ys = xs[open_], ys[open_]
    return label


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge of longs; component is the smallest node reachable.

    Every task first contracts the edges that it holds to stars of their least nodes.
    Large-star and small-star steps then alternate until all edges are stars; the
    number of rounds grows with the logarithm of the longest path. A hot node only
    ever meets its partial minimum: minima come from a pre-aggregated groupBy and are
    joined back, and that join can be split by adaptive execution. Edges with a null
    end and loops are dropped; an empty table has no components.
    """
    e = checkpointed(_contracted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u <> v")))
    while not _are_stars(e):
        e = checkpointed(_small_star(_large_star(e)))
        release(e.sparkSession)
    members = e.groupBy("u").agg(F.min("v").alias("component"))
    return members.select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(e: DataFrame) -> bool:
    """Whether no node has two different lesser ends, and none with a lesser end is one itself."""
    ends = e.select(F.col("u").alias("node"), "v").union(e.select(F.col("v").alias("node"), F.col("v")))
    return ends.groupBy("node").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").isEmpty()


def _contracted(e: DataFrame) -> DataFrame:
    """The edges of each task as stars: every node with the least one that it is connected to there. No row moves."""

    def stars(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = joined(np.arange(len(node)), at[: len(u)], at[len(u) :])
        other = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[label[other]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            parts.append([c.to_numpy() for c in batch.columns])
            if sum(len(p[0]) for p in parts) >= _EDGES:
                yield stars(parts)
                parts = []
        if parts:
            yield stars(parts)
        give_back()

    return e.mapInArrow(run, "u long, v long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _contracted(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return _contracted(linked.union(least.select("u", F.col("m").alias("v"))))
