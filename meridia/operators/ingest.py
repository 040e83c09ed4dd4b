"""Upserts, resumable work and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last in order; max of a struct, so each task keeps one row a key before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*keys, "m.*").select(*rows.columns)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """current with changes written over it by key, the last in order winning."""
    return latest(current.unionByName(changes), keys, order)


def remaining(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The jobs without a finished row."""
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys with more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def stale(stages: DataFrame, receipts: DataFrame, key: str, inputs: list[str]) -> DataFrame:
    """(key, fingerprint): stages whose inputs no receipt with the same fingerprint covers."""
    marked = stages.select(key, F.sha2(F.to_json(F.struct(*inputs)), 256).alias("fingerprint"))
    return marked.join(receipts.select(key, "fingerprint"), [key, "fingerprint"], "left_anti")
