"""Structured Streaming: manifests, measurements and stateful plans as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meridia.functions.numeric import finite
from meridia.operators.ingest import latest


def windowed_means(stream: DataFrame, keys: list[str], time: str, value: str, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(keys, window, n, mean) of finite values by event time; rows later than the watermark are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(*keys, w.alias("window")).agg(F.count("*").alias("n"), F.avg(finite(F.col(value))).alias("mean"))


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """stream without rows whose keys came before, remembered as long as the watermark lets them come."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Keeps under `path` the last row of each key in order; a batch rewrites only the buckets of keys that it touches.

    A bucket's rows are merged with its version before and written beside it, named by the
    batch; writing the same batch again after a failure gives the same version, so each
    row counts once. read_latest() reads the newest finished version of every bucket. Two
    versions of a bucket stay, older ones are removed. The number of buckets of a path must not change.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
        spread = batch.select("*", bucket).persist()
        touched = {r["_bucket"] for r in spread.select("_bucket").distinct().collect()}
        older = {b: max(v for v in versions if v < number) for b, versions in _versions(spark, path).items() if b in touched and min(versions) < number}
        rows = spread
        if older:
            before = spark.read.schema(batch.schema).parquet(*[f"{path}/version={v}/bucket={b}" for b, v in sorted(older.items())])
            rows = spread.unionByName(before.select("*", bucket))
        kept = latest(rows, keys, order).withColumnRenamed("_bucket", "bucket")
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        spread.unpersist()
        for b, versions in _versions(spark, path).items():
            for v in sorted(versions)[:-2]:
                _remove(spark, f"{path}/version={v}/bucket={b}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _files(spark, path: str):
    """(filesystem, path) of a folder in any store that Spark reaches."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _remove(spark, path: str) -> None:
    fs, folder = _files(spark, path)
    fs.delete(folder, True)


def _versions(spark, path: str) -> dict[int, list[int]]:
    """The finished versions of each bucket under path."""
    fs, folder = _files(spark, path)
    found: dict[int, list[int]] = {}
    for version in fs.listStatus(folder) if fs.exists(folder) else []:
        name = version.getPath().getName()
        inside = [x.getPath().getName() for x in fs.listStatus(version.getPath())] if name.startswith("version=") else []
        if "_SUCCESS" in inside:
            for b in inside:
                if b.startswith("bucket="):
                    found.setdefault(int(b.partition("=")[2]), []).append(int(name.partition("=")[2]))
    return found


def read_latest(spark, path: str) -> DataFrame:
    """The newest finished rows that upsert_stream() wrote."""
    return spark.read.parquet(*[f"{path}/version={max(versions)}/bucket={b}" for b, versions in sorted(_versions(spark, path).items())])


def follow_steps(stream: DataFrame, key: str, order: str, move: str, step: float) -> DataFrame:
    """(key, rows, action, debt) a batch: whole steps that follow the moves so far; what is left over stays in
    the key's state for the next batch."""
    kind = stream.schema[key].dataType.simpleString()

    def plan(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (debt,) = state.get if state.exists else (0.0,)
        rows = action = 0
        for frame in frames:
            debt += float(frame.sort_values(order)[move].sum())
            rows += len(frame)
        action = int(debt / step)
        debt -= action * step
        state.update((debt,))
        yield pd.DataFrame({key: [group[0]], "rows": [rows], "action": [action], "debt": [debt]})

    return stream.groupBy(key).applyInPandasWithState(plan, f"{key} {kind}, rows long, action long, debt double", "debt double", "append", GroupStateTimeout.NoTimeout)
