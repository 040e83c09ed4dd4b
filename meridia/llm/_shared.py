"""Shared-folder tables and small session helpers of the operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = where.get() if where.isDefined() else None
    if where is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if where is None:
        where = tempfile.mkdtemp(prefix="meridia-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: its lineage is cut and lost executors cost nothing.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def sampled(rows: DataFrame, total: int, most: int) -> DataFrame:
    """Of total rows with a column `seed` of hashes, about `most`, chosen by that hash; all, if they are no more."""
    return rows if total <= most else rows.where(F.shiftrightunsigned("seed", 2) < (most << 62) // total)


def give_back() -> None:
    """Returns a worker's freed memory to the system, so that the next stage's tasks don't start with this one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Has the driver look for tables that nothing refers to any more: Spark then deletes their shuffle files and checkpoints.

    Loops call it once a round; else the files of all rounds stay on disk until the driver's memory fills.
    """
    spark.sparkContext._jvm.System.gc()
