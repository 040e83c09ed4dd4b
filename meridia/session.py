"""Session settings for local runs, and lineage cut in loops; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session in UTC with adaptive execution, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("meridia")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("MERIDIA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.warehouse.dir", os.environ.get("MERIDIA_WAREHOUSE", "/tmp/meridia-warehouse"))
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the folder that spark.checkpoint.dir names; in a temporary one only where it is unset and Spark runs on one machine, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="meridia-"))
    return df.checkpoint()
