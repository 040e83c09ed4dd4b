"""Writers of scores, reports and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions.numeric import finite


def without_nan(df: DataFrame) -> DataFrame:
    """df with null for every NaN or infinite number of its top columns, as JSON has none."""
    return df.select(*[finite(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_scores(scores: DataFrame, path: str) -> None:
    """A leaderboard, of a row a model, as one CSV and one JSON file in order."""
    clean = without_nan(scores).coalesce(1)
    clean.write.mode("overwrite").option("header", True).csv(f"{path}/scores.csv")
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/scores.json")


def export_cases(cases: DataFrame, path: str) -> None:
    """Cases in a folder each; refuses to overwrite."""
    cases.write.mode("errorifexists").partitionBy("case_id").json(path)
