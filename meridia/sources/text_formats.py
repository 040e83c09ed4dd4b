"""Readers of manifests, reports, camera text and caption jobs.

Each gives rows with a `problems` array rather than failing on the first bad line; the
caller keeps the rows without problems or reports them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions.text import last_number, safe_name

JOB = "model string, case_id string, video string, `group` string, control_profile string"
#: Frames that a caption job names.
CAPTION_FRAMES = ("q0", "q25", "mid", "q75", "qe")


def _problems(**checks: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))


def read_jobs(spark: SparkSession, manifest: str, cases: DataFrame | None = None) -> DataFrame:
    """Evaluation jobs of a JSONL manifest with problems: names that aren't one path component, repeated
    (model, case_id), unknown group or profile, and, with cases, a case that isn't there."""
    jobs = spark.read.schema(JOB).json(manifest).withColumns({"group": F.coalesce("group", F.lit("world")), "control_profile": F.coalesce("control_profile", F.lit("pose_and_action"))})
    once = F.count("*").over(Window.partitionBy("model", "case_id")) == 1
    checks = {"model": safe_name(F.col("model")), "case_id": safe_name(F.col("case_id")), "video": F.col("video").isNotNull(), "repeated": once, "group": F.col("group").isin("world", "ti2v"), "control_profile": F.col("control_profile").isin("pose_and_action", "action_only")}
    if cases is not None:
        jobs = jobs.join(cases.select("case_id").distinct().withColumn("_known", F.lit(True)), "case_id", "left")
        checks["unknown_case"] = F.col("_known").isNotNull()
    return jobs.withColumn("problems", _problems(**checks)).drop("_known")


def read_reports(spark: SparkSession, root: str, status: str = "complete") -> DataFrame:
    """(model, case_id, group, control_profile, payload, problems) of the reports under root with that status.

    root is a glob of JSON files, one report each; the payload stays text, and leaves are
    taken from it by path. Two reports of one (model, case_id) are a problem of both.
    """
    texts = spark.read.text(root, wholetext=True).withColumnRenamed("value", "payload")
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    rows = texts.select(field("model").alias("model"), field("case_id").alias("case_id"), F.coalesce(field("group"), F.lit("world")).alias("group"), F.coalesce(field("control_profile"), F.lit("pose_and_action")).alias("control_profile"), field("status").alias("status"), "payload")
    once = F.count("*").over(Window.partitionBy("model", "case_id")) == 1
    kept = rows.where(F.col("status") == status).drop("status")
    return kept.withColumn("problems", _problems(model=F.col("model").isNotNull(), case_id=F.col("case_id").isNotNull(), repeated=once))


def list_frames(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, frame_index, length) of files named by their last number; contents are not read."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select("path", last_number(stem).alias("frame_index"), "length")


def read_pose_index(spark: SparkSession, path: str) -> DataFrame:
    """(pose_row, source_frame) of lines of two whole numbers; others are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\d+\s+\d+$"))
    return rows.select(parts[0].cast("long").alias("pose_row"), parts[1].cast("long").alias("source_frame"))


def read_camera_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, qw .. qz, tx .. tz, camera_id, name) of a reconstruction's image list: lines of exactly
    ten fields that aren't comments. The lines of points between them have other counts."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(parts) == 10)
    number = lambda i, name: parts[i].cast("double").alias(name)
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    return rows.select(parts[0].cast("long").alias("image_id"), *[number(i + 1, n) for i, n in enumerate(names)], parts[8].cast("long").alias("camera_id"), parts[9].alias("name"))


def read_caption_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Caption jobs with problems: a missing name, or frames that aren't exactly the five roles."""
    schema = "case_id string, dataset string, template string, source_frame_ids map<string, int>, source_frame_paths map<string, string>, video_path string"
    rows = spark.read.schema(schema).json(path)
    roles = F.array_sort(F.map_keys("source_frame_ids")) == F.array(*[F.lit(k) for k in sorted(CAPTION_FRAMES)])
    images = F.col("video_path").isNotNull() | (F.size("source_frame_paths") == len(CAPTION_FRAMES))
    return rows.withColumn("problems", _problems(case_id=safe_name(F.col("case_id")), template=F.col("template").isNotNull(), frames=roles, images=images))


def long_cases(cases: DataFrame, horizon: str = "all") -> DataFrame:
    """Cases of a horizon: long ones have 961 frames or more."""
    n = F.col("frame_count")
    return {"all": cases, "long": cases.where(n >= 961), "short": cases.where(n < 961)}[horizon]
