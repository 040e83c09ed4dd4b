from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.operators.ingest import latest
from meridia.sources import arrays, sinks, text_formats
from meridia.streaming import ingest


def test_jobs(spark, tmp_path):
    rows = [{"model": "m", "case_id": "a", "video": "v"}, {"model": "m", "case_id": "b", "video": "v", "group": "other"}, {"model": "m", "case_id": "../c", "video": "v"}, {"model": "n", "case_id": "a", "video": "v"}, {"model": "n", "case_id": "a", "video": "w"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    got = sorted((r.model, r.case_id, r.problems) for r in text_formats.read_jobs(spark, str(tmp_path / "m.jsonl"), cases).collect())
    assert got == [("m", "../c", ["case_id", "unknown_case"]), ("m", "a", []), ("m", "b", ["group"]), ("n", "a", ["repeated"]), ("n", "a", ["repeated"])]


def test_reports(spark, tmp_path):
    for i, status in enumerate(["complete", "incomplete", "complete"]):
        (tmp_path / f"c{i}").mkdir()
        (tmp_path / f"c{i}/report.json").write_text(json.dumps({"model": "m", "case_id": f"c{i}", "status": status, "metrics": {"x": i}}, indent=1))
    got = text_formats.read_reports(spark, f"{tmp_path}/*/report.json").select("case_id", "group", F.get_json_object("payload", "$.metrics.x").alias("x"), "problems")
    assert sorted(map(tuple, got.collect())) == [("c0", "world", "0", []), ("c2", "world", "2", [])]


def test_camera_text(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# comment\n1 1 0 0 0 0.5 0 2 3 a.jpg\n10.5 20.5 -1 4 5 6\n2 0 1 0 0 1 1 1 3 b.jpg\n\n")
    got = text_formats.read_camera_images(spark, str(tmp_path / "images.txt")).orderBy("image_id").collect()
    assert [(r.image_id, r.qw, r.tz, r.camera_id, r.name) for r in got] == [(1, 1.0, 2.0, 3, "a.jpg"), (2, 0.0, 1.0, 3, "b.jpg")]
    (tmp_path / "indexes.txt").write_text("0 12\nx\n1 30\n")
    assert [tuple(r) for r in text_formats.read_pose_index(spark, str(tmp_path / "indexes.txt")).orderBy("pose_row").collect()] == [(0, 12), (1, 30)]


def test_caption_jobs(spark, tmp_path):
    ids = {k: 1 for k in text_formats.CAPTION_FRAMES}
    rows = [{"case_id": "a", "template": "t", "source_frame_ids": ids, "video_path": "v"}, {"case_id": "b", "template": "t", "source_frame_ids": {"q0": 1}, "video_path": "v"}, {"case_id": "c", "source_frame_ids": ids}]
    (tmp_path / "jobs.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r.case_id: r.problems for r in text_formats.read_caption_jobs(spark, str(tmp_path / "jobs.jsonl")).collect()}
    assert got == {"a": [], "b": ["frames"], "c": ["template", "images"]}


def test_arrays(spark, tmp_path):
    pose = np.stack([np.eye(4) * (i + 1) for i in range(3)])
    np.save(tmp_path / "poses.npy", pose)
    np.save(tmp_path / "pose_07.npy", pose[1])
    np.savez(tmp_path / "more.npz", a=pose[:2], other=np.zeros(3))
    got = sorted((r.path.rsplit("/", 1)[1], r.frame_index, r.pose[0]) for r in arrays.read_poses(spark, f"{tmp_path}/*.np[yz]").collect())
    assert got == [("more.npz", 0, 1.0), ("more.npz", 1, 2.0), ("pose_07.npy", 7, 2.0), ("poses.npy", 0, 1.0), ("poses.npy", 1, 2.0), ("poses.npy", 2, 3.0)]
    (tmp_path / "d").mkdir()
    depth = np.full((4, 4), 2.0)
    depth[0, 0], depth[2, 2] = np.nan, 0.0
    np.save(tmp_path / "d/depth_3.npy", depth)
    got = sorted((r.frame_index, r.row, r.col, r.z) for r in arrays.read_depth_samples(spark, f"{tmp_path}/d/*.npy", stride=2, inverse=True).collect())
    assert got == [(3, 0, 2, 0.5), (3, 2, 0, 0.5)]
    assert [(r.frame_index, r.length > 0) for r in text_formats.list_frames(spark, f"{tmp_path}/d/*.npy").collect()] == [(3, True)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan")), ("b", 2.0)], "model string, score double")
    sinks.write_scores(df.orderBy("model"), str(tmp_path))
    assert [tuple(r) for r in spark.read.schema("model string, score double").json(f"{tmp_path}/scores.json").orderBy("model").collect()] == [("a", None), ("b", 2.0)]
    cases = spark.createDataFrame([("c1", 3)], "case_id string, n int")
    sinks.export_cases(cases, f"{tmp_path}/cases")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.export_cases(cases, f"{tmp_path}/cases")


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@pytest.fixture
def event_files(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "events")
    _events(spark, sf_dir).repartitionByRange(4, "ts").write.parquet(folder)
    return folder


def _stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_upsert_stream_equals_batch(spark, event_files, tmp_path):
    query = ingest.upsert_stream(_stream(spark, event_files), f"{tmp_path}/out", ["user_id"], ["ts", "event_id"], f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    expected = latest(spark.read.parquet(event_files), ["user_id"], ["ts", "event_id"])
    assert sorted(map(str, ingest.read_latest(spark, f"{tmp_path}/out").collect())) == sorted(map(str, expected.collect()))


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    """Three batches over two keys: what a batch doesn't touch stays in its version, and two versions of a bucket are kept."""
    schema = "k long, at long, v string"
    for n, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (1, 0, "late")], [(1, 3, "d")], [(1, 1, "old")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    for n in range(4):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/[0-{n}]")
        ingest.upsert_stream(stream, f"{tmp_path}/out", ["k"], ["at"], f"{tmp_path}/checkpoint", buckets=16).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, ingest.read_latest(spark, f"{tmp_path}/out").collect())) == [(1, 3, "d"), (2, 1, "b")]
    assert sorted(ingest._versions(spark, f"{tmp_path}/out").values()) == [[0], [2, 3]]


def test_windowed_means_equal_batch(spark, event_files, tmp_path):
    means = ingest.windowed_means(_stream(spark, event_files), ["event_type"], "ts", "value", late="40 days", size="1 day")
    query = means.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.event_type, str(r.window.start), r.n, round(r.mean, 6)) for r in spark.table("daily").collect())
    batch = spark.read.parquet(event_files).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    assert got == sorted((r.event_type, str(r.w.start), r.n, round(r.mean, 6)) for r in batch.collect())


def test_steps_follow_over_batches(spark, event_files, tmp_path):
    steps = ingest.follow_steps(_stream(spark, event_files).withColumn("move", F.col("value") / 10), "user_id", "ts", "move", 7.0)
    query = steps.writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.user_id: (r.n, r.a) for r in spark.table("steps").groupBy("user_id").agg(F.sum("rows").alias("n"), F.sum("action").alias("a")).collect()}
    for r in spark.read.parquet(event_files).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v")).collect():
        assert got[r.user_id][0] == r.n
        assert abs(got[r.user_id][1] * 7.0 - r.v / 10) <= 7.0 + 1e-6
