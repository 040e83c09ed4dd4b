"""Case folders as a data source, and the view of a case that an evaluation reads.

A data set has public/<case_id> with case.json, camera.npz, q0.png and prompt.txt, and
references/<case_id> with reference.json and the arrays and images that it names. Every
case folder is a partition, so cases are read and checked where they are read; a case
that fails a check is a row with its error and nothing else. The root must be a path
that all executors see.

    spark.dataSource.register(CaseFolders)
    spark.read.format("case_folders").option("references", "true").load(root)
    spark.read.format("case_folders").option("content", "pixels").load(root)
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path, PurePosixPath
from zipfile import BadZipFile
from zlib import error as ZlibError

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meridia.sources.png import as_mask, as_rgb, decode

EVENT = "struct<frame_index: long, timestamp_s: double>"
PAIR = "struct<first_event: string, revisit_event: string, first_frame_index: long, revisit_frame_index: long>"
ANCHOR = "struct<anchor_id: string, label: string, q0_pixels: long, qe_pixels: long, region_pixels: long>"
FRAME = "struct<depth_unit: string, width: int, height: int, valid_pixels: long, camera: string>"
CASES = (
    "case_id string, error string, parent_case_id string, template string, prompt string, intrinsics string, width int, height int, frame_count long, timestamps_s array<double>, "
    f"poses_c2w array<array<double>>, events map<string, {EVENT}>, revisit_pairs map<string, {PAIR}>, source string, native_to_input array<array<double>>, exact_revisit boolean, "
    f"frames map<string, {FRAME}>, anchors array<{ANCHOR}>, observability map<string, long>, region_error string"
)
PIXELS = "case_id string, role string, row int, col int, depth double, valid boolean"
# The depth units and roles of the format; the texts of the checks' errors below are fixed too, as users tell cases apart by them.
UNITS = ("metre", "source_pose_unit", "DA3_estimated_unit")
ROLES = ("q0", "qe")


def asset(root: Path, relative: str) -> Path:
    """A file of a case; a ValueError for names that lead out of its folder."""
    parts = PurePosixPath(relative).parts
    if not parts or relative.startswith("/") or ".." in parts:
        raise ValueError("asset escapes its case directory")
    return root / relative


def _require(held: bool, problem: str) -> None:
    if not held:
        raise ValueError(problem)


def _document(path: Path, case_id: str, problem: str) -> dict:
    found = json.loads(path.read_text(encoding="utf-8"))
    _require(isinstance(found, dict) and found.get("case_id") == case_id, problem)
    return found


def _mask(root: Path, relative: str) -> np.ndarray:
    return as_mask(decode(asset(root, relative).read_bytes()))


def _shape(camera: dict) -> tuple[int, int]:
    return camera["height"], camera["width"]


def read_depth(root: Path, frame: dict) -> tuple[np.ndarray, np.ndarray]:
    """(depth, valid) of a reference frame, checked against its camera."""
    depth, valid = np.load(asset(root, frame["depth"]), allow_pickle=False), _mask(root, frame["valid"])
    _require(depth.dtype == np.float32 and depth.shape == _shape(frame["depth_camera"]) == valid.shape, "depth, dtype, valid mask or camera mismatch")
    _require(not (valid & ~(np.isfinite(depth) & (depth > 0))).any(), "invalid values marked as valid depth")
    return depth, valid


def _public(root: Path, case_id: str) -> dict:
    """The public half of a case."""
    doc = _document(root / "case.json", case_id, "case identity mismatch")
    with np.load(root / "camera.npz", allow_pickle=False) as camera:
        poses, times = np.asarray(camera["poses_c2w"], np.float64), np.asarray(camera["timestamps_s"], np.float64)
    _require(times.ndim == 1 and poses.shape == (len(times), 4, 4) and len(times) == doc["frame_count"] and bool(np.isfinite(poses).all() and np.isfinite(times).all()), "invalid camera trajectory")
    for event in doc["events"].values():
        at = event["frame_index"]
        _require(type(at) is int and 0 <= at < len(times), "event outside trajectory")
        _require(abs(float(event["timestamp_s"]) - float(times[at])) <= 1e-6, "event time differs from camera timestamp")
    image = decode((root / "q0.png").read_bytes())
    _require(image.shape[:2] == _shape(doc["intrinsics"]), "input resolution differs from calibration")
    prompt = root / "prompt.txt"
    return {
        "parent_case_id": doc.get("parent_case_id"), "template": doc["template"], "prompt": prompt.read_text(encoding="utf-8").strip() if prompt.exists() else None,
        "intrinsics": json.dumps(doc["intrinsics"], sort_keys=True), "width": image.shape[1], "height": image.shape[0], "frame_count": len(times), "timestamps_s": times.tolist(),
        "poses_c2w": poses.reshape(-1, 16).tolist(), "events": {k: (e["frame_index"], float(e["timestamp_s"])) for k, e in doc["events"].items()},
        "revisit_pairs": {k: tuple(p[f] for f in ("first_event", "revisit_event", "first_frame_index", "revisit_frame_index")) for k, p in doc.get("revisit_pairs", {}).items()},
    }


def _reference(root: Path, case_id: str, public: dict) -> dict:
    """The reference half of a case, checked against the public one."""
    doc = _document(root / "reference.json", case_id, "reference identity mismatch")
    frames, shapes, depths = {}, {}, {}
    for role in ROLES:
        frame = doc["frames"][role]
        depth, valid = read_depth(root, frame)
        image = as_rgb(decode(asset(root, frame["rgb"]).read_bytes()))
        _require(image.shape[:2] == _shape(frame["rgb_camera"]), "reference RGB calibration mismatch")
        _require(frame["depth_unit"] in UNITS, "unsupported depth unit")
        camera = json.dumps({k: frame.get(k) for k in ("rgb_camera", "depth_camera", "T_world_camera")}, sort_keys=True)
        frames[role] = (frame["depth_unit"], image.shape[1], image.shape[0], int(valid.sum()), camera)
        shapes[role], depths[role] = image.shape[:2], depth.shape
    anchors, regions = {}, []
    for anchor in doc["anchors"]:
        name = anchor["anchor_id"]
        _require(name not in anchors, "duplicate anchor ID")
        masks = {role: _mask(root, anchor[f"{role}_mask"]) for role in ROLES}
        _require(all(masks[role].shape == shapes[role] for role in ROLES), "anchor mask resolution mismatch")
        region = _mask(root, anchor["qe_region"]) if anchor.get("qe_region") else None
        regions.append(region)
        anchors[name] = (name, anchor.get("label"), int(masks["q0"].sum()), int(masks["qe"].sum()), None if region is None else int(region.sum()))
    _require(bool(anchors), "reference has no anchors")
    seen = {name: _mask(root, path) for name, path in doc["observability"].items()}
    _require(all(m.shape == depths["qe"] for m in seen.values()), "observability is not in QE depth space")
    pose = lambda event: np.array(public["poses_c2w"][public["events"][event][0]]).reshape(4, 4)
    world = lambda role: np.asarray(doc["frames"][role]["T_world_camera"], np.float64)
    _require(np.allclose(np.linalg.inv(pose("q0")) @ pose("qe1"), np.linalg.inv(world("q0")) @ world("qe"), atol=1e-5, rtol=0), "QE does not match reference pose")
    problem = None
    if not doc.get("qe_scene_region") or any(r is None for r in regions):
        problem = "a QE region is missing"
    else:
        whole = _mask(root, doc["qe_scene_region"])
        if any(r.shape != whole.shape or (r & ~whole).any() for r in regions):
            problem = "anchor regions must be within the QE scene region"
    return {
        "source": doc.get("source"), "native_to_input": doc.get("native_to_input"), "exact_revisit": doc.get("exact_revisit"), "frames": frames,
        "anchors": list(anchors.values()), "observability": {k: int(m.sum()) for k, m in seen.items()}, "region_error": problem,
    }


def load_case(root: Path, case_id: str, references: bool) -> dict:
    """The columns of one case; `error` alone, besides case_id, where a check fails or a file can't be read."""
    try:
        found = _public(root / "public" / case_id, case_id)
        if references:
            found |= _reference(root / "references" / case_id, case_id, found)
        return {"case_id": case_id, **found}
    except (ValueError, KeyError, TypeError, AttributeError, OSError, EOFError, BadZipFile, ZlibError, np.linalg.LinAlgError) as e:
        kind = {KeyError: "missing field ", FileNotFoundError: "missing file "}.get(type(e), "")
        what = Path(e.filename).name if isinstance(e, OSError) and e.filename else str(e)
        return {"case_id": case_id, "error": f"{kind}{what}" or type(e).__name__}


class CasePartition(InputPartition):
    def __init__(self, case_id: str) -> None:
        self.case_id = case_id


class CaseReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.root = Path(options["path"])
        self.content = options.get("content", "cases")
        self.references = options.get("references", "false").lower() == "true"
        self.columns = columns

    def partitions(self) -> list[InputPartition]:
        """One a case folder; hidden ones and files are none."""
        folder = self.root / "public"
        names = sorted(p.name for p in folder.iterdir() if p.is_dir() and not p.name.startswith(".")) if folder.is_dir() else []
        return [CasePartition(n) for n in names]

    def read(self, partition: CasePartition) -> Iterator[tuple | pa.RecordBatch]:
        if partition is None:
            return
        if self.content == "cases":
            row = load_case(self.root, partition.case_id, self.references)
            yield tuple(row.get(c) for c in self.columns)
            return
        root = self.root / "references" / partition.case_id
        doc = _document(root / "reference.json", partition.case_id, "reference identity mismatch")
        for role in ROLES:
            depth, valid = read_depth(root, doc["frames"][role])
            rows, cols = np.indices(depth.shape, np.int32)
            n = depth.size
            columns = [pa.array([partition.case_id] * n), pa.array([role] * n), pa.array(rows.ravel()), pa.array(cols.ravel()), pa.array(depth.ravel().astype(np.float64)), pa.array(valid.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["case_id", "role", "row", "col", "depth", "valid"])


class CaseFolders(DataSource):
    """Format case_folders: a row a case, or with content = pixels a row a depth pixel of the reference frames.

    Options: path, the root; references, whether the reference half is read and checked
    too (default false). Reading pixels stops at a broken case, so it is meant for cases
    that the reader of cases found good.
    """

    @classmethod
    def name(cls) -> str:
        return "case_folders"

    def schema(self) -> str:
        content = self.options.get("content", "cases")
        if content not in ("cases", "pixels"):
            raise ValueError(f"content is cases or pixels, not {content}")
        return CASES if content == "cases" else PIXELS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return CaseReader(dict(self.options), schema.names)


def evaluation_view(cases: DataFrame) -> DataFrame:
    """What an evaluation reads of cases with references: event frames, windows of the revisit pairs, and the completion of pair C.

    A row without a reference, with an error of its own or of its regions, or without pair C keeps that as its
    error and has nulls otherwise. completion has the pairs only of exact revisits.
    """
    window = lambda p: F.struct(p["first_event"].alias("first_event"), p["revisit_event"].alias("revisit_event"), F.array(p["first_frame_index"]).alias("first_window_indices"), F.array(p["revisit_frame_index"]).alias("revisit_window_indices"), F.lit(0).alias("event_offset_in_window"))
    main = F.element_at("revisit_pairs", F.lit("C"))
    lacking = F.when(F.col("frames").isNull(), "evaluation requires the reference bundle").when(main.isNull(), "pair C is missing")
    problem = F.coalesce("error", lacking, "region_error")
    pairs = F.transform_values("revisit_pairs", lambda _, p: window(p))
    completion = F.struct(window(main).alias("pair"), main["first_frame_index"].alias("first_event_frame_index"), main["revisit_frame_index"].alias("revisit_event_frame_index"), F.when(F.col("exact_revisit"), pairs).alias("pairs"))
    good = {
        "template": F.col("template"),
        "source": F.col("source"),
        "canonical_camera": F.col("intrinsics"),
        "native_to_canonical": F.col("native_to_input"),
        "requested_poses": F.col("poses_c2w"),
        "timestamps_s": F.col("timestamps_s"),
        "events": F.transform_values("events", lambda _, e: e["frame_index"]),
        "revisit_pairs": pairs,
        "completion": completion,
        # The end frame goes by the name of its event.
        "hidden_frames": F.transform_keys("frames", lambda k, _: F.when(k == "qe", "qe1").otherwise(k)),
        "anchor_ids": F.transform("anchors", lambda a: a["anchor_id"]),
    }
    return cases.withColumn("_problem", problem).select("case_id", F.col("_problem").alias("error"), *[F.when(F.col("_problem").isNull(), v).alias(n) for n, v in good.items()])
