"""Case folders: good and broken ones, images, and the view of an evaluation."""

from __future__ import annotations

import json
import shutil
import struct
import zlib

import numpy as np
import pytest

from meridia.sources.cases import CaseFolders, evaluation_view
from meridia.sources.png import as_mask, decode


def png(image, filters=(0,), colour=None, bits=8, palette=None):
    """A PNG of a grey, RGB or palette array, its rows filtered in turn."""
    height, width = image.shape[:2]
    step = 1 if image.ndim == 2 else image.shape[2]
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[step] if colour is None else colour
    lines = np.packbits(image > 0, axis=1) if bits == 1 else image.reshape(height, -1)
    out, above = [], [0] * lines.shape[1]
    for y, line in enumerate(lines.tolist()):
        kind, shown = filters[y % len(filters)], []
        for i, v in enumerate(line):
            a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            shown.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out.append(bytes([kind, *shown]))
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)
    extra = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [0, 1, 2, 3, 4])
def test_images_are_read_back(channels):
    image = np.random.default_rng(channels).integers(0, 256, (11, 7, channels) if channels else (11, 7)).astype(np.uint8)
    expected = image[:, :, :3] if channels >= 3 else image[:, :, 0] if channels else image
    assert (decode(png(image, (0, 1, 2, 3, 4))) == expected).all()


def test_masks_palettes_and_broken_images():
    bits = np.arange(33).reshape(3, 11) % 3 == 0
    assert (as_mask(decode(png(bits.astype(np.uint8), bits=1))) == bits).all()
    palette = np.array([[0, 0, 0], [0, 0, 1], [9, 0, 0]], np.uint8)
    index = np.array([[0, 1], [2, 0]], np.uint8)
    assert (decode(png(index, colour=3, palette=palette)) == palette[index]).all()
    assert as_mask(palette[index]).tolist() == [[False, False], [True, False]]  # the least blue rounds to black
    good = png(index)
    for broken in (b"", b"GIF89a", good[:-20], good.replace(struct.pack(">II", 2, 2), struct.pack(">II", 2, 3)), png(index, colour=3), good[:8]):
        with pytest.raises(ValueError):
            decode(broken)


def pose(x):
    m = np.eye(4)
    m[0, 3] = x
    return m


def write_case(root, name):
    """A case of 5 frames that move along x, with an end view at frame 4."""
    public, ref = root / "public" / name, root / "references" / name
    public.mkdir(parents=True)
    ref.mkdir(parents=True)
    times = np.arange(5) / 16
    np.savez(public / "camera.npz", poses_c2w=np.stack([pose(i / 4) for i in range(5)]), timestamps_s=times)
    events = {n: {"frame_index": i, "timestamp_s": i / 16} for n, i in (("q0", 0), ("w2", 2), ("qe1", 4))}
    pair = {"first_event": "q0", "revisit_event": "qe1", "first_frame_index": 0, "revisit_frame_index": 4}
    doc = {"case_id": name, "parent_case_id": "p", "template": "yaw_return", "frame_count": 5, "intrinsics": {"width": 6, "height": 4}, "events": events, "revisit_pairs": {"C": pair}}
    (public / "case.json").write_text(json.dumps(doc))
    (public / "prompt.txt").write_text("  a room\n")
    (public / "q0.png").write_bytes(png(np.zeros((4, 6, 3), np.uint8)))
    frames = {}
    for role, x in (("q0", 0.0), ("qe", 1.0)):
        depth = np.full((2, 3), 2.0, np.float32)
        depth[0, 0] = 0
        np.save(ref / f"{role}.npy", depth)
        (ref / f"{role}_valid.png").write_bytes(png((depth > 0).astype(np.uint8) * 255))
        (ref / f"{role}.png").write_bytes(png(np.zeros((4, 6, 3), np.uint8)))
        camera = {"depth_camera": {"width": 3, "height": 2}, "rgb_camera": {"width": 6, "height": 4}, "T_world_camera": pose(x + 7).tolist()}
        frames[role] = {"depth": f"{role}.npy", "valid": f"{role}_valid.png", "rgb": f"{role}.png", "depth_unit": "metre", **camera}
    mask = np.zeros((4, 6), np.uint8)
    mask[1:3, 1:4] = 1
    (ref / "m.png").write_bytes(png(mask))
    (ref / "seen.png").write_bytes(png(np.ones((2, 3), np.uint8)))
    anchor = {"anchor_id": "a1", "label": "chair", "q0_mask": "m.png", "qe_mask": "m.png", "qe_region": "m.png"}
    reference = {"case_id": name, "source": "s", "native_to_input": np.eye(3).tolist(), "exact_revisit": True, "frames": frames, "anchors": [anchor], "qe_scene_region": "m.png", "observability": {"input_supported": "seen.png"}}
    (ref / "reference.json").write_text(json.dumps(reference))


def edit(path, change):
    doc = json.loads(path.read_text())
    change(doc)
    path.write_text(json.dumps(doc))


BROKEN = {
    "identity": lambda p, r: edit(p / "case.json", lambda d: d.update(case_id="other")),
    "count": lambda p, r: edit(p / "case.json", lambda d: d.update(frame_count=6)),
    "nan": lambda p, r: np.savez(p / "camera.npz", poses_c2w=np.full((5, 4, 4), np.nan), timestamps_s=np.arange(5) / 16),
    "outside": lambda p, r: edit(p / "case.json", lambda d: d["events"]["w2"].update(frame_index=5)),
    "bool": lambda p, r: edit(p / "case.json", lambda d: d["events"]["w2"].update(frame_index=True)),
    "time": lambda p, r: edit(p / "case.json", lambda d: d["events"]["w2"].update(timestamp_s=0.2)),
    "resolution": lambda p, r: edit(p / "case.json", lambda d: d["intrinsics"].update(width=7)),
    "no_json": lambda p, r: (p / "case.json").write_text("{"),
    "no_camera": lambda p, r: (p / "camera.npz").unlink(),
    "no_field": lambda p, r: edit(p / "case.json", lambda d: d.pop("template")),
    "ref_identity": lambda p, r: edit(r / "reference.json", lambda d: d.update(case_id="x")),
    "float64": lambda p, r: np.save(r / "q0.npy", np.ones((2, 3))),
    "hole": lambda p, r: np.save(r / "qe.npy", np.zeros((2, 3), np.float32)),
    "unit": lambda p, r: edit(r / "reference.json", lambda d: d["frames"]["q0"].update(depth_unit="inch")),
    "escape": lambda p, r: edit(r / "reference.json", lambda d: d["frames"]["q0"].update(depth="../x.npy")),
    "rgb": lambda p, r: (r / "qe.png").write_bytes(png(np.zeros((3, 6, 3), np.uint8))),
    "twice": lambda p, r: edit(r / "reference.json", lambda d: d["anchors"].append(d["anchors"][0])),
    "mask": lambda p, r: edit(r / "reference.json", lambda d: d["anchors"][0].update(q0_mask="seen.png")),
    "no_anchor": lambda p, r: edit(r / "reference.json", lambda d: d.update(anchors=[])),
    "seen": lambda p, r: edit(r / "reference.json", lambda d: d["observability"].update(invalid="m.png")),
    "pose": lambda p, r: edit(r / "reference.json", lambda d: d["frames"]["qe"].update(T_world_camera=pose(8.1).tolist())),
}
ERRORS = {
    "identity": "case identity mismatch", "count": "invalid camera trajectory", "nan": "invalid camera trajectory", "outside": "event outside trajectory", "bool": "event outside trajectory",
    "time": "event time differs from camera timestamp", "resolution": "input resolution differs from calibration", "no_camera": "missing file camera.npz", "no_field": "missing field 'template'",
    "ref_identity": "reference identity mismatch", "float64": "depth, dtype, valid mask or camera mismatch", "hole": "invalid values marked as valid depth", "unit": "unsupported depth unit",
    "escape": "asset escapes its case directory", "rgb": "reference RGB calibration mismatch", "twice": "duplicate anchor ID", "mask": "anchor mask resolution mismatch",
    "no_anchor": "reference has no anchors", "seen": "observability is not in QE depth space", "pose": "QE does not match reference pose",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for name in ("good", "no_region", "no_pair", *BROKEN):
        write_case(root, name)
    for name, change in BROKEN.items():
        change(root / "public" / name, root / "references" / name)
    edit(root / "references/no_region/reference.json", lambda d: d.update(qe_scene_region="q0_valid.png"))
    edit(root / "public/no_pair/case.json", lambda d: d.update(revisit_pairs={}))
    (root / "public" / ".hidden").mkdir()
    (root / "public" / "file").write_text("")
    return root


def cases(spark, root, **options):
    spark.dataSource.register(CaseFolders)
    return spark.read.format("case_folders").options(**options).load(str(root))


def test_every_check_gives_its_row(spark, root):
    df = cases(spark, root, references="true")
    assert df.rdd.getNumPartitions() == len(BROKEN) + 3
    got = {r.case_id: r for r in df.collect()}
    assert set(got) == {"good", "no_region", "no_pair", *BROKEN}
    assert {n: got[n].error for n in ERRORS} == ERRORS and got["no_json"].error
    assert all(got[n].poses_c2w is None for n in BROKEN)
    good = got["good"]
    assert good.error is None and good.prompt == "a room" and (good.width, good.height, good.frame_count) == (6, 4, 5)
    assert good.events["w2"].frame_index == 2 and good.poses_c2w[4][3] == 1.0 and good.timestamps_s[4] == 0.25
    assert good.frames["qe"].valid_pixels == 5 and good.anchors[0].asDict() == {"anchor_id": "a1", "label": "chair", "q0_pixels": 6, "qe_pixels": 6, "region_pixels": 6}
    assert good.observability == {"input_supported": 6} and good.region_error is None and got["no_region"].region_error


def test_public_half_alone(spark, root):
    got = {r.case_id: r for r in cases(spark, root).select("case_id", "error", "frames").collect()}
    assert got["pose"].error is None and got["pose"].frames is None and got["count"].error


def test_view_of_an_evaluation(spark, root):
    view = evaluation_view(cases(spark, root, references="true"))
    got = {r.case_id: r for r in view.collect()}
    assert got["count"].error == "invalid camera trajectory" and got["no_pair"].error == "pair C is missing"
    assert got["no_region"].error == "anchor regions must be within the QE scene region" and got["no_region"].events is None
    good = got["good"]
    assert good.error is None and good.events == {"q0": 0, "w2": 2, "qe1": 4} and set(good.hidden_frames) == {"q0", "qe1"} and good.anchor_ids == ["a1"]
    assert (good.completion.first_event_frame_index, good.completion.revisit_event_frame_index) == (0, 4)
    assert good.completion.pairs["C"].first_window_indices == [0] and good.revisit_pairs["C"].revisit_window_indices == [4] and good.revisit_pairs["C"].event_offset_in_window == 0
    public = {r.case_id: r.error for r in evaluation_view(cases(spark, root)).collect()}
    assert public["good"] == "evaluation requires the reference bundle"


def test_depth_pixels(spark, root, tmp_path):
    shutil.copytree(root / "public/good", tmp_path / "public/good")
    shutil.copytree(root / "references/good", tmp_path / "references/good")
    got = cases(spark, tmp_path, content="pixels").orderBy("role", "row", "col").collect()
    assert [(r.role, r.row, r.col, r.depth, r.valid) for r in got[:2]] == [("q0", 0, 0, 0.0, False), ("q0", 0, 1, 2.0, True)] and len(got) == 12
    assert cases(spark, tmp_path / "nothing").collect() == []
