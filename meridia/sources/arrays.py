"""NumPy files as rows: poses and depth samples, decoded in Arrow batches from binary contents."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.sources.text_formats import last_number


def _arrays(content: bytes) -> list[np.ndarray]:
    """The arrays of an .npy or .npz file; pickled objects are refused."""
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    return [loaded] if isinstance(loaded, np.ndarray) else [loaded[name] for name in loaded.files]


def _decode(batches: Iterator[pa.RecordBatch], to_rows) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield from to_rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py())


def read_poses(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, frame_index, pose) of 4x4 poses in .npy or .npz files; a file with one pose takes its index from its name."""

    def rows(path: str, index: int | None, content: bytes) -> Iterator[pa.RecordBatch]:
        for a in _arrays(content):
            if a.ndim >= 2 and a.shape[-2:] == (4, 4):
                flat = a.reshape(-1, 16).astype(np.float64)
                at = [index if index is not None else 0] if len(flat) == 1 else list(range(len(flat)))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(flat)), pa.array(at, pa.int64()), pa.array(list(flat), pa.list_(pa.float64()))], ["path", "frame_index", "pose"])

    return _files(spark, pattern).mapInArrow(lambda b: _decode(b, rows), "path string, frame_index long, pose array<double>")


def read_depth_samples(spark: SparkSession, pattern: str, stride: int = 8, scale: float = 1.0, inverse: bool = False) -> DataFrame:
    """(path, frame_index, row, col, z) of every stride-th pixel with a finite depth over 0; whole frames are never exploded."""

    def rows(path: str, index: int | None, content: bytes) -> Iterator[pa.RecordBatch]:
        for a in _arrays(content):
            if a.ndim == 2:
                z = a[::stride, ::stride].astype(np.float64)
                with np.errstate(divide="ignore", invalid="ignore"):
                    z = (1.0 / z if inverse else z) * scale
                r, c = np.nonzero(np.isfinite(z) & (z > 0))
                n = len(r)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([index] * n, pa.int64()), pa.array(r * stride), pa.array(c * stride), pa.array(z[r, c])], ["path", "frame_index", "row", "col", "z"])

    return _files(spark, pattern).mapInArrow(lambda b: _decode(b, rows), "path string, frame_index long, row long, col long, z double")


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return spark.read.format("binaryFile").load(pattern).select("path", last_number(stem).alias("frame_index"), "content")
