"""Screen vectors: dense image statistics of a frame, and of its change from the last one, in NumPy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "source string, frame_id long, core_mean double, core_std double, core_gradient double, core_direction double, core_entropy double, sector_means array<double>, sector_gradients array<double>, sector_entropies array<double>, "
    "motion double, motion_direction double, motion_uniformity double, symmetry double, stability double, flash double, histogram array<int>"
)
#: Weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)


def luma(red: str, green: str, blue: str) -> Column:
    """The luma of three arrays of bytes."""
    pair = F.arrays_zip(F.col(red).alias("r"), F.col(green).alias("g"), F.col(blue).alias("b"))
    return F.transform(pair, lambda p: LUMA[0] * p["r"] + LUMA[1] * p["g"] + LUMA[2] * p["b"])


def sobel(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes along x and y; beyond its edges a region goes on as at them."""
    pad = np.pad(m, 1, mode="edge")
    gx = pad[:-2, 2:] + 2 * pad[1:-1, 2:] + pad[2:, 2:] - pad[:-2, :-2] - 2 * pad[1:-1, :-2] - pad[2:, :-2]
    gy = pad[2:, :-2] + 2 * pad[2:, 1:-1] + pad[2:, 2:] - pad[:-2, :-2] - 2 * pad[:-2, 1:-1] - pad[:-2, 2:]
    return gx, gy


def entropy(m: np.ndarray) -> float:
    """Bits of a region's values in 64 bins."""
    p = np.bincount((m / 4).astype(np.uint8).ravel(), minlength=64) / max(1, m.size)
    return float(-(p[p > 0] * np.log2(p[p > 0])).sum()) + 0.0


def _slope(m: np.ndarray) -> tuple[float, float]:
    """(mean steepness, direction of the mean slope)."""
    gx, gy = sobel(m)
    return float(np.hypot(gx, gy).mean()), float(np.arctan2(gy.mean(), gx.mean()))


def sectors(m: np.ndarray) -> list[np.ndarray]:
    """The outer eight of nine thirds: north, north-east, and so on clockwise."""
    h, w = m.shape[0] // 3, m.shape[1] // 3
    rows, cols = (slice(0, h), slice(h, 2 * h), slice(2 * h, None)), (slice(0, w), slice(w, 2 * w), slice(2 * w, None))
    return [m[rows[y], cols[x]] for y, x in ((0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (0, 0))]


def vector(m: np.ndarray, last: np.ndarray | None = None) -> tuple:
    """The numbers of a frame in the order of SCHEMA; without a last frame of its shape there is no motion and no flash."""
    m = m.astype(float)
    h, w = m.shape
    top, left = int(h * 0.4), int(w * 0.4)
    core = m[top : max(top + 1, h - top), left : max(left + 1, w - left)]
    steep, direction = _slope(core)
    parts = [p if p.size else m for p in sectors(m)]
    half = w // 2
    even = 1 - np.abs(m[:, :half] - m[:, half : 2 * half][:, ::-1]).mean() / 255 if half else 1.0
    motion = turn = uniform = flash = 0.0
    stable = 1.0
    if last is not None and last.shape == m.shape:
        diff = np.abs(m - last)
        motion, turn = float(diff.mean()), _slope(diff)[1]
        uniform, stable, flash = 1 - min(1.0, float(diff.std()) / (motion + 1e-6)), 1 - motion / 255, abs(float(m.mean() - last.mean())) / 255
    levels = np.bincount(m.astype(np.uint8).ravel(), minlength=256).tolist()
    return (float(core.mean()), float(core.std()), steep, direction, entropy(core), [float(p.mean()) for p in parts], [_slope(p)[0] for p in parts], [entropy(p) for p in parts], motion, turn, uniform, float(even), stable, flash, levels)


def screen_vectors(frames: DataFrame, source: str | None = None) -> DataFrame:
    """frames: frame_id, width, luma (array of numbers in row order), and the column `source`, whose frames follow each other by frame_id. A row a
    frame; empty frames give none. A task holds one frame and the last one."""
    d = frames.select((F.col(source).cast("string") if source else F.lit("")).alias("source"), F.col("frame_id").cast("long").alias("frame_id"), "width", "luma")
    kinds = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}
    fields = [f.rsplit(" ", 1) for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            out = []
            for k, (s, i, w) in enumerate(zip(*(b.column(c).to_pylist() for c in ("source", "frame_id", "width")), strict=True)):
                cells = b.column("luma")[k].values
                if cells is None or not len(cells):
                    continue
                m = cells.to_numpy(zero_copy_only=False).astype(float).reshape(-1, w)
                out.append((s, i, *vector(m, last if s == key else None)))
                key, last = s, m
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], [n for n, _ in fields])

    return d.repartition("source").sortWithinPartitions("source", "frame_id").mapInArrow(run, SCHEMA)


def flash_events(vectors: DataFrame, threshold: float = 0.3) -> DataFrame:
    return vectors.where(F.col("flash") > threshold)
