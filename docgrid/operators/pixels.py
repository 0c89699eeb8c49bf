"""Line preprocessing: relational forms for tables of pixels, numpy kernels for rasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.operators.stats import DARK_HIGH, FLAT, HIGH_SHARE, LOW_SHARE, histogram, otsu, with_gray

#: Weights of r, g and b in a pixel's luma, of 256 (fixed values).
LUMA = (77, 150, 29)
# Fixed values of the local threshold: half the side of its box, how far the spread moves it, and the spread that doesn't.
RADIUS = 12
BIAS = 0.2
SPREAD = 128.0


def sauvola(pixels: DataFrame, key: str = "page_id") -> DataFrame:
    """``pixels`` with gray and a local ``ink`` flag.

    Box sums are taken along rows, then along columns; clipped frames clip the
    box at the borders. Sums are integers, so their order doesn't matter.
    """
    across = Window.partitionBy(key, "y").orderBy("x").rowsBetween(-RADIUS, RADIUS)
    down = Window.partitionBy(key, "x").orderBy("y").rowsBetween(-RADIUS, RADIUS)
    g = F.col("gray").cast("long")
    rows = with_gray(pixels).withColumns({"s1": F.sum(g).over(across), "s2": F.sum(g * g).over(across), "s0": F.count("gray").over(across)})
    box = rows.withColumns({c: F.sum(c).over(down) for c in ("s1", "s2", "s0")})
    mean = F.col("s1") / F.col("s0")
    box = box.withColumn("mean", mean).withColumn("var", F.greatest(F.lit(0.0), F.col("s2") / F.col("s0") - F.col("mean") * F.col("mean")))
    limit = F.col("mean") * (F.lit(1.0) + F.lit(BIAS) * (F.sqrt("var") / F.lit(SPREAD) - F.lit(1.0)))
    return box.withColumn("ink", (F.col("gray") <= limit).cast("int")).drop("s0", "s1", "s2", "mean", "var")


def binary(pixels: DataFrame, key: str = "page_id") -> DataFrame:
    """``pixels`` with gray and an ``ink`` flag by the page's Otsu threshold."""
    limit = otsu(histogram(pixels, key), key)
    return with_gray(pixels).join(limit, key).withColumn("ink", (F.col("gray") <= F.col("threshold")).cast("int")).drop("threshold")


def closing(inked: DataFrame, key: str = "page_id") -> DataFrame:
    """``inked`` with ``closed``: ink spread to both neighbours of a row, then drawn back."""
    near = Window.partitionBy(key, "y").orderBy("x").rowsBetween(-1, 1)
    spread = inked.withColumn("spread", F.max("ink").over(near))
    return spread.withColumn("closed", F.min("spread").over(near)).drop("spread")


# -- numpy kernels over one raster ---------------------------------------------------------------


def gray_kernel(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb.astype(np.int64).sum(axis=-1) / 3 + 0.5).astype(np.int64)


def binary_kernel(rgb: np.ndarray, threshold: int) -> np.ndarray:
    """A page in black and white alone: black where the luma is under ``threshold``."""
    luma = (rgb.astype(np.int64) @ np.array(LUMA)) >> 8
    return np.repeat(np.where(luma < threshold, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)


def otsu_kernel(grays: np.ndarray, default: int = 127, floor: float = -1.0) -> int:
    """Lowest gray whose split scores above ``floor`` and best."""
    n = np.bincount(grays.ravel(), minlength=256).astype(np.float64)
    left, left_sum = np.cumsum(n), np.cumsum(n * np.arange(256))
    total, both = left[-1], (left > 0) & (left < left[-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(both, (left_sum / left - (left_sum[-1] - left_sum) / (total - left)) ** 2 * left * (total - left), -np.inf)
    best = int(np.argmax(score))
    return best if score[best] > floor else default


def percentile_kernel(grays: np.ndarray, fraction: float) -> int:
    seen = np.cumsum(np.bincount(grays.ravel(), minlength=256))
    at = np.flatnonzero(seen >= grays.size * fraction)
    return int(at[0]) if len(at) else 255


def sauvola_kernel(grays: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Ink flags by box sums from integral images; pixels that aren't ``known`` count in no box."""
    h, w = grays.shape
    there = np.ones((h, w), np.int64) if known is None else known.astype(np.int64)
    values = grays * there
    table = np.zeros((3, h + 1, w + 1), np.int64)
    for t, v in zip(table, (values, values * values, there)):
        t[1:, 1:] = v.cumsum(0).cumsum(1)
    y, x = np.arange(h), np.arange(w)
    top, bottom = np.maximum(y - RADIUS, 0), np.minimum(y + RADIUS + 1, h)
    left, right = np.maximum(x - RADIUS, 0), np.minimum(x + RADIUS + 1, w)
    s, q, count = (t[bottom][:, right] - t[top][:, right] - t[bottom][:, left] + t[top][:, left] for t in table)
    count = np.maximum(count, 1)
    mean = s / count
    spread = np.sqrt(np.maximum(0, q / count - mean * mean))
    return (grays <= mean * (1 + BIAS * (spread / SPREAD - 1))).astype(np.float32)


def closing_kernel(inked: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Ink spread to both neighbours of a row, then drawn back; pixels that aren't ``known`` neither spread nor draw."""
    beside = lambda v, edge, f: f(f(p[:, :-2], p[:, 1:-1]), p[:, 2:]) if (p := np.pad(v, ((0, 0), (1, 1)), constant_values=edge)).size else v
    out = beside(inked, 0, np.maximum)
    if known is not None:
        out = np.where(known, out, 1)
    return beside(out, 1, np.minimum)


def preprocess(rgb: np.ndarray, mode: str = "none") -> np.ndarray:
    """Darkness (none) or ink flags of a line's raster, as float32."""
    grays = gray_kernel(rgb)
    if mode == "auto":
        low, high = percentile_kernel(grays, LOW_SHARE), percentile_kernel(grays, HIGH_SHARE)
        mode = "sauvola" if high < DARK_HIGH else "otsu" if high - low < FLAT else "none"
    if mode == "sauvola":
        return sauvola_kernel(grays)
    if mode == "none":
        return (1 - grays / 255).astype(np.float32)
    inked = (grays <= otsu_kernel(grays)).astype(np.float32)
    return closing_kernel(inked) if mode == "morph" else inked
