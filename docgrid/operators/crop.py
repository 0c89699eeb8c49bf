"""Boxes and regions: clipping, scaling, translation and crop templates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.scalars import half_up

#: Pixels added to a box on its left, top, right and bottom side (fixed values).
MARGINS = (10, 6, 11, 7)
#: Types of layout blocks that hold text: from flowing text to captions (fixed values of the layout engine's public list).
TEXT_BLOCKS = (1, 8)
#: Selections under so many pixels on a side are no crop.
LEAST_CROP = 8


def rescale(boxes: DataFrame, scale: float) -> DataFrame:
    """Boxes found on a page enlarged by ``scale``, in the page's own pixels."""
    return boxes if scale == 1 else boxes.withColumns({c: F.col(c) / F.lit(scale) for c in ("x0", "y0", "x1", "y1")})


def layout_dpi(scale: float) -> int:
    return int(200 * scale + 0.5)


def translate(boxes: DataFrame, dx: str | int, dy: str | int) -> DataFrame:
    """Boxes of a trimmed part of a page, moved to their place on it; columns or numbers."""
    at = [F.col(v) if isinstance(v, str) else F.lit(v) for v in (dx, dy)]
    return boxes.withColumns({"x0": F.col("x0") + at[0], "x1": F.col("x1") + at[0], "y0": F.col("y0") + at[1], "y1": F.col("y1") + at[1]})


def text_lines(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ord, x0, y0, x1, y1): lines of the blocks that hold text, in the order of blocks and lines.

    ``blocks``: key, block_no, type and lines, an array of boxes. ``ord`` counts a page's
    lines from 0; the lines before a block are the sum of the sizes of those ahead of it.
    """
    kept = blocks.where(F.col("type").between(*TEXT_BLOCKS) & (F.size("lines") > 0))
    ahead = Window.partitionBy(key).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("_before", F.coalesce(F.sum(F.size("lines")).over(ahead), F.lit(0)))
    told = placed.select(key, "_before", F.posexplode("lines").alias("_at", "_line"))
    return told.select(key, (F.col("_before") + F.col("_at")).alias("ord"), "_line.x0", "_line.y0", "_line.x1", "_line.y1")


def from_trimmed(boxes: DataFrame, trims: DataFrame, scale: float, key: str = "page_id") -> DataFrame:
    """Boxes found on the trimmed part of each page, enlarged by ``scale``, at their place on the page.

    ``trims``: key, x0, y0 of the part (``segment.trim_box``); pages without one are whole.
    """
    at = trims.select(key, F.col("x0").alias("_dx"), F.col("y0").alias("_dy"))
    joined = rescale(boxes, scale).join(at, key, "left").na.fill(0, ["_dx", "_dy"])
    return translate(joined, "_dx", "_dy").drop("_dx", "_dy")


def regions(boxes: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """``boxes`` with x, y, width and height of the padded box, clipped to the page."""
    width, height = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    left, top, right, bottom = MARGINS
    x, y = F.greatest(F.lit(0), F.col("x0") - left), F.greatest(F.lit(0), F.col("y0") - top)
    w = F.greatest(F.lit(1), F.least(width, F.col("x1") + right) - x)
    h = F.greatest(F.lit(1), F.least(height, F.col("y1") + bottom) - y)
    return boxes.withColumns({"x": x, "y": y, "width": w, "height": h})


def template(x0: float, y0: float, x1: float, y1: float, width: int, height: int) -> tuple[float, float, float, float] | None:
    """A dragged selection as fractions (x, y, w, h) of its page; None if it is too small."""
    w, h = abs(x1 - x0), abs(y1 - y0)
    return None if w < LEAST_CROP or h < LEAST_CROP else (min(x0, x1) / width, min(y0, y1) / height, w / width, h / height)


def apply_template(pages: DataFrame, crop: tuple[float, float, float, float]) -> DataFrame:
    """``pages`` (width, height, ...) with the crop in their pixels and the size of the result."""
    x, y, w, h = map(F.lit, crop)
    made = {"crop_x": x * F.col("width"), "crop_y": y * F.col("height"), "crop_w": w * F.col("width"), "crop_h": h * F.col("height")}
    made |= {"out_width": half_up(w * F.col("width")), "out_height": half_up(h * F.col("height"))}
    return pages.withColumns(made)


# -- plain form over one page ----------------------------------------------------------------------


def crop_pixels(crop: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int]:
    """x, y, width and height of a crop template on a page, in whole pixels within it."""
    x, y, w, h = (int(v * s + 0.5) for v, s in zip(crop, (width, height, width, height)))
    x, y = min(x, max(0, width - 1)), min(y, max(0, height - 1))
    return x, y, max(1, min(w, width - x)), max(1, min(h, height - y))


def text_boxes(found: np.ndarray) -> np.ndarray:
    """[n, 4] boxes of a layout provider, those of other blocks than text dropped where it tells their types."""
    found = np.asarray(found, float)
    if found.ndim == 2 and found.shape[1] == 5:
        low, high = TEXT_BLOCKS
        return found[(found[:, 4] >= low) & (found[:, 4] <= high), :4]
    return found.reshape(-1, 4)
