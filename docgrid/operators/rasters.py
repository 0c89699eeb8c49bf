"""Pages as one row each: the numpy kernels over whole rasters, for tables of pixels.

Box sums, neighbours and blank runs need a page's pixels side by side. As one row a page
they are gathered by one exchange of packed pixels, and a kernel sees each page once;
the forms on tables of pixels (``pixels``, ``segment``) take an exchange for each direction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.operators import pixels, segment

#: What a kernel makes of a page's r, g, b ([h, w, 3]) and of which of its pixels there are ([h, w]).
Kernel = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def each_row(batch: pa.RecordBatch) -> Iterator[tuple[pa.Scalar, ...]]:
    """A batch's rows, one at a time; their values are views, so no more than one page is ever a Python object."""
    return zip(*batch.columns)


def over_pages(px: DataFrame, kernel: Kernel, columns: dict[str, str], key: str = "page_id") -> DataFrame:
    """(key, columns): the rows that ``kernel`` gives for each page of ``px`` (key, x, y, width, height, r, g, b).

    ``columns`` has their Spark types, int or long. Pixels that the table lacks are white, and the
    kernel is told.
    """
    place = (F.col("y").cast("long") * F.col("width") + F.col("x")) * F.lit(1 << 24)
    packed = place + F.col("r") * F.lit(1 << 16) + F.col("g") * F.lit(1 << 8) + F.col("b")
    pages = px.groupBy(F.col(key).alias("key")).agg(F.max("width").alias("w"), F.max("height").alias("h"), F.collect_list(packed).alias("packed"))
    types = {c: pa.int32() if t == "int" else pa.int64() for c, t in columns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (w, h) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                cells = b.column(3)[i].values.to_numpy()
                at, rgb, known = cells >> 24, np.full((h * w, 3), 255, np.int64), np.zeros(h * w, bool)
                rgb[at] = cells[:, None] >> np.array([16, 8, 0]) & 255
                known[at] = True
                made = kernel(rgb.reshape(h, w, 3), known.reshape(h, w))
                cols = [pa.array(np.asarray(made[c]), t, from_pandas=True) if not isinstance(made[c], list) else pa.array(made[c], t) for c, t in types.items()]
                keys = pa.array([b.column(0)[i].as_py()] * len(cols[0]), b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([keys, *cols], names=[key, *types])

    kind = pages.schema["key"].dataType.simpleString()
    return pages.mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"`{c}` {t}" for c, t in columns.items())]))


def sauvola_rows(px: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, y, ink): pixels of ink in every row, as ``pixels.sauvola`` flags them."""

    def kernel(rgb: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
        ink = (pixels.sauvola_kernel(pixels.gray_kernel(rgb), known) > 0) & known
        rows = np.flatnonzero(known.any(axis=1))
        return {"y": rows, "ink": ink.sum(axis=1)[rows]}

    return over_pages(px, kernel, {"y": "int", "ink": "long"}, key)


def closing_rows(px: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, y, ink, closed): pixels of ink in every row, by the page's Otsu threshold, before and after ``pixels.closing``."""

    def kernel(rgb: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
        grays = pixels.gray_kernel(rgb)
        ink = (grays <= pixels.otsu_kernel(grays[known])) & known
        closed = pixels.closing_kernel(ink.astype(np.int64), known) * known
        rows = np.flatnonzero(known.any(axis=1))
        return {"y": rows, "ink": ink.sum(axis=1)[rows], "closed": closed.sum(axis=1)[rows]}

    return over_pages(px, kernel, {"y": "int", "ink": "long", "closed": "long"}, key)


def gutters(px: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, top, bottom, start, end, split) as ``segment.active_rows`` and ``segment.gutter`` tell them."""

    def kernel(rgb: np.ndarray, known: np.ndarray) -> dict[str, list]:
        dark = (rgb.sum(axis=-1) < 3 * segment.page_dark(rgb, known)) & known
        top, bottom, start, end, split = segment.gutter_kernel(dark, known.any(axis=0))
        return {"top": [top], "bottom": [bottom], "start": [start], "end": [end], "split": [split]}

    return over_pages(px, kernel, dict.fromkeys(("top", "bottom", "start", "end", "split"), "int"), key)
