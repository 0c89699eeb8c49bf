"""Pages from image and PDF files.

A page is one row: page_id, width, height, rgb (row-major bytes), error. Files
that can't be decoded keep their row, with the reason in ``error``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.sources.providers import Rasteriser, no_rasteriser

PAGE_SCHEMA = "page_id string, width int, height int, rgb binary, error string"


def on_white(data: np.ndarray) -> np.ndarray:
    """RGB of a raster of 1, 3 or 4 channels as Spark's image source stores it (BGR order), laid on white."""
    if data.shape[2] == 1:
        return np.repeat(data, 3, axis=2)
    rgb = data[:, :, 2::-1].astype(np.float64)
    if data.shape[2] == 4:
        alpha = data[:, :, 3:].astype(np.float64) / 255
        rgb = rgb * alpha + 255 * (1 - alpha)
    return np.floor(rgb + 0.5).astype(np.uint8)


def _to_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for origin, height, width, channels, data in zip(*(c.to_pylist() for c in b.columns)):
            row = [origin, None, None, None, "the file can't be decoded as an image"]
            if width is not None and width > 0 and height > 0:
                raster = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                row = [origin, width, height, on_white(raster).tobytes(), None]
            types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["page_id", "width", "height", "rgb", "error"])


def image_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page for each image file of a folder."""
    return from_images(spark.read.format("image").load(path))


def from_images(images: DataFrame) -> DataFrame:
    """Pages of a DataFrame of Spark's image source, also a streaming one."""
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(_to_pages, PAGE_SCHEMA)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content): kind is pdf by the file's name, else image."""
    kind = F.when(F.lower("path").endswith(".pdf"), "pdf").otherwise("image")
    return spark.read.format("binaryFile").load(path).select("path", kind.alias("kind"), "content")


def page_numbers(documents: DataFrame) -> DataFrame:
    """A row for each page of (doc_id, page_count, ...), page_no from 1; none for counts below 1."""
    return documents.where("page_count >= 1").withColumn("page_no", F.explode(F.sequence(F.lit(1), F.col("page_count"))))


def pdf_pages(documents: DataFrame, rasteriser: Rasteriser = no_rasteriser, scale: float = 2.0) -> DataFrame:
    """Pages of (path, content, page_no) rows, drawn by ``rasteriser``; failures go to ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, number in zip(*(c.to_pylist() for c in b.columns)):
                name = f"{path}#{number}"
                try:
                    rgb = rasteriser(content, number, scale)
                    row = [name, rgb.shape[1], rgb.shape[0], np.ascontiguousarray(rgb).tobytes(), None]
                except Exception as e:  # noqa: BLE001  a page's failure is that page's result
                    row = [name, None, None, None, str(e)]
                types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["page_id", "width", "height", "rgb", "error"])

    return documents.select("path", "content", "page_no").mapInArrow(run, PAGE_SCHEMA)
