"""What a model comes with: its codec as JSON, files embedded as base64, and files shipped to the executors."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.operators.decode import invert_codec
from docgrid.options import Options
from docgrid.sources.providers import Recogniser

CODEC_TYPE = "map<string,array<int>>"


def codec_rows(codecs: DataFrame, json: str = "codec") -> DataFrame:
    """``codecs`` with a row for each character and class of its JSON object: char, class.

    The object has the list of its classes for each character. What isn't such an object
    gives no rows.
    """
    told = codecs.select(*(c for c in codecs.columns if c != json), F.explode(F.from_json(json, CODEC_TYPE)).alias("char", "_ids"))
    return told.select(*(c for c in told.columns if c != "_ids"), F.explode("_ids").alias("class"))


def unpacked(embedded: Column) -> Column:
    """The bytes of an asset that is embedded as base64; null if it isn't base64."""
    return F.try_to_binary(embedded, F.lit("base64"))


def read_codec(spark: SparkSession, source: str | bytes) -> dict[int, str]:
    """Characters by class of one codec: a path to a JSON file, or the JSON as base64 (``bytes``).

    A codec is as small as a model's output layer. A class that stands for two
    characters, or a codec without any, is an error.
    """
    if isinstance(source, bytes):
        made = spark.createDataFrame([(source.decode(),)], "e string").select(unpacked(F.col("e")).cast("string").alias("codec"))
    else:
        made = spark.read.text(source, wholetext=True).withColumnRenamed("value", "codec")
    classes: dict[str, list[int]] = {}
    for r in codec_rows(made).collect():
        classes.setdefault(r["char"], []).append(r["class"])
    if not classes:
        raise ValueError("the codec names no classes")
    return invert_codec(classes)


def ship(spark: SparkSession, path: str) -> str:
    """Send a file to every executor, also to those that join later; the name that they know it by."""
    if "://" not in path and not os.path.isfile(path):
        raise FileNotFoundError(f"no file {path}")
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rpartition("/")[2]


class ShippedModel:
    """A recogniser whose file was shipped; opened by name, once in each Python worker.

    ``open_file`` takes the file's local path and a number of threads and returns a recogniser.
    """

    def __init__(self, name: str, open_file: Callable[[str, int], Recogniser], threads: int = 1):
        self.name, self.open_file, self.threads, self.opened = name, open_file, threads, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": None}

    def __call__(self, lines: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.opened is None:
            self.opened = self.open_file(SparkFiles.get(self.name), self.threads)
        return self.opened(lines, widths)


def model_of(spark: SparkSession, options: Options, open_file: Callable[[str, int], Recogniser]) -> ShippedModel:
    """The model that ``options`` name, shipped, with their number of threads."""
    if not options.model:
        raise ValueError("the options name no model")
    return ShippedModel(ship(spark, options.model), open_file, options.threads)
