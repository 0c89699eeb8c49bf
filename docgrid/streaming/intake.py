"""Pages from files as they arrive; the operators on single rows run on them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docgrid.options import Options
from docgrid.plans.recognise import prepare
from docgrid.sources.images import from_images


#: What Spark's image source reads; a stream must name it.
IMAGE_SCHEMA = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def image_stream(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the image files that appear in a folder."""
    return from_images(spark.readStream.schema(IMAGE_SCHEMA).format("image").load(path))


def store_lines(pages: DataFrame, options: Options, out: str, checkpoint: str) -> StreamingQuery:
    """Write the lines of all pages that are there, each once, and end."""
    lines = prepare(pages, options).drop("rgb")
    return lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
