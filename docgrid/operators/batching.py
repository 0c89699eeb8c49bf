"""Batches of lines of like width for the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.scalars import ceiling_width, prepared_width
from docgrid.options import Options
from docgrid.sources import stored


def with_width(lines: DataFrame, options: Options) -> DataFrame:
    return lines.withColumn("prepared", prepared_width(F.col("width"), F.col("height"), F.lit(options.scale), options.pad, options.line_height))


def _numbered(lines: DataFrame, order: list[str]) -> DataFrame:
    """``lines`` with ``number``: the row's place, from 0, in its bucket by ``order``.

    Rows are dealt out by range of bucket and order, and numbered where they are. Only
    the counts a bucket and partition, at most one more than there are partitions and
    buckets together, are summed up in order; so no window gathers a bucket, whatever
    its keys are.
    """
    dealt = lines.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
    dealt = stored.kept(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = dealt.groupBy("bucket", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    numbered = dealt.join(F.broadcast(counts), ["bucket", "_part"])
    return numbered.withColumn("number", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def plan(lines: DataFrame, options: Options, across_pages: bool = True) -> DataFrame:
    """``lines`` (page_id, line_no, width, height) with prepared, bucket, batch_no, batch_width.

    Lines are batched within buckets of width in the order of pages and lines,
    or with ``options.sort`` in order of width alone (bucket 0). Batches mix pages
    unless ``across_pages`` is false. ``batch_width`` is what all of a batch are
    padded to: its widest line, or the least fixed width that holds it.
    """
    made = with_width(lines, options)
    made = made.withColumn("bucket", F.lit(0) if options.sort else F.ceil(F.col("prepared") / options.bucket).cast("int"))
    order = (["prepared"] if options.sort else []) + ["page_id", "line_no"]
    if not across_pages:
        keys = ["page_id", "bucket"]
        made = made.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    else:
        keys = ["bucket"]
        made = _numbered(made, order)
    made = made.withColumn("batch_no", F.floor(F.col("number") / options.batch)).drop("number")
    widest = F.max("prepared").over(Window.partitionBy(*keys, "batch_no"))
    return made.withColumn("batch_width", ceiling_width(widest, options.widths))
