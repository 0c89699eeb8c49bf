"""Bounded samples of labelled rows that the trained models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm import scratch


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, only=None) -> DataFrame:  # noqa: ANN001
    """(text, y) of at most ``limit`` labelled rows, the first by a hash of their id.

    ``only`` turns the id column into a condition on the rows that may be learnt
    from. Null ids and labels are passed over; of repeated ids in ``labels`` the
    smallest label counts. The sample is small enough to be broadcast by its
    bound, so the texts aren't shuffled.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    if only is not None:
        known = known.where(only(F.col("id")))
    known = scratch.keep(known.groupBy("id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("id")), "known")
    n = known.count()
    first = known
    if n > 4 * limit:  # about twice the rows wanted have hashes below this, so that no task sorts many more
        near = known.where(F.col("h") < -(2**63) + int(2**64 * (2 * limit / n)))
        first = near if near.count() >= limit else known
    chosen = scratch.keep(first.orderBy("h", "id").limit(limit).drop("h"), "labelled")
    return docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")
