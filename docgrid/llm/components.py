"""Connected components of a graph of links between long nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, label): every node that has a link, with the smallest node it can reach.

    ``links`` has two long columns, ``a`` and ``b``. In each round a node takes
    the smallest label among its neighbours and then the label of that label, so
    that long chains shrink by halves. Rounds end when no label changes; each is
    stored, which cuts the lineage. Labels meet their neighbours by joins and
    partial minima only: no node's links are gathered in one row.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.keep(both, "links")
    now = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    if now.isEmpty():
        return now
    while True:
        heard = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        met = now.join(heard.withColumnRenamed("a", "node"), "node", "left")
        met = met.select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("next"))
        met = met.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label"))
        met = scratch.keep(met, "labels")
        now = met.select("node", "label")
        if met.where("old <> label").isEmpty():
            return now
