"""From ``documents`` to token ids: five stages, each over all that the one before kept.

Quality classifier, exact dedup, near-dedup by shingles, benchmark decontamination,
BPE encoding. Each function takes (spark, docs, sf_dir) and returns a table;
``run`` stores it as Parquet in the folder that the cluster shares and reads it
back as the next stage's ``docs``; what a stage stored on its way is removed then. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm import block_names, chunked_bpe, near_sets, positional_index, scratch, subword_quality
from docgrid.llm.queries import WORD_BPE, table
from docgrid.llm.text import free_name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of ``documents``, doesn't reject."""
    model = subword_quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = free_name("quality", docs)
    return subword_quality.score(docs, model, name=name).where(F.col(name) >= 0.5).drop(name)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return block_names.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest doc_id."""
    return near_sets.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return positional_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their number and the digests of ids and decoded text."""
    return chunked_bpe.encode(docs, WORD_BPE, ["doc_id"], outputs=("token_ids",))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: The stages are not SQL; tests/llm hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023  called at once
        if name != STAGES[0][0]:
            scratch.let_go(before)
    return STAGES[-1][1](spark, docs, sf_dir)
