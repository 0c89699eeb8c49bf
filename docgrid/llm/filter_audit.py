"""How filters interact: a Walsh-Hadamard audit of every order of them.

Each document gets a mask with one bit for each filter that it fails. For every
part and label the signed parity sums of the masks are added up, one for each
subset of filters: a document counts -1 where it fails an odd number of the
subset, else +1. That is the Walsh-Hadamard transform of the number of documents
a mask; transformed back, divided by the number of subsets, it gives these numbers
exactly. All orders of the filters are judged on them alone, so the documents
are read once and what is shuffled has a row a part, label and task.

A filter's Shapley value over all orders needs no orders: of a document that fails
k filters, each of them is the first in one order of k.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm import scratch

#: The filters' letters, in the order of their bits.
FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"


def _failing(text: Column) -> list[Column]:
    """Conditions of filters A to D on one text."""
    words = F.array_remove(F.split(text, WHITE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Stored (id, part, mask): the filters that every row of ``docs`` fails.

    Null texts are empty, a null part is the empty string. The last filter, E, fails
    where a row with a smaller id has the same text: the texts' least ids are joined
    back on digest and id together, so that no large group of copies meets in one
    task. A row with a null id never fails it, and rows that repeat the least id of
    their text don't either.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(_failing(t))), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(t, 256)).alias("digest"))
    rows = scratch.keep(scratch.spread(rows), "bits")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    told = rows.join(first, ["digest", "id"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return scratch.keep(told.select("id", "part", (F.col("bits") + F.when(copy, 1 << 4).otherwise(0)).cast("int").alias("mask")), "masks")


def with_labels(rows: DataFrame, labels: DataFrame, names: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``rows`` (id, ...) with a boolean for each label: whether it is 1.

    Rows without a label have false; of labels that repeat an id the smallest counts.
    Null ids, however many, are dealt out by their row's mask and never match.
    """
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(*(F.min(n).alias(n) for n in names))
    joined = rows.where("id is not null").join(known, "id", "left").unionByName(rows.where("id is null"), allowMissingColumns=True)
    return joined.withColumns({n: F.coalesce(F.col(n) == 1, F.lit(False)) for n in names})


def _sign(mask: Column, subset: Column) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(subset)) % 2)


def parity_sums(rows: DataFrame, keys: list[str], filters: int) -> DataFrame:
    """A row for each of ``keys`` with ``sums``, the signed parity sum of every subset of the filters."""
    sums = [F.sum(_sign(F.col("mask"), F.lit(k))).alias(f"s{k}") for k in range(1 << filters)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*(f"s{k}" for k in range(1 << filters))).alias("sums"))


def mask_cells(sums: DataFrame, keys: list[str], filters: int) -> DataFrame:
    """(keys, mask, n): the number of rows of every mask, zeros included, by the inverse transform."""
    subsets = F.sequence(F.lit(0), F.lit((1 << filters) - 1))

    def count(mask: Column) -> Column:
        total = F.aggregate(subsets, F.lit(0).cast("long"), lambda a, k: a + F.get("sums", k) * _sign(mask, k))
        return F.shiftright(total, filters)  # exact: the sum is a multiple of the number of subsets

    return sums.select(*keys, F.posexplode(F.transform(subsets, count)).alias("mask", "n"))


def audit(rows: DataFrame, letters: str, good: str, toxic: str) -> DataFrame:
    """One row a part, order of the filters and step: what the step's filter does to the part's documents.

    ``rows``: part, mask and two boolean labels. Columns: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley. An empty table
    has no parts.
    """
    n = len(letters)
    cells = mask_cells(parity_sums(rows, ["part", good, toxic], n), ["part", good, toxic], n)
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    cells = scratch.keep(cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), count(F.col(good)).alias("good"), count(F.col(toxic)).alias("toxic")), "cells")

    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(letters))), " ")
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.substring("filter_order", at, F.lit(1))) - 1)
    before = sum((F.when(F.col("step") > k, bit(F.lit(k))).otherwise(0) for k in range(1, n)), F.lit(0))
    steps = steps.withColumn("bit", bit(F.col("step"))).withColumn("before", before)
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(0))
    share = F.col("n") * (F.lit(factorial(n)) / F.greatest(F.lit(1), F.bit_count("mask"))).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters on ``docs``, by ``labels``' quality and toxic."""
    rows = with_labels(masks(docs), labels, ["quality", "toxic"])
    return audit(rows, FILTERS, "quality", "toxic")
