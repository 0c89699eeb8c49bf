"""Figures of a run: retries, median confidence, error rate, throughput."""

from __future__ import annotations

import time
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Half the share of confidences around the middle that the exact median is sought among.
BRACKET = 0.001


def run_summary(results: DataFrame) -> DataFrame:
    """One row: lines, retried, confidence_median (upper median of finite confidences, null without any).

    Approximate quantiles bracket the middle; only the few confidences between
    them are sorted for the exact one.
    """
    c = F.col("confidence")
    finite = results.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))).select("confidence")
    n, edges = finite.agg(F.count(F.lit(1)), F.percentile_approx("confidence", [0.5 - BRACKET, 0.5 + BRACKET], int(2 / BRACKET))).first()
    told = results.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.coalesce("retried", F.lit(False))).alias("retried"))
    if not n:
        return told.withColumn("confidence_median", F.lit(None).cast("double"))
    low, high = edges
    below, within = finite.agg(F.count_if(c < low), F.count_if(c.between(low, high))).first()
    at = n // 2 - below
    near = finite.where(c.between(low, high)) if 0 <= at < within else finite  # the quantiles missed: sort all
    at = at if 0 <= at < within else n // 2
    return told.withColumn("confidence_median", F.lit(near.orderBy("confidence").offset(at).limit(1).first()[0]))


def _codes(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)


def _in_columns(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance, a column of the table at a time as the bits of two numbers (Myers' bit vectors)."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return len(b)
    where = {c: int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") for c in np.intersect1d(a, b).tolist()}
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b.tolist():
        same = where.get(c, 0)
        x = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(h | up)), up & h
        score += 1 if more & last else -1 if less & last else 0
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(x | more)) & full, more & x
    return score


def distance(ref: str, hyp: str) -> int:
    """Edit distance in characters.

    At least as many edits are needed as characters of some kind are in excess on a side. Mistakes
    of recognition mostly reach this bound, place by place or word by word, which costs no more
    than reading the texts; what doesn't is worked out in full.
    """
    if ref == hyp:
        return 0
    a, b = _codes(ref), _codes(hyp)
    excess = np.bincount(a & 255, minlength=256) - np.bincount(b & 255, minlength=256)
    least = int(max(excess[excess > 0].sum(), -excess[excess < 0].sum()))
    if len(a) == len(b) and np.count_nonzero(a != b) == least:
        return least
    words, others = ref.split(" "), hyp.split(" ")
    if len(words) == len(others) > 1:
        found = 0
        for x, y in zip(words, others):
            if x != y:
                found += _of_words(x, y) if len(x) + len(y) <= 64 else distance(x, y)
                if found > least:
                    break
        if found == least:
            return least
    return _in_columns(a, b)


@lru_cache(1 << 15)
def _of_words(x: str, y: str) -> int:
    return _in_columns(_codes(x), _codes(y))


def edit_distance(ref: Column, hyp: Column) -> Column:
    """As ``F.levenshtein``, whose time is the product of the lengths; null where a side is."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([distance(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(a, b)], pa.int32())

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")(ref, hyp)


def character_error_rate(pairs: DataFrame, key: str) -> DataFrame:
    """(key, errors, chars, cer): edit distance over the length of the references."""
    told = pairs.withColumn("edits", edit_distance(F.col("ref"), F.col("hyp"))).groupBy(key).agg(F.sum("edits").alias("errors"), F.sum(F.length("ref")).alias("chars"))
    return told.withColumn("cer", F.col("errors") / F.nullif(F.col("chars"), F.lit(0)))


def throughput(timings: DataFrame, key: str, seconds: str) -> DataFrame:
    """(key, pages, seconds, pages_per_second), rounded to 6 digits as sums of doubles depend on their order."""
    told = timings.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.round(F.sum(seconds), 6).alias("seconds"))
    return told.withColumn("pages_per_second", F.round(F.col("pages") / F.nullif(F.col("seconds"), F.lit(0.0)), 6))


class RunTimings:
    """Seconds of a run's stages, added up in its tasks, and what it counted on the way.

    Pass one to ``recognise`` and ask it after the result was written or counted. Stage
    seconds are those of all tasks together; tasks that Spark had to run again count
    again. The counts come with the first action on what ``watch`` returned.
    """

    def __init__(self, spark: SparkSession):
        self.layout, self.inference = spark.sparkContext.accumulator(0.0), spark.sparkContext.accumulator(0.0)
        self.spark, self.began, self.counted = spark, time.perf_counter(), None

    def watch(self, results: DataFrame) -> DataFrame:
        """``results`` of pages (line_count, error), observed as they pass."""
        self.counted = Observation()
        return results.observe(self.counted, F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"), F.count("error").alias("failed"))

    def table(self) -> DataFrame:
        """One row: seconds since the start, layout_seconds, inference_seconds, pages, lines, failed."""
        counts = self.counted.get if self.counted else {"pages": None, "lines": None, "failed": None}
        row = (time.perf_counter() - self.began, self.layout.value, self.inference.value, counts["pages"], counts["lines"], counts["failed"])
        return self.spark.createDataFrame([row], "seconds double, layout_seconds double, inference_seconds double, pages long, lines long, failed long")
