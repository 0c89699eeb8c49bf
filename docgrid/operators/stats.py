"""Histograms and what follows from them: Otsu thresholds, percentiles, modes of preprocessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.scalars import gray

# Fixed values of the choice of a mode: the shares of pixels below the two percentiles, the high one under
# which a page is dark, and the distance of both under which it is flat.
LOW_SHARE, HIGH_SHARE = 0.05, 0.9
DARK_HIGH, FLAT = 225, 105


def with_gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("gray", gray(F.col("r"), F.col("g"), F.col("b")))


def histogram(pixels: DataFrame, key: str = "page_id", every: int = 1) -> DataFrame:
    """(key, gray, n); with ``every`` only each such pixel in row-major order counts."""
    chosen = pixels if every == 1 else pixels.where(F.pmod(F.col("y") * F.col("width") + F.col("x"), F.lit(every)) == 0)
    return with_gray(chosen).groupBy(key, "gray").agg(F.count(F.lit(1)).alias("n"))


def _between(hist: DataFrame, key: str) -> Column:
    """Between-class score of splitting after each gray; null where a class is empty."""
    upto = Window.partitionBy(key).orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    left, total = F.sum("n").over(upto), F.sum("n").over(whole)
    left_sum, all_sum = F.sum(F.col("n") * F.col("gray")).over(upto), F.sum(F.col("n") * F.col("gray")).over(whole)
    gap = F.when(left < total, left_sum / left - (all_sum - left_sum) / F.nullif(total - left, F.lit(0)))
    return gap * gap * left * (total - left)


def otsu(hist: DataFrame, key: str = "page_id", default: int = 127) -> DataFrame:
    """(key, threshold): the lowest gray with the best score; ``default`` where one class is always empty."""
    scored = hist.withColumn("score", _between(hist, key))
    best = F.max_by(F.when(F.col("score").isNotNull(), F.col("gray")), F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("gray")))
    return scored.groupBy(key).agg(F.coalesce(best, F.lit(default)).cast("int").alias("threshold"))


def ink_threshold(pixels: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, dark): Otsu's threshold on each fourth pixel if above 160, else 210."""
    scored = histogram(pixels, key, every=4)
    scored = scored.withColumn("score", _between(scored, key))
    best = F.max_by(F.when(F.col("score") > 0, F.col("gray")), F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("gray")))
    return scored.groupBy(key).agg(best.alias("t")).select(key, F.when(F.col("t") > 160, F.col("t")).otherwise(F.lit(210)).cast("int").alias("dark"))


def percentiles(hist: DataFrame, fractions: dict[str, float], key: str = "page_id") -> DataFrame:
    """A column for each name: the first gray that the fraction of pixels doesn't exceed."""
    upto = Window.partitionBy(key).orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    told = hist.withColumn("seen", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    least = [F.coalesce(F.min(F.when(F.col("seen") >= F.col("total") * F.lit(f), F.col("gray"))), F.lit(255)).cast("int").alias(n) for n, f in fractions.items()]
    return told.groupBy(key).agg(*least)


def auto_mode(hist: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, low, high, mode): preprocessing chosen from the 5th and 90th percentiles."""
    told = percentiles(hist, {"low": LOW_SHARE, "high": HIGH_SHARE}, key)
    mode = F.when(F.col("high") < DARK_HIGH, "sauvola").when(F.col("high") - F.col("low") < FLAT, "otsu").otherwise("none")
    return told.withColumn("mode", mode)
