"""Greedy decoding of a model's output, and the second look at uncertain lines.

The best class of each step is found in the model's own task (``best_arrays``), or by
higher-order functions on stored logits (``best_classes``). Collapse of repeats and the
joining of characters are higher-order functions on the steps, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What is kept of a step: its best class, and that class's logit (null where a model gives classes alone).
STEPS = "array<struct<best:int,top:float>>"
_STEP = (pa.field("best", pa.int32()), pa.field("top", pa.float32()))


def codec_array(codec: Mapping[int, str]) -> Column:
    """Characters at the places of their classes, one literal; classes without a character have empty ones."""
    characters = [codec.get(i, "") for i in range(1 + max(codec, default=0))]
    return F.from_json(F.lit(json.dumps(characters)), "array<string>")


def best_kernel(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[n, classes, steps] -> best class and its logit of each step; the first of equals, NaN below all."""
    values = np.where(np.isnan(logits), -np.inf, logits)
    best = values.argmax(axis=1)
    return best, np.take_along_axis(values, best[:, None], axis=1)[:, 0]


def best_arrays(best: np.ndarray, top: np.ndarray | None, valid: np.ndarray) -> pa.Array:
    """A list of ``STEPS`` for each line, of its valid steps alone."""
    many = np.clip(np.asarray(valid, np.int64), 0, best.shape[1])
    inside = np.arange(best.shape[1])[None, :] < many[:, None]
    tops = pa.nulls(int(many.sum()), pa.float32()) if top is None else pa.array(top[inside].astype(np.float32))
    steps = pa.StructArray.from_arrays([pa.array(best[inside].astype(np.int32)), tops], fields=_STEP)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), steps)


def confidences(best: np.ndarray, top: np.ndarray, valid: np.ndarray) -> list[float]:
    """The confidence that ``decode_steps`` gives each line."""
    out = []
    for b, t, v in zip(best, top, valid):
        b = b[: max(0, int(v))]
        emitted = (b != 0) & (b != np.concatenate([[0], b[:-1]]))[: len(b)]
        found = t[: len(b)][emitted].astype(np.float32).tolist()
        out.append(sum(found) / len(found) if found else 0.0)
    return out


def invert_codec(codec: Mapping[str, list[int]]) -> dict[int, str]:
    """Characters by class id; an id of two characters is an error."""
    out: dict[int, str] = {}
    for char, ids in codec.items():
        for i in ids:
            if i in out:
                raise ValueError(f"class {i} stands for {out[i]!r} and {char!r}")
            out[i] = char
    return out


def best_classes(logits: Column, classes: Column, steps: Column, valid: Column) -> Column:
    """Array of (best class, its logit) for each valid step; the first of equals, NaN below all."""
    none = F.struct(F.lit(0).alias("best"), F.lit(float("-inf")).cast("float").alias("top"))

    def at(t: Column) -> Column:
        def better(top: Column, c: Column) -> Column:
            value = F.get(logits, c * steps + t)
            return F.when((value > top["top"]) & ~F.isnan(value), F.struct(c.alias("best"), value.alias("top"))).otherwise(top)

        return F.aggregate(F.sequence(F.lit(0), classes - 1), none, better)

    many = F.least(steps, valid)
    return F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), at)).otherwise(F.array().cast("array<struct<best:int,top:float>>"))


def emissions(best: Column) -> Column:
    """Steps that write a character: neither blank (0) nor the class of the step before."""
    before = lambda i: F.coalesce(F.get(best, i - 1)["best"], F.lit(0))
    return F.filter(best, lambda s, i: (s["best"] != 0) & (s["best"] != F.when(i > 0, before(i)).otherwise(F.lit(0))))


def text_of(emitted: Column, codec: Mapping[int, str]) -> Column:
    known = codec_array(codec)
    return F.array_join(F.transform(emitted, lambda s: F.coalesce(F.get(known, s["best"]), F.lit(""))), "")


def decode(lines: DataFrame, codec: Mapping[int, str]) -> DataFrame:
    """``lines`` (logits, classes, steps, valid_steps, ...) with text and confidence, without the logits.

    Confidence is the mean of the raw largest logits over the emitted steps, 0
    without any. Classes that the codec lacks write nothing.
    """
    made = lines.withColumn("_e", emissions(best_classes(F.col("logits"), F.col("classes"), F.col("steps"), F.col("valid_steps"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, s: a + s["top"].cast("double"))
    confidence = F.when(F.size("_e") > 0, total / F.nullif(F.size("_e"), F.lit(0))).otherwise(F.lit(0.0))
    return made.withColumns({"text": text_of(F.col("_e"), codec), "confidence": confidence}).drop("_e", "logits")


def decode_steps(lines: DataFrame, codec: Mapping[int, str], steps: str = "steps", scored: str = "scored") -> DataFrame:
    """``lines`` with text and confidence in place of ``steps`` and ``scored``.

    Confidence is that of ``decode``, and null where a line isn't ``scored``, as of a
    model that gives classes alone. Lines whose steps are null have a null text.
    """
    made = lines.withColumn("_e", emissions(F.col(steps)))
    total = F.aggregate("_e", F.lit(0.0), lambda a, s: a + s["top"].cast("double"))
    confidence = F.when(F.col(scored), F.when(F.size("_e") > 0, total / F.nullif(F.size("_e"), F.lit(0))).otherwise(F.lit(0.0)))
    told = {"text": F.when(F.col(steps).isNotNull(), text_of(F.col("_e"), codec)), "confidence": F.when(F.col(steps).isNotNull(), confidence)}
    return made.withColumns(told).drop("_e", steps, scored)


def decode_ids(lines: DataFrame, codec: Mapping[int, str]) -> DataFrame:
    """``lines`` (class_ids, valid_steps, ...) with text; such models have no confidence (null)."""
    valid = F.slice("class_ids", F.lit(1), F.greatest(F.lit(0), F.least(F.size("class_ids"), F.col("valid_steps"))))
    made = lines.withColumn("_e", emissions(F.transform(valid, lambda c: F.struct(c.alias("best")))))
    return made.withColumns({"text": text_of(F.col("_e"), codec), "confidence": F.lit(None).cast("double")}).drop("_e", "class_ids")


def uncertain(results: DataFrame, threshold: float) -> DataFrame:
    """Results below the threshold; those without a confidence never are."""
    return results.where(F.col("confidence") < F.lit(threshold))


def overlay(results: DataFrame, again: DataFrame, key: list[str]) -> DataFrame:
    """``results`` with text and confidence of ``again`` where it has the line, for better or worse, and ``retried``."""
    new = again.select(*key, F.col("text").alias("_text"), F.col("confidence").alias("_confidence"), F.lit(True).alias("_again"))
    joined = results.join(new, key, "left")
    took = F.coalesce("_again", F.lit(False))
    return joined.withColumns({"text": F.when(took, F.col("_text")).otherwise(F.col("text")), "confidence": F.when(took, F.col("_confidence")).otherwise(F.col("confidence")), "retried": took}).drop("_text", "_confidence", "_again")
