"""Column expressions on text that several operations share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty.

    ``lower`` does that for texts of ASCII alone, and far faster than ``translate``.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def crc32_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def free_name(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores before it as no column of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
