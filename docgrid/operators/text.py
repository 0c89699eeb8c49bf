"""Page texts from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Soft hyphen and the not sign that models write for a hyphen at a line's end (fixed values).
HYPHENS = "­¬"


def clean(text: Column) -> Column:
    """Join words that a hyphen mark splits over a line's end, and drop marks left over."""
    return F.regexp_replace(F.regexp_replace(text, f"[{HYPHENS}]\\r?\\n", ""), f"[{HYPHENS}]", "")


def page_text(lines: DataFrame, key: str = "page_id", order: str = "line_no", text: str = "text") -> DataFrame:
    """(key, line_count, text): a page's lines in order, joined and cleaned; null lines count as empty."""
    line = F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["t"]), "\n")
    return lines.groupBy(key).agg(F.count(F.lit(1)).alias("line_count"), clean(joined).alias("text"))


def with_empty_pages(pages: DataFrame, texts: DataFrame, key: str = "page_id") -> DataFrame:
    """Every page of ``pages``; those without lines have line_count 0 and an empty text."""
    return pages.select(key).join(texts, key, "left").withColumns({"line_count": F.coalesce("line_count", F.lit(0)), "text": F.coalesce("text", F.lit(""))})
