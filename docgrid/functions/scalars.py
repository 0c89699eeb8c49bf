"""Scalar rules on pixels, boxes and lines, as columns that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_HEIGHT = 48


def half_up(value: Column) -> Column:
    """Nearest integer, halves upwards also below zero."""
    return F.floor(value + F.lit(0.5)).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Rounded mean of the channels."""
    return half_up((r + g + b) / F.lit(3.0))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Weighted brightness in integers."""
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def ink(gray_value: Column) -> Column:
    """Darkness from 0 to 1 of a rounded gray."""
    return (F.lit(1.0) - gray_value / F.lit(255.0)).cast("float")


def ink_unrounded(r: Column, g: Column, b: Column) -> Column:
    """Darkness from 0 to 1 without rounding the gray first."""
    return (F.lit(1.0) - (r + g + b) / F.lit(765.0)).cast("float")


def darker_than(r: Column, g: Column, b: Column, dark: Column) -> Column:
    return (r + g + b) / F.lit(3.0) < dark


def upper_median(values: Column) -> Column:
    """Element floor(n / 2) of the ascending array; null if it is empty."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def prepared_width(width: Column, height: Column, scale: Column, pad: int, line_height: int = LINE_HEIGHT) -> Column:
    """Pixels that a line takes once it is as high as the model's input, and padded."""
    return F.greatest(F.lit(1), half_up(width * F.lit(float(line_height)) / height * scale)) + 2 * pad


def ceiling_width(width: Column, widths: tuple[int, ...]) -> Column:
    """Least of the fixed widths that holds ``width``; itself if none does."""
    if not widths:
        return width
    return F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, widths)), lambda v: v >= width)), width)
