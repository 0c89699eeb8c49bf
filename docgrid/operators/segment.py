"""Finding text lines on a page from its ink: profiles, bands, rules and gutters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.scalars import darker_than, half_up, upper_median
from docgrid.operators.pixels import gray_kernel, otsu_kernel

#: Pixels darker than this count for rules, whatever the page's threshold.
RULE_DARK = 160
# Fixed values of the segmentation. A page's threshold is measured on every SAMPLE-th pixel, NO_DARK where it is too low.
# Bands: a row's share of the width at the two thresholds, their least, the rows of a band, what counts as typical and
# what is tall. Rules: the columns looked at and the share of the height that a rule has. Gutters: the dark pixels of an
# active row, the columns looked at, the share of rows that may be dark, the least share of the width. Headers: how low they
# begin, the share of the width and of the typical height of a rule.
SAMPLE, NO_DARK = 4, 210
BAND_LOW, BAND_HIGH, LEAST_INK, LEAST_BAND, LARGE_BAND, USUAL_BAND, TALL = 200, 60, 4.0, 4, 100, 40, 1.65
RULE_FROM, RULE_TO, RULE_SHARE = 0.55, 0.9, 0.18
ACTIVE, MIDDLE, FEW, GUTTER = 4, (0.25, 0.75), 80, 0.015
HEADER_TOP, HEADER_WIDTH, HEADER_TALL = 0.1, 0.85, 0.55
#: Trimming (fixed values): how far a page is reduced, the sum of r, g and b from which a pixel is
#: white, the margin around what isn't, and the share of the page from which it isn't worth it.
TRIM_FACTOR = 8
TRIM_WHITE = 720
TRIM_MARGIN = 48
TRIM_WHOLE = 0.95


def _is_dark(limit: Column | int) -> Column:
    return darker_than(F.col("r"), F.col("g"), F.col("b"), F.lit(limit) if isinstance(limit, int) else limit)


def row_profile(pixels: DataFrame, dark: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, y, ink): dark pixels at even x of every row, rows without any included."""
    hit = F.count_if((F.col("x") % 2 == 0) & _is_dark(F.col("dark")))
    return pixels.join(dark, key).groupBy(key, "y").agg(hit.alias("ink"))


def runs(rows: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """(keys, start, end): maximal runs of consecutive ``at``, the end exclusive."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    return rows.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end")).drop("_island")


def bands(profile: DataFrame, width: float, key: str = "page_id", least: int = LEAST_BAND) -> DataFrame:
    """(key, start, end): rows of text.

    Runs of at least ``least`` rows at the low threshold; runs over 1.65 times the
    typical height are cut again at the high one, and may leave none.
    """
    low, high = max(LEAST_INK, width / BAND_LOW), max(LEAST_INK, width / BAND_HIGH)
    inked = profile.where(F.col("ink") >= low)
    inked = inked.withColumn("island", F.col("y") - F.row_number().over(Window.partitionBy(key).orderBy("y")))
    size = F.col("end") - F.col("start")
    first = inked.groupBy(key, "island").agg(F.min("y").alias("start"), (F.max("y") + 1).alias("end")).where(size >= least)
    typical = F.coalesce(F.nullif(upper_median(F.filter(F.collect_list(size).over(Window.partitionBy(key)), lambda s: s < LARGE_BAND)), F.lit(0)), F.lit(USUAL_BAND))
    first = first.withColumn("tall", size > typical * F.lit(TALL))
    again = inked.where(F.col("ink") >= high).join(first.where("tall").select(key, "island"), [key, "island"])
    again = runs(again, "y", [key, "island"]).where(size >= least)
    return first.where("not tall").select(key, "start", "end").union(again.select(key, "start", "end"))


def rule_column(pixels: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, x, ink): the column from 55 % to 90 % of the width with most dark pixels, the first of equals.

    Every second column and row is looked at; without ink x and ink are 0.
    """
    first = F.floor(F.col("width") * F.lit(RULE_FROM))
    seen = pixels.where((F.col("x") >= first) & (F.col("x") < F.col("width") * F.lit(RULE_TO)) & (F.pmod(F.col("x") - first, F.lit(2)) == 0) & (F.col("y") % 2 == 0))
    ink = seen.groupBy(key, "x").agg(F.count_if(_is_dark(RULE_DARK)).alias("ink")).where("ink > 0")
    best = ink.groupBy(key).agg(F.max_by("x", F.struct("ink", -F.col("x"))).alias("x"), F.max("ink").alias("ink"))
    return pixels.select(key).distinct().join(best, key, "left").select(key, F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("ink", F.lit(0)).alias("ink"))


def rule_extent(pixels: DataFrame, rule: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, top, bottom): first and last row where the rule's column is dark; height and 0 without any."""
    col = pixels.join(rule.select(key, F.col("x").alias("rule_x")), key).where("x = rule_x")
    hit = F.when(_is_dark(RULE_DARK), F.col("y"))
    return col.groupBy(key).agg(F.coalesce(F.min(hit), F.max("height")).alias("top"), F.coalesce(F.max(hit), F.lit(0)).alias("bottom"))


def active_rows(pixels: DataFrame, dark: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, top, bottom): first and last even row with four dark pixels at every fourth x; both the last even row without any."""
    rows = pixels.join(dark, key).where("y % 2 = 0").groupBy(key, "y").agg(F.count_if((F.col("x") % 4 == 0) & _is_dark(F.col("dark"))).alias("ink"), F.max("height").alias("height"))
    last, hit = F.floor((F.max("height") - 1) / 2) * 2, F.when(F.col("ink") >= ACTIVE, F.col("y"))
    return rows.groupBy(key).agg(F.coalesce(F.min(hit), last).cast("int").alias("top"), F.coalesce(F.max(hit), last).cast("int").alias("bottom"))


def gutter(pixels: DataFrame, dark: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, start, end, split): the longest blank run of columns in the middle half, the first of equals.

    ``split`` is null where the run is under 1.5 % of the width. A run that
    reaches the last column looked at ends there.
    """
    low, high = (F.floor(F.col("width") * F.lit(share)) for share in MIDDLE)
    seen = pixels.join(dark, key).join(active_rows(pixels, dark, key), key).where(F.col("x").between(low, high))
    counted = (F.col("y") >= F.col("top")) & (F.col("y") <= F.col("bottom")) & (F.pmod(F.col("y") - F.col("top"), F.lit(4)) == 0)
    cols = seen.groupBy(key, "x").agg(F.count_if(counted & _is_dark(F.col("dark"))).alias("ink"), F.max("top").alias("top"), F.max("bottom").alias("bottom"), F.max("width").alias("width"))
    blank = cols.where(F.col("ink") <= (F.col("bottom") - F.col("top") + 1) / F.lit(float(FEW)))
    found = runs(blank, "x", [key]).join(cols.groupBy(key).agg(F.max("width").alias("width")), key)
    found = found.withColumn("end", F.least(F.col("end"), high)).where("end > start")
    best = found.groupBy(key).agg(F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("b"), F.max("width").alias("width"))
    wide = (F.col("b.end") - F.col("b.start")) >= F.col("width") * F.lit(GUTTER)
    best = best.select(key, "b.start", "b.end", F.when(wide, half_up((F.col("b.start") + F.col("b.end")) / 2)).alias("split"))
    return pixels.select(key).distinct().join(best, key, "left").select(key, F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end"), "split")


def ink_box(pixels: DataFrame, dark: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, start, end, left, right): the span of dark even columns in a band's rows and six more on either side."""
    lines = found.select(key, "start", "end").withColumn("row", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - 6), F.col("end") + 5)))
    hits = pixels.where("x % 2 = 0").join(dark, key).where(_is_dark(F.col("dark"))).groupBy(key, F.col("y").alias("row")).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    span = lines.join(hits, [key, "row"], "left").groupBy(key, "start", "end").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    wide = pixels.groupBy(key).agg(F.max("width").alias("width"))
    left = F.greatest(F.lit(0), F.coalesce("low", F.col("width")) - 12)
    right = F.least(F.col("width"), F.coalesce("high", F.lit(0)) + 14)
    return span.join(wide, key).select(key, "start", "end", left.alias("left"), F.greatest(right, left + 1).alias("right"))


def trim_box(pixels: DataFrame, key: str = "page_id", factor: int = TRIM_FACTOR, margin: int = TRIM_MARGIN) -> DataFrame:
    """(key, x0, y0, x1, y1): the box of what isn't white on a page reduced by ``factor``, in page pixels.

    ``pixels`` is the reduced page. Boxes of 95 % of the page or more, and pages
    without ink or with ink in one reduced row or column alone, give the whole page.
    """
    hit = (F.col("r") + F.col("g") + F.col("b")) < TRIM_WHITE
    box = pixels.groupBy(key).agg(
        *(f(F.when(hit, F.col(c))).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("low_", F.min), ("high_", F.max))),
        (F.max("width") * factor).alias("w"),
        (F.max("height") * factor).alias("h"),
    )
    edges = {
        "x0": F.greatest(F.lit(0), F.col("low_x") * factor - margin),
        "y0": F.greatest(F.lit(0), F.col("low_y") * factor - margin),
        "x1": F.least(F.col("w"), (F.col("high_x") + 1) * factor + margin),
        "y1": F.least(F.col("h"), (F.col("high_y") + 1) * factor + margin),
    }
    box = box.withColumns(edges)
    use = F.coalesce((F.col("high_x") > F.col("low_x")) & (F.col("high_y") > F.col("low_y")) & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < F.col("w") * F.col("h") * F.lit(TRIM_WHOLE)), F.lit(False))
    whole = {"x0": F.lit(0), "y0": F.lit(0), "x1": F.col("w"), "y1": F.col("h")}
    return box.select(key, *(F.when(use, F.col(c)).otherwise(v).cast("int").alias(c) for c, v in whole.items()))


def without_running_header(lines: DataFrame, height: int, width: int, key: str = "page_id") -> DataFrame:
    """``lines`` (key, ord, y0, x0, x1, y1) below the first rule-like line near the top; all of them without one."""
    page = Window.partitionBy(key)
    tall = F.col("y1") - F.col("y0")
    typical = F.coalesce(F.nullif(upper_median(F.collect_list(tall).over(page)), F.lit(0)), F.lit(1))
    told = lines.withColumn("_typical", typical)
    rule = (F.col("y0") < height * HEADER_TOP) & (F.col("x1") - F.col("x0") > width * HEADER_WIDTH) & (tall < F.col("_typical") * F.lit(HEADER_TALL))
    told = told.withColumn("_rule", F.min_by(F.when(rule, F.col("y0")), F.when(rule, F.col("ord"))).over(page))
    return told.where("_rule is null or y0 > _rule").drop("_typical", "_rule")


# -- numpy kernels over one raster ---------------------------------------------------------------


def page_dark(rgb: np.ndarray, known: np.ndarray | None = None) -> int:
    grays = gray_kernel(rgb).ravel()[::SAMPLE]
    t = otsu_kernel(grays if known is None else grays[known.ravel()[::SAMPLE]], default=0, floor=0.0)
    return t if t > RULE_DARK else NO_DARK


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def zone_lines(dark: np.ndarray, x0: int, y0: int, width: int, height: int) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of the lines in a zone of a page's dark mask; y is where the band starts."""
    zone = dark[y0 : y0 + height, x0 : x0 + width : 2]
    if not zone.size:
        return []
    ink = zone.sum(axis=1)
    low, high = max(LEAST_INK, width / BAND_LOW), max(LEAST_INK, width / BAND_HIGH)
    cut = [b for b in _runs(ink >= low) if b[1] - b[0] >= LEAST_BAND]
    sizes = sorted(b - a for a, b in cut if b - a < LARGE_BAND)
    typical = (sizes[len(sizes) // 2] if sizes else 0) or USUAL_BAND
    out = []
    for a, b in cut:
        parts = [(a + s, a + e) for s, e in _runs(ink[a:b] >= high) if e - s >= LEAST_BAND] if b - a > typical * TALL else [(a, b)]
        for s, e in parts:
            hit = np.flatnonzero(zone[max(0, s - 6) : min(height, e + 6)].any(axis=0)) * 2
            left, right = (max(0, int(hit[0]) - 12), min(width, int(hit[-1]) + 14)) if len(hit) else (max(0, width - 12), min(width, 14))
            out.append((x0 + left, y0 + s, max(1, right - left), min(height, e - s + 12)))
    return out


def gutter_kernel(dark: np.ndarray, known: np.ndarray | None = None) -> tuple[int, int, int, int, int | None]:
    """top, bottom, start, end and split of a page's dark mask, as ``active_rows`` and ``gutter`` tell them.

    ``known``: the columns that have pixels, where some have none.
    """
    h, w = dark.shape
    active = np.flatnonzero(dark[::2, ::4].sum(axis=1) >= ACTIVE) * 2
    last = (h - 1) // 2 * 2
    top, bottom = (int(active[0]), int(active[-1])) if len(active) else (last, last)
    low, high = (int(w * share) for share in MIDDLE)
    blank = dark[top : bottom + 1 : 4, low : high + 1].sum(axis=0) <= (bottom - top + 1) / FEW
    if known is not None:
        blank &= known[low : high + 1]
    edge = np.array(_runs(blank), np.int64).reshape(-1, 2) + low
    size = np.minimum(edge[:, 1], high) - edge[:, 0]
    if not len(size) or size.max() <= 0:
        return top, bottom, 0, 0, None
    start = int(edge[size.argmax(), 0])
    end = start + int(size.max())
    return top, bottom, start, end, int(np.floor((start + end) / 2 + 0.5)) if end - start >= w * GUTTER else None


def page_lines(rgb: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Lines of a page: four zones around a vertical rule, two beside a gutter, or one."""
    h, w = rgb.shape[:2]
    total = rgb.astype(np.int64).sum(axis=-1)
    limit = page_dark(rgb)
    dark, black = total < 3 * limit, total < 3 * RULE_DARK
    first = int(w * RULE_FROM)
    at = np.arange(first, int(np.ceil(w * RULE_TO)), 2)
    ink = black[::2][:, at].sum(axis=0) if len(at) else np.zeros(0, int)
    best = int(np.argmax(ink)) if len(ink) else 0
    if len(ink) and ink[best] and ink[best] >= h * RULE_SHARE:
        x = int(at[best])
        hit = np.flatnonzero(black[:, x])
        top, bottom = int(hit[0]), int(hit[-1])
        zones = [(0, 0, w, top), (0, top, x, bottom - top), (x + 1, top, w - x - 1, bottom - top), (0, bottom, w, h - bottom)]
    else:
        *_, split = gutter_kernel(dark)
        zones = [(0, 0, w, h)] if split is None else [(0, 0, split, h), (split, 0, w - split, h)]
    return [line for z in zones for line in zone_lines(dark, *z)]


def drop_header(lines: list[tuple[int, int, int, int]], width: int, height: int) -> list[tuple[int, int, int, int]]:
    sizes = sorted(x[3] for x in lines)
    typical = (sizes[len(sizes) // 2] if sizes else 0) or 1
    rule = next((x for x in lines if x[1] < height * HEADER_TOP and x[2] > width * HEADER_WIDTH and x[3] < typical * HEADER_TALL), None)
    return [x for x in lines if x[1] > rule[1]] if rule else lines


def reduced(rgb: np.ndarray, factor: int = TRIM_FACTOR) -> np.ndarray:
    """A page reduced by ``factor``: the mean, rounded half up, of each block of pixels, those at the edges cut short."""
    h, w = rgb.shape[:2]
    rows, cols = np.arange(0, h, factor), np.arange(0, w, factor)
    sums = np.add.reduceat(np.add.reduceat(rgb.astype(np.int64), rows, axis=0), cols, axis=1)
    size = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(cols, w))[None, :]
    return ((2 * sums + size[:, :, None]) // (2 * size[:, :, None])).astype(np.uint8)


def trim_kernel(rgb: np.ndarray) -> tuple[int, int, int, int]:
    """``trim_box`` of one page, reduced here."""
    h, w = rgb.shape[:2]
    ink = reduced(rgb).astype(int).sum(axis=-1) < TRIM_WHITE
    x, y = np.flatnonzero(ink.any(axis=0)), np.flatnonzero(ink.any(axis=1))
    if len(x) < 2 or len(y) < 2:
        return 0, 0, w, h
    low = [max(0, int(v[0]) * TRIM_FACTOR - TRIM_MARGIN) for v in (x, y)]
    high = [min(size, (int(v[-1]) + 1) * TRIM_FACTOR + TRIM_MARGIN) for v, size in ((x, w), (y, h))]
    return (*low, *high) if (high[0] - low[0]) * (high[1] - low[1]) < w * h * TRIM_WHOLE else (0, 0, w, h)
