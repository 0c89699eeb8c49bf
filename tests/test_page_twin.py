"""Whole pages, from pixels to text, against a twin in plain Python without arrays."""

from __future__ import annotations

import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from docgrid.operators import pixels, rasters, segment, stats
from docgrid.options import Options
from docgrid.plans import recognise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CODEC = {1: "a", 2: "b­", 3: "c", 4: "d", 5: "¬", 6: "f"}


def model(lines, widths):
    """A class a step of eight columns, by how many of its values are over a half; its logit is that number."""
    n, _, h, w = lines.shape
    steps = w // 8
    count = (lines[:, 0, :, : steps * 8] > 0.5).reshape(n, h, steps, 8).sum(axis=(1, 3))
    logits = np.zeros((n, 8, steps), np.float32)
    np.put_along_axis(logits, np.minimum(count // 40, 7)[:, None, :], 1 + count[:, None, :].astype(np.float32), axis=1)
    return logits, np.maximum(1, widths // 8)


# -- the twin -------------------------------------------------------------------------------------


def gray(p):
    return math.floor(sum(p) / 3 + 0.5)


def otsu(values, default, floor):
    n = [values.count(i) for i in range(256)]
    total, whole, best = len(values), sum(values), (floor, default)
    left = left_sum = 0
    for i in range(256):
        left, left_sum = left + n[i], left_sum + n[i] * i
        if 0 < left < total:
            score = (left_sum / left - (whole - left_sum) / (total - left)) ** 2 * left * (total - left)
            if score > best[0]:
                best = (score, i)
    return best[1]


def stretches(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            out.append((start, i))
            start = None
    return out


def upper(values, default):
    return (sorted(values)[len(values) // 2] if values else 0) or default


def zones_of(rows, dark):
    h, w = len(rows), len(rows[0])
    black = [[sum(p) < 480 for p in row] for row in rows]
    cols = list(range(int(w * 0.55), math.ceil(w * 0.9), 2))
    ink = [sum(black[y][x] for y in range(0, h, 2)) for x in cols]
    if ink and max(ink) and max(ink) >= h * 0.18:
        x = cols[ink.index(max(ink))]
        hit = [y for y in range(h) if black[y][x]]
        top, bottom = hit[0], hit[-1]
        return [(0, 0, w, top), (0, top, x, bottom - top), (x + 1, top, w - x - 1, bottom - top), (0, bottom, w, h - bottom)]
    even = [y for y in range(0, h, 2) if sum(dark[y][::4]) >= 4]
    top, bottom = (even[0], even[-1]) if even else ((h - 1) // 2 * 2,) * 2
    a, b = int(w * 0.25), int(w * 0.75)
    blank = [sum(dark[y][x] for y in range(top, bottom + 1, 4)) <= (bottom - top + 1) / 80 for x in range(a, b + 1)]
    found = [(s + a, min(e + a, b)) for s, e in stretches(blank)]
    start, end = max(found, key=lambda r: (r[1] - r[0], -r[0]), default=(0, 0))
    if end > start and end - start >= w * 0.015:
        split = math.floor((start + end) / 2 + 0.5)
        return [(0, 0, split, h), (split, 0, w - split, h)]
    return [(0, 0, w, h)]


def lines_of(rows):
    h, w = len(rows), len(rows[0])
    flat = [gray(p) for row in rows for p in row][::4]
    t = otsu(flat, 0, 0.0)
    limit = t if t > 160 else 210
    dark = [[sum(p) < 3 * limit for p in row] for row in rows]
    out = []
    for x0, y0, zw, zh in zones_of(rows, dark):
        zone = [dark[y][x0 : x0 + zw : 2] for y in range(y0, min(h, y0 + zh))]
        ink = [sum(r) for r in zone]
        low, high = max(4.0, zw / 200), max(4.0, zw / 60)
        cut = [b for b in stretches(v >= low for v in ink) if b[1] - b[0] >= 4]
        typical = upper([e - s for s, e in cut if e - s < 100], 40)
        for s, e in cut:
            parts = [(s + p, s + q) for p, q in stretches(v >= high for v in ink[s:e]) if q - p >= 4] if e - s > typical * 1.65 else [(s, e)]
            for p, q in parts:
                hit = [2 * i for r in zone[max(0, p - 6) : min(zh, q + 6)] for i, d in enumerate(r) if d]
                left, right = (max(0, min(hit) - 12), min(zw, max(hit) + 14)) if hit else (max(0, zw - 12), min(zw, 14))
                out.append((x0 + left, y0 + p, max(1, right - left), min(zh, q - p + 12)))
    usual = upper([x[3] for x in out], 1)
    head = next((x[1] for x in out if x[1] < h * 0.1 and x[2] > w * 0.85 and x[3] < usual * 0.55), None)
    out = [x for x in out if head is None or x[1] > head]
    return [[row[x : x + lw] for row in rows[max(0, y - 6) : max(0, y - 6) + lh]] for x, y, lw, lh in out]


def resized(line, height, width):
    h, w = len(line), len(line[0])
    at = lambda i, n, size: min(max((i + 0.5) * size / n - 0.5, 0), size - 1)
    out = []
    for i in range(height):
        y = at(i, height, h)
        y0 = math.floor(y)
        y1, fy = min(y0 + 1, h - 1), y - y0
        row = []
        for j in range(width):
            x = at(j, width, w)
            x0 = math.floor(x)
            x1, fx = min(x0 + 1, w - 1), x - x0
            mix = lambda r, k: line[r][x0][k] * (1 - fx) + line[r][x1][k] * fx  # noqa: B023, E731
            row.append(tuple(math.floor(mix(y0, k) * (1 - fy) + mix(y1, k) * fy + 0.5) for k in range(3)))
        out.append(row)
    return out


def prepared(line, mode):
    g = [[gray(p) for p in row] for row in line]
    flat = [v for row in g for v in row]
    if mode == "auto":
        at = lambda share: next(i for i in range(256) if sum(v <= i for v in flat) >= len(flat) * share)
        low, high = at(0.05), at(0.9)
        mode = "sauvola" if high < 225 else "otsu" if high - low < 105 else "none"
    if mode == "none":
        return [[1 - v / 255 for v in row] for row in g]
    if mode in ("otsu", "morph"):
        t = otsu(flat, 127, -1.0)
        ink = [[float(v <= t) for v in row] for row in g]
        if mode == "otsu":
            return ink
        near = lambda v, f: [[f(r[max(0, i - 1) : i + 2]) for i in range(len(r))] for r in v]
        return near(near(ink, max), min)
    h, w = len(g), len(g[0])
    sums = [[[0] * (w + 1) for _ in range(h + 1)] for _ in range(2)]
    for y in range(h):
        for x in range(w):
            for s, v in zip(sums, (g[y][x], g[y][x] ** 2)):
                s[y + 1][x + 1] = v + s[y][x + 1] + s[y + 1][x] - s[y][x]
    out = []
    for y in range(h):
        row = []
        for x in range(w):
            t, b, l, r = max(0, y - 12), min(h, y + 13), max(0, x - 12), min(w, x + 13)
            a, q = (s[b][r] - s[t][r] - s[b][l] + s[t][l] for s in sums)
            n = (b - t) * (r - l)
            mean = a / n
            sd = math.sqrt(max(0, q / n - mean * mean))
            row.append(float(g[y][x] <= mean * (1 + 0.2 * (sd / 128 - 1))))
        out.append(row)
    return out


def read(line, options, scale):
    inner = max(1, math.floor(len(line[0]) * 48.0 / len(line) * scale + 0.5))
    body = resized(line, 48, inner)
    white = [(255, 255, 255)] * options.pad
    values = prepared([white + row + white for row in body], options.pre)
    steps = [sum(values[y][x] > 0.5 for y in range(48) for x in range(8 * t, 8 * t + 8)) for t in range((inner + 2 * options.pad) // 8)]
    text, found, before = "", [], 0
    for count in steps:
        best = min(count // 40, 7)
        if best and best != before:
            text += CODEC.get(best, "")
            found.append(1.0 + count)
        before = best
    return text, sum(found) / len(found) if found else 0.0


def twin(rgb, options):
    rows = [[tuple(map(int, p)) for p in row] for row in rgb]
    out = []
    for line in lines_of(rows):
        text, confidence = read(line, options, options.scale)
        if confidence < options.retry and options.scale < options.retry_scale:
            text, _ = read(line, options, options.retry_scale)
        out.append(text)
    joined = "\n".join(out)
    for mark in ("­", "¬"):
        for end in ("\r\n", "\n"):
            joined = joined.replace(mark + end, "")
    return joined.replace("­", "").replace("¬", ""), len(out)


# -- pages ----------------------------------------------------------------------------------------


def pages():
    rng = np.random.default_rng(7)
    out = {}
    for i in range(7):
        h, w = 130 + 10 * i, 150 + 14 * i
        rgb = np.full((h, w, 3), 255 if i % 3 else 218, np.uint8)
        for k, y in enumerate(range(20, h - 20, 30)):
            for x in range(16, w - 24, 9):
                if i % 2 and w * 0.44 < x < w * 0.58:
                    continue  # a gutter
                rgb[y : y + int(rng.integers(6, 15)), x : x + int(rng.integers(3, 8))] = rng.integers(0, 150 if i != 5 else 190, 3)
        if i == 2:
            rgb[15:-12, int(w * 0.7)] = 10  # a rule
        if i == 4:
            rgb[4:9, 4 : w - 4] = 30  # a running header's rule
        out[f"p{i}"] = rgb
    return out


@pytest.mark.parametrize("options", [Options(), Options(pre="auto", scale=0.7, retry=150.0), Options(pre="morph", batch=2, bucket=8, scale=0.85), Options(pre="sauvola", batches="planned")])
def test_whole_pages(spark, options) -> None:
    made = pages()
    frame = spark.createDataFrame([(k, v.shape[1], v.shape[0], v.tobytes(), None) for k, v in made.items()], "page_id string, width int, height int, rgb binary, error string").repartition(3)
    got = {r.page_id: (r.text, r.line_count) for r in recognise.recognise(frame, options, model, CODEC).collect()}
    want = {k: twin(v, options) for k, v in made.items()}
    assert got == want
    assert sum(len(t) for t, _ in want.values()) > 60 and sum(n for _, n in want.values()) > 20


def test_pages_as_one_row(spark) -> None:
    """The forms over rasters against those over pixels, where the last row is cut short."""
    rng = np.random.default_rng(3)
    rows = []
    for p in range(6):
        w, h = 26 + p, 30 + 3 * p
        rgb = rng.integers(150, 256, (h, w, 3))
        for top in range(3, h - 6, 9):
            rgb[top : top + 5, :, :] = rng.integers(0, 200, (5, w, 1))
        if p % 2:
            rgb[:, w // 2 - 1 : w // 2 + 2] = 250
        rows += [(p, x, y, w, h, *map(int, rgb[y, x])) for y in range(h) for x in range(w) if y < h - 1 or x < 11]
    px = spark.createDataFrame(rows, "page_id long, x int, y int, width int, height int, r int, g int, b int").repartition(4)
    tell = lambda df, *cols: sorted(tuple(r) for r in df.select("page_id", *cols).collect())
    from pyspark.sql import functions as F

    assert tell(rasters.sauvola_rows(px), "y", "ink") == tell(pixels.sauvola(px).groupBy("page_id", "y").agg(F.sum("ink").alias("ink")), "y", "ink")
    closed = pixels.closing(pixels.binary(px)).groupBy("page_id", "y").agg(F.sum("ink").alias("ink"), F.sum("closed").alias("closed"))
    assert tell(rasters.closing_rows(px), "y", "ink", "closed") == tell(closed, "y", "ink", "closed")
    dark = stats.ink_threshold(px)
    told = segment.active_rows(px, dark).join(segment.gutter(px, dark), "page_id")
    cols = ("top", "bottom", "start", "end", "split")
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r) for r in rasters.gutters(px).select("page_id", *cols).collect()) == key(tuple(r) for r in told.select("page_id", *cols).collect())
    assert rasters.sauvola_rows(px.limit(0)).count() == 0
