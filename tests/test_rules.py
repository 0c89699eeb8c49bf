"""Scalar rules, kernels and options, without Spark."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrid.operators import crop, decode, pixels, segment
from docgrid.options import Options, recognition_workers
from docgrid.plans.recognise import resize
from docgrid.sources.images import on_white


def gray_rgb(values, width):
    return np.repeat(np.array(values, np.uint8).reshape(-1, width, 1), 3, axis=2)


def test_white_and_black():
    assert pixels.preprocess(gray_rgb([255, 0], 2)).tolist() == [[0, 1]]


@pytest.mark.parametrize("mode", ["otsu", "sauvola"])
def test_dark_pixel_is_kept(mode):
    rng = np.random.default_rng(11)
    row = rng.integers(170, 200, 21)
    row[13:15] = rng.integers(30, 60, 2)
    ink = pixels.preprocess(gray_rgb(row, 21), mode)[0]
    assert ink[13] == ink[14] == 1 and not ink[:8].any()


@pytest.mark.parametrize(("cores", "workers"), [(3, 2), (5, 4), (12, 11), (96, 95), (-4, 1), ("x", 1), (None, 1), (0, 1), (2.9, 1), (float("inf"), 1)])
def test_workers(cores, workers):
    assert recognition_workers(cores) == workers


def test_options_from_text():
    o = Options.from_text({"batch": "0", "pad": "0", "widths": "512,256,x", "retry": "0.5", "scale": "nan?", "sort": "1", "pre": "auto"})
    assert (o.batch, o.pad, o.widths, o.retry, o.scale, o.sort, o.pre) == (32, 0, (256, 512), 0.5, 1.0, True, "auto")
    with pytest.raises(ValueError, match="preprocessing"):
        Options(pre="other")


images = st.integers(1, 9).flatmap(lambda w: st.lists(st.integers(0, 255), min_size=w, max_size=w * 9).map(lambda v: np.array(v[: len(v) // w * w]).reshape(-1, w)))


@settings(max_examples=150, deadline=None)
@given(images)
def test_otsu_kernel(grays):
    flat, best, found = grays.ravel().tolist(), -1.0, 127
    for t in range(256):
        left, right = [v for v in flat if v <= t], [v for v in flat if v > t]
        if left and right:
            score = (sum(left) / len(left) - sum(right) / len(right)) ** 2 * len(left) * len(right)
            if score > best and not math.isclose(score, best, rel_tol=1e-12):
                best, found = score, t
    assert pixels.otsu_kernel(grays) == found


@settings(max_examples=100, deadline=None)
@given(images, st.floats(0, 1))
def test_percentile_kernel(grays, fraction):
    flat = sorted(grays.ravel().tolist())
    want = next(v for v in range(256) if sum(x <= v for x in flat) >= len(flat) * fraction)
    assert pixels.percentile_kernel(grays, fraction) == want


@settings(max_examples=60, deadline=None)
@given(images)
def test_sauvola_and_closing_kernels(grays):
    h, w = grays.shape
    want = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            box = grays[max(0, y - 12) : y + 13, max(0, x - 12) : x + 13].astype(float)
            mean = box.sum() / box.size
            var = max(0, (box * box).sum() / box.size - mean * mean)
            want[y, x] = grays[y, x] <= mean * (1 + 0.2 * (math.sqrt(var) / 128 - 1))
    assert (pixels.sauvola_kernel(grays) == want).all()
    ink = (grays > 128).astype(np.float32)
    spread = [[max(ink[y, max(0, x - 1) : x + 2]) for x in range(w)] for y in range(h)]
    closed = [[min(spread[y][max(0, x - 1) : x + 2]) for x in range(w)] for y in range(h)]
    assert pixels.closing_kernel(ink).tolist() == closed


def page(height=120, width=200):
    return np.full((height, width, 3), 255, np.uint8)


def test_lines_of_one_column():
    rgb = page()
    for top in (10, 40, 70):
        rgb[top : top + 10, 20:180] = 0
    assert [(x, y) for x, y, _, _ in segment.page_lines(rgb)] == [(8, 10), (8, 40), (8, 70)]
    assert segment.page_lines(page()) == []


def test_lines_beside_a_gutter_and_a_rule():
    rgb = page()
    for top in (10, 40, 70):
        rgb[top : top + 10, 10:80] = 0
        rgb[top : top + 10, 120:190] = 0
    found = segment.page_lines(rgb)
    assert len(found) == 6 and [x < 100 for x, *_ in found] == [True] * 3 + [False] * 3
    rgb[20:100, 130] = 0
    assert len(segment.page_lines(rgb)) >= 4


def test_header_is_dropped():
    lines = [(0, 5, 50, 20), (0, 30, 190, 6), (0, 60, 150, 20), (0, 90, 150, 20)]
    assert segment.drop_header(lines, 200, 400) == lines[2:]
    assert segment.drop_header(lines[2:], 200, 400) == lines[2:] and segment.drop_header([], 1, 1) == []


def test_crop_template():
    assert crop.template(50, 40, 10, 20, 100, 200) == (0.1, 0.1, 0.4, 0.1)
    assert crop.template(0, 0, 7, 100, 100, 100) is None
    assert crop.layout_dpi(1) == 200 and crop.layout_dpi(0.5) == 100


def test_codec():
    assert decode.invert_codec({"a": [1, 3], "b": [2]}) == {1: "a", 3: "a", 2: "b"}
    with pytest.raises(ValueError, match="class 1"):
        decode.invert_codec({"a": [1], "b": [1]})


def test_resize_and_white():
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (resize(rgb, 2, 4) == rgb).all() and resize(rgb, 4, 8).shape == (4, 8, 3)
    bgra = np.array([[[1, 2, 3, 255], [1, 2, 3, 0]]], np.uint8)
    assert on_white(bgra).tolist() == [[[3, 2, 1], [255, 255, 255]]]
    assert on_white(np.array([[[7]]], np.uint8)).tolist() == [[[7, 7, 7]]]
