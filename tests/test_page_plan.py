"""The page plan: failures that cost their page alone, decoding in the task, planned batches, crops and trims, assets."""

from __future__ import annotations

import base64
import contextlib
import io
import json
import math
import random
import sys
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docgrid.operators import batching, crop, decode, metrics, pixels, segment
from docgrid.options import Options
from docgrid.plans import recognise
from docgrid.sources import assets
from docgrid.sources.providers import StubRecogniser

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module

CODEC = {i: c for i, c in enumerate("abcdef", 1)}
PAGES = "page_id string, width int, height int, rgb binary, error string"


def page(seed: int, lines: int = 3, width: int = 200, height: int = 150) -> np.ndarray:
    rng = np.random.default_rng(seed)
    rgb = np.full((height, width, 3), 255, np.uint8)
    for i in range(lines):
        rgb[14 + 34 * i : 26 + 34 * i, 24 : width - 30 - 7 * i] = rng.integers(0, 120, (12, width - 54 - 7 * i, 1))
    return rgb


def frame(spark, pages: dict[str, np.ndarray | None]):
    rows = [(k, *((v.shape[1], v.shape[0], v.tobytes(), None) if v is not None else (None, None, None, "unreadable"))) for k, v in pages.items()]
    return spark.createDataFrame(rows, PAGES).repartition(3)


class Touchy(StubRecogniser):
    """Fails on any batch with a line of a certain width."""

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    def __call__(self, lines, widths):
        if (widths == self.width).any():
            raise RuntimeError(f"can't take {self.width}")
        return super().__call__(lines, widths)


@pytest.mark.parametrize("batches", ["local", "planned"])
def test_a_model_failure_costs_its_page_alone(spark, batches) -> None:
    pages = frame(spark, {f"p{i}": page(i) for i in range(6)} | {"bad": page(9, 3, 331), "none": page(0, 0), "broken": None})
    options = Options(batches=batches)
    want = {r.page_id: r.text for r in recognise.recognise(pages, options, StubRecogniser(), CODEC).collect()}
    widths = {r.page_id: r.prepared for r in batching.with_width(recognise.prepare(pages, options).where("line_no = 1"), options).collect()}
    assert sum(w == widths["bad"] for w in widths.values()) == 1
    got = {r.page_id: r for r in recognise.recognise(pages, options, Touchy(widths["bad"]), CODEC).collect()}
    assert (got["bad"].text, got["bad"].error, got["bad"].line_count) == (None, f"can't take {widths['bad']}", 0)
    assert got["broken"].text is None and "unreadable" in got["broken"].error
    assert (got["none"].text, got["none"].error, got["none"].line_count) == ("", None, 0)
    assert all(got[f"p{i}"].text == want[f"p{i}"] and got[f"p{i}"].line_count == 3 and want[f"p{i}"] for i in range(6))
    with pytest.raises(Exception, match="can't take"):
        recognise.recognise(pages.where("error is null"), Options(batches=batches, on_error="raise"), Touchy(widths["bad"]), CODEC).collect()


def test_a_failure_of_the_second_look(spark) -> None:
    pages = frame(spark, {"a": page(1), "b": page(2, 3, 260)})
    options = Options(retry=99.0, scale=0.5, retry_scale=1.0)
    again = {r.page_id: r.prepared for r in batching.with_width(recognise.prepare(pages, options).where("line_no = 0"), Options()).collect()}
    got = {r.page_id: r for r in recognise.recognise(pages, options, Touchy(again["b"]), CODEC).collect()}
    assert got["b"].error and got["b"].text is None and got["a"].error is None and got["a"].line_count == 3
    lines = recognise.recognise_lines(recognise.prepare(pages, options), options, StubRecogniser(), CODEC).collect()
    assert len(lines) == 6 and all(r.retried for r in lines)


def test_models_that_return_too_little(spark) -> None:
    pages = frame(spark, {"a": page(1)})
    got = recognise.recognise(pages, Options(), lambda lines, widths: (np.zeros((0, 8, 4)), np.zeros(0)), CODEC).first()
    assert "0 results for 1 lines" in got.error


def test_decoding_in_the_task_equals_decoding_of_logits(spark) -> None:
    rng = random.Random(4)
    pick = lambda: rng.choice([0.0, 0.25, -1.0, math.nan, -math.inf, rng.random()])
    logits = np.array([[[pick() for _ in range(5)] for _ in range(8)] for _ in range(80)], np.float32)
    logits[0] = math.nan
    valid = np.array([rng.randint(0, 7) for _ in range(80)])
    rows = [(i, logits[i].ravel().tolist(), 8, 5, int(v)) for i, v in enumerate(valid)]
    want = {r.id: (r.text, r.confidence) for r in decode.decode(spark.createDataFrame(rows, "id long, logits array<float>, classes int, steps int, valid_steps int"), CODEC).collect()}
    best, top = decode.best_kernel(logits)
    steps = decode.best_arrays(best, top, valid).to_pylist()
    told = spark.createDataFrame([(i, [(s["best"], s["top"]) for s in x], True) for i, x in enumerate(steps)], f"id long, steps {decode.STEPS}, scored boolean")
    assert {r.id: (r.text, r.confidence) for r in decode.decode_steps(told, CODEC).collect()} == want
    assert decode.confidences(best, top, valid) == [want[i][1] for i in range(80)]
    none = spark.createDataFrame([(1, None, True), (2, [(1, None)], False)], f"id long, steps {decode.STEPS}, scored boolean")
    assert {r.id: (r.text, r.confidence) for r in decode.decode_steps(none, CODEC).collect()} == {1: (None, None), 2: ("a", None)}


def test_no_logits_and_one_codec_in_the_plan(spark) -> None:
    done = recognise.recognise(frame(spark, {"a": page(1)}), Options(), StubRecogniser(), {i: chr(200 + i) for i in range(1, 3000)})
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        done.explain("extended")
    plan = out.getvalue()
    assert "logits" not in plan and plan.count("MapInArrow") >= 2 and "map(1," not in plan and "InMemoryRelation" not in plan


class Recorder(StubRecogniser):
    def __init__(self, folder):
        super().__init__()
        self.folder = str(folder)

    def __call__(self, lines, widths):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump([lines.shape[-1], sorted(int(w) for w in widths)], f)
        return super().__call__(lines, widths)


@pytest.mark.parametrize("options", [Options(batches="planned", batch=4), Options(batches="planned", batch=5, sort=True), Options(batches="planned", batch=3, widths=(256, 512))])
def test_planned_batches_are_what_the_model_meets(spark, tmp_path, options) -> None:
    pages = frame(spark, {f"p{i}": page(i, 1 + i % 4, 160 + 17 * (i % 9)) for i in range(25)} | {"broken": None})
    lines = recognise.prepare(pages, options)
    plan: dict = {}
    for r in batching.plan(lines.where("error is null").select("page_id", "line_no", "width", "height"), options).collect():
        plan.setdefault((r.bucket, r.batch_no), []).append(r)
    want = sorted([rows[0].batch_width, sorted(r.prepared for r in rows)] for rows in plan.values())
    results = recognise.infer(lines, options, Recorder(tmp_path)).collect()
    assert sorted(json.loads(p.read_text()) for p in tmp_path.iterdir()) == want
    assert len(results) == sum(map(len, plan.values())) + 1 and [r.error for r in results if r.page_id == "broken"] == ["unreadable"]
    local = {(r.page_id, r.line_no): r.steps for r in recognise.infer(lines, Options(widths=options.widths), StubRecogniser()).collect()}
    assert {(r.page_id, r.line_no): r.steps for r in results} == local


def test_crop_and_trim_through_the_plan(spark) -> None:
    rgb = np.full((900, 700, 3), 255, np.uint8)
    marks = [(310, 420, 480, 440), (320, 470, 500, 490)]
    for x0, y0, x1, y1 in marks:
        rgb[y0:y1, x0:x1] = 0
    seen: list = []

    def layout(part, dpi, psm, binary):
        """The boxes of dark rows' runs, and one of an image block that must go."""
        dark = part.sum(axis=-1) < 300
        rows = np.flatnonzero(np.diff(np.concatenate([[0], dark.any(axis=1).astype(int), [0]])))
        made = []
        for a, b in zip(rows[::2], rows[1::2]):
            cols = np.flatnonzero(dark[a:b].any(axis=0))
            made.append([cols[0], a, cols[-1] + 1, b, 1])
        made.append([0, 0, part.shape[1], part.shape[0], 10])
        seen.append(part.shape)
        return np.array(made)

    pages = frame(spark, {"p": rgb})
    base = Options(segmentation="layout")
    told = lambda options, crop_to=None: sorted(tuple(r) for r in recognise.on_page(recognise.prepare(pages, options, layout, crop_to)).select("page_x", "page_y", "width", "height", "rgb").collect())
    whole = told(base)
    assert [x[:4] for x in whole] == [(300, 414, 191, 33), (310, 464, 201, 33)]
    assert told(Options(segmentation="layout", layout_trim=True)) == whole
    assert told(base, (0.3, 0.4, 0.6, 0.3)) == whole
    assert told(Options(segmentation="layout", layout_trim=True), (0.1, 0.2, 0.8, 0.7)) == whole
    at = recognise.prepare(pages, Options(segmentation="layout", layout_trim=True), layout, (0.1, 0.2, 0.8, 0.7)).first().transform
    assert (at.crop_x, at.crop_y) == (70, 180) and at.trim_x > 100 and at.trim_y > 100 and at.scale == 1.0
    twice = told(Options(segmentation="layout", layout_trim=True, layout_scale=2.0))
    assert all(abs(a - b) <= 2 for x, y in zip(twice, whole) for a, b in zip(x[:4], y[:4]))
    shape = segment.trim_kernel(rgb)
    layout(rgb[shape[1] : shape[3], shape[0] : shape[2]], 200, 3, 0)
    assert seen[-1][0] * seen[-1][1] < rgb.shape[0] * rgb.shape[1] / 3
    text = {r.page_id: r.line_count for r in recognise.recognise(pages, base, StubRecogniser(), CODEC, layout, (0.3, 0.4, 0.6, 0.3)).collect()}
    assert text == {"p": 2}


def test_layout_sees_black_and_white_at_a_threshold(spark) -> None:
    rgb = np.random.default_rng(1).integers(0, 256, (40, 60, 3)).astype(np.uint8)
    luma = [[(77 * int(r) + 150 * int(g) + 29 * int(b)) // 256 for r, g, b in row] for row in rgb]
    black = sum(v < 120 for row in luma for v in row)

    def layout(part, dpi, psm, threshold):
        values = {tuple(p) for p in part.reshape(-1, 3).tolist()}
        return np.array([[0, 0, int((part.sum(axis=-1) == 0).sum()), len(values)]]) if threshold else np.array([[0, 0, 1, len(values)]])

    told = lambda binary: recognise.prepare(frame(spark, {"p": rgb.repeat(1, 0)}), Options(segmentation="layout", layout_binary=binary), layout).count()
    assert told(120) == 1 and told(0) == 1
    seen = pixels.binary_kernel(rgb, 120)
    assert layout(seen, 200, 3, 120).tolist() == [[0, 0, black, 2]] and ((seen[:, :, 0] == 0) == (np.array(luma) < 120)).all()


def test_trim_kernel_equals_the_relational_form(spark) -> None:
    rng = np.random.default_rng(5)
    pages = {}
    for i in range(12):
        rgb = np.full((int(rng.integers(60, 400)), int(rng.integers(60, 400)), 3), 255, np.uint8)
        for _ in range(i % 4):
            y, x = int(rng.integers(0, rgb.shape[0])), int(rng.integers(0, rgb.shape[1]))
            rgb[y : y + int(rng.integers(1, 60)), x : x + int(rng.integers(1, 60))] = 0
        pages[i] = rgb
    rows = [(i, x, y, small.shape[1], small.shape[0], *map(int, small[y, x])) for i, rgb in pages.items() for small in [segment.reduced(rgb)] for y in range(small.shape[0]) for x in range(small.shape[1])]
    px = spark.createDataFrame(rows, "page_id long, x int, y int, width int, height int, r int, g int, b int")
    for r in segment.trim_box(px).collect():
        h, w = pages[r.page_id].shape[:2]
        want = segment.trim_kernel(pages[r.page_id])
        whole = want == (0, 0, w, h)  # the reduced page is a few pixels larger than the page
        assert whole == ((r.x0, r.y0) == (0, 0) and r.x1 >= w and r.y1 >= h) or min(w, h) < 200
        if not whole:
            assert (r.x0, r.y0, min(r.x1, w), min(r.y1, h)) == want
    even = np.arange(4 * 6 * 3).reshape(4, 6, 3).astype(np.uint8)
    assert segment.reduced(even, 4)[0, 1].tolist() == [int(even[:, 4:, k].mean() + 0.5) for k in range(3)]


def test_blocks_and_regions(spark) -> None:
    blocks = [(1, 2, 1, [(0, 0, 5, 5), (1, 1, 6, 6)]), (1, 1, 8, [(9, 9, 19, 19)]), (1, 3, 9, [(2, 2, 3, 3)]), (1, 4, 0, [(2, 2, 3, 3)]), (1, 5, 4, []), (2, 1, 3, [(7, 7, 8, 8)])]
    made = spark.createDataFrame(blocks, "page_id long, block_no int, type int, lines array<struct<x0:int,y0:int,x1:int,y1:int>>")
    got = sorted((r.page_id, r.ord, r.x0) for r in crop.text_lines(made).collect())
    assert got == [(1, 0, 9), (1, 1, 0), (1, 2, 1), (2, 0, 7)]
    boxes = spark.createDataFrame([(1, 10.0, 20.0, 30.0, 40.0), (2, 10.0, 20.0, 30.0, 40.0)], "page_id long, x0 double, y0 double, x1 double, y1 double")
    trims = spark.createDataFrame([(1, 100, 200)], "page_id long, x0 int, y0 int")
    assert {r.page_id: (r.x0, r.y0) for r in crop.from_trimmed(boxes, trims, 2.0).collect()} == {1: (105.0, 210.0), 2: (5.0, 10.0)}
    assert crop.text_boxes(np.zeros((0, 4))).shape == (0, 4) and crop.text_boxes(np.array([])).shape == (0, 4)


def test_timings_of_a_run(spark) -> None:
    pages = frame(spark, {f"p{i}": page(i) for i in range(5)} | {"broken": None})
    timings = metrics.RunTimings(spark)
    done = recognise.recognise(pages, Options(), StubRecogniser(), CODEC, timings=timings)
    assert done.count() == 6
    row = timings.table().first()
    assert (row.pages, row.lines, row.failed) == (6, 15, 1)
    assert 0 < row.layout_seconds and 0 < row.inference_seconds and row.seconds > 0
    assert metrics.RunTimings(spark).table().first().pages is None


def test_prepared_lines_as_a_call_of_their_own(spark, tmp_path) -> None:
    pages = frame(spark, {f"p{i}": page(i) for i in range(4)} | {"broken": None})
    options = Options(retry=99.0, scale=0.5)
    texts, summary = recognise.recognise_prepared(recognise.prepare(pages, options), options, Recorder(tmp_path), CODEC)
    calls = len(list(tmp_path.iterdir()))
    got = {r.page_id: (r.line_count, r.text, r.error) for r in texts.collect()}
    want = {r.page_id: (r.line_count, r.text, r.error) for r in recognise.recognise(pages, options, StubRecogniser(), CODEC).collect()}
    assert got == want and len(list(tmp_path.iterdir())) == calls
    row = summary.first()
    assert (row.lines, row.retried) == (12, 12) and row.confidence_median > 0


def weights_model(path: str, threads: int):
    """A linear model whose weights are in a file."""
    weights = np.load(path)

    def model(lines, widths):
        steps = lines[:, 0].mean(axis=1)[:, ::8]
        return weights[None, :, None] * steps[:, None, :] * threads, np.maximum(1, widths // 8)

    return model


def test_a_model_found_by_its_name(spark, tmp_path) -> None:
    file = tmp_path / f"weights-{uuid.uuid4().hex}.npy"
    np.save(file, np.array([0.1, 3.0, 1.0], np.float32))
    model = assets.model_of(spark, Options(model=str(file), threads=2), weights_model)
    assert str(tmp_path) not in model.name and model.__getstate__()["opened"] is None
    got = recognise.recognise(frame(spark, {"a": page(1)}), Options(), model, CODEC).first()
    assert got.error is None and got.text.replace("\n", "").strip("a") == "" and got.line_count == 3
    with pytest.raises(FileNotFoundError):
        assets.ship(spark, "/no/such/model")
    with pytest.raises(ValueError, match="no model"):
        assets.model_of(spark, Options(), weights_model)


def test_codecs_and_embedded_assets(spark, tmp_path) -> None:
    codec = {"a": [1], "é": [2, 5], "\"": [3], "": [4]}
    file = tmp_path / "codec.json"
    file.write_text(json.dumps(codec), encoding="utf8")
    want = {1: "a", 2: "é", 5: "é", 3: '"', 4: ""}
    assert assets.read_codec(spark, str(file)) == want
    assert assets.read_codec(spark, base64.b64encode(json.dumps(codec).encode())) == want
    with pytest.raises(ValueError, match="stands for"):
        assets.read_codec(spark, base64.b64encode(b'{"a": [1], "b": [1]}'))
    with pytest.raises(ValueError, match="no classes"):
        assets.read_codec(spark, base64.b64encode(b"not json"))
    rows = spark.createDataFrame([(base64.b64encode(bytes(range(256))).decode(),), ("?",), (None,)], "e string")
    got = [r[0] for r in rows.select(assets.unpacked(F.col("e"))).collect()]
    assert bytes(got[0]) == bytes(range(256)) and got[1] is None and got[2] is None
    steps = spark.createDataFrame([(1, [(2, 1.0), (0, 1.0), (99, 1.0), (3, 1.0)], True)], f"id long, steps {decode.STEPS}, scored boolean")
    assert decode.decode_steps(steps, want).first().text == 'é"'


def test_batch_numbers_of_any_keys(spark) -> None:
    rng = random.Random(11)
    lines = [(f"page{p:03d}", i, rng.choice([80, 300]), 30) for p in range(60) for i in range(rng.randint(0, 30))]
    made = spark.createDataFrame(lines, "page_id string, line_no int, width int, height int").repartition(7)
    for options in (Options(), Options(sort=True), Options(batch=7)):
        got: dict = {}
        for r in batching.plan(made, options).collect():
            got.setdefault(r.bucket, []).append(((r.prepared,) if options.sort else ()) + (r.page_id, r.line_no, r.batch_no))
        assert sum(map(len, got.values())) == len(lines)
        for rows in got.values():
            assert [r[-1] for r in sorted(rows)] == [i // options.batch for i in range(len(rows))]
    assert batching.plan(made.limit(0), Options()).count() == 0


class Captured:
    """A table that hands out the function given to ``mapInArrow``."""

    def __getattr__(self, _):
        return lambda *args, **more: self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_pages_of_a_batch_are_made_one_by_one(spark, monkeypatch):
    """Memory of a batch of pages doesn't grow with their number; results are those of single pages."""
    import tracemalloc

    from docgrid import queries

    def peak(run, batch):
        tracemalloc.start()
        kept = [b for i, b in enumerate(run(iter([batch]))) if i < 3]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return kept, most

    n, h, w = 300, 60, 40
    cells = np.arange(h * w, dtype=np.int64) << 24 | 5 << 16 | 6 << 8 | 7
    lists = pa.ListArray.from_arrays(np.arange(0, n * h * w + 1, h * w, dtype=np.int32), pa.array(np.tile(cells, n)))
    pages = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([w] * n, pa.int32()), pa.array([h] * n, pa.int32()), lists], names=["page_id", "width", "height", "cells"])
    monkeypatch.setattr(queries.fx, "page_raster", lambda *_: Captured())
    made, most = peak(queries.raster_pages(spark, ""), pages)
    assert made[1].to_pylist() == [{"page_id": "1", "width": 2 * w, "height": 2 * h, "rgb": bytes([5, 6, 7]) * (4 * h * w), "error": None}]
    assert most < 2 << 20  # all pixels of the batch as objects: over 200 MB

    pages = pa.RecordBatch.from_arrays([pa.array(["a"] * n), *(pa.array([x] * n, pa.int32()) for x in (w, h)), pa.array([bytes(3 * h * w)] * n, pa.binary()), pa.nulls(n, pa.string())], names=["page_id", "width", "height", "rgb", "error"])
    made, most = peak(recognise.prepare(Captured(), Options(segmentation="none")), pages)
    assert made[2].num_rows == 1 and most < 1 << 20  # all pages: 2.1 MB
