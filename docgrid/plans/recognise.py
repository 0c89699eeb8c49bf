"""From pages to text: segment, batch, recognise, decode, look again, join.

A page's pixels go through two passes of Arrow batches, one that cuts it into lines and
one that runs the model. What leaves the second is a class and its logit a step, so no
logits pass through Spark, and a line that is uncertain is looked at again in the task
that has its pixels. All else is joins and aggregates of small rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.functions.scalars import prepared_width
from docgrid.operators import batching, crop, decode, order, pixels, rasters, segment, text
from docgrid.operators.metrics import RunTimings, run_summary
from docgrid.options import Options
from docgrid.sources import stored
from docgrid.sources.providers import LayoutProvider, Recogniser

LINE_SCHEMA = "page_id string, line_no int, x int, y int, width int, height int, rgb binary, error string, transform struct<crop_x:int,crop_y:int,trim_x:int,trim_y:int,scale:double>"
_TRANSFORM = pa.struct([("crop_x", pa.int32()), ("crop_y", pa.int32()), ("trim_x", pa.int32()), ("trim_y", pa.int32()), ("scale", pa.float64())])
_LINE_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), _TRANSFORM)
_LINE_NAMES = ["page_id", "line_no", "x", "y", "width", "height", "rgb", "error", "transform"]

STEP_SCHEMA = f"page_id string, line_no int, steps {decode.STEPS}, scored boolean, retried boolean, error string"
_STEP_NAMES = ["page_id", "line_no", "steps", "scored", "retried", "error"]


def resize(raster: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize of [h, w, 3], pixel centres aligned."""
    h, w = raster.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    r = raster.astype(np.float64)
    top = r[y0][:, x0] * (1 - fx) + r[y0][:, x1] * fx
    low = r[y1][:, x0] * (1 - fx) + r[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def prepare(pages: DataFrame, options: Options, layout: LayoutProvider | None = None, crop_to: tuple[float, float, float, float] | None = None, timings: RunTimings | None = None) -> DataFrame:
    """A row with its raster for each line of ``pages``; a page that fails has one row, with ``error``.

    ``crop_to`` is a template (fractions of the page) that every page is cut to first. Boxes
    are in pixels of that part. With ``options.layout_trim`` the layout provider sees what is
    left without white margins, enlarged by ``options.layout_scale``, and in black and white
    where ``options.layout_binary`` is a threshold. ``transform`` tells how a page was cut and scaled; ``on_page`` adds the boxes' places on the whole page.
    """
    spent = timings.layout if timings else None

    def found(rgb: np.ndarray) -> tuple[list[tuple[int, int, int, int]], tuple[int, int, float]]:
        h, w = rgb.shape[:2]
        if options.segmentation == "none":
            return [(0, 0, w, h)], (0, 0, 1.0)
        if options.segmentation == "fast":
            return segment.drop_header(segment.page_lines(rgb), w, h), (0, 0, 1.0)
        if layout is None:
            raise RuntimeError("segmentation by layout needs a layout provider")
        scale = options.layout_scale
        x0, y0, x1, y1 = segment.trim_kernel(rgb) if options.layout_trim else (0, 0, w, h)
        part = np.ascontiguousarray(rgb[y0:y1, x0:x1])
        seen = part if scale == 1 else resize(part, max(1, int((y1 - y0) * scale + 0.5)), max(1, int((x1 - x0) * scale + 0.5)))
        if options.layout_binary > 0:
            seen = pixels.binary_kernel(seen, options.layout_binary)
        boxes = crop.text_boxes(layout(seen, crop.layout_dpi(scale), options.layout_psm, options.layout_binary)) / scale
        boxes = order.ordered([tuple(b) for b in (boxes + [x0, y0, x0, y0]).tolist()], w, h)
        l, t, r, b = crop.MARGINS
        return [(int(max(0, a - l)), int(max(0, c - t)), int(max(1, min(w, d + r) - max(0, a - l))), int(max(1, min(h, e + b) - max(0, c - t)))) for a, c, d, e in boxes], (x0, y0, float(scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rasters.each_row(batch):
                page_id, width, height, data, error = (c.as_py() for c in row)
                rows, began = [], time.perf_counter()
                try:
                    if error:
                        raise ValueError(error)
                    rgb = np.frombuffer(data, np.uint8).reshape(height, width, 3)
                    left, above = 0, 0
                    if crop_to:
                        left, above, w, h = crop.crop_pixels(crop_to, width, height)
                        rgb = rgb[above : above + h, left : left + w]
                    boxes, trim = found(rgb)
                    told = dict(zip(("crop_x", "crop_y", "trim_x", "trim_y", "scale"), (left, above, *trim)))
                    for i, (x, y, w, h) in enumerate(boxes):
                        top = max(0, y - 6) if options.segmentation == "fast" else y
                        part = rgb[top : top + h, x : x + w]
                        rows.append([page_id, i, x, y, part.shape[1], part.shape[0], part.tobytes(), None, told])
                except Exception as e:
                    if options.on_error == "raise":
                        raise
                    rows = [[page_id, 0, None, None, None, None, None, str(e), None]]
                if spent is not None:
                    spent.add(time.perf_counter() - began)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LINE_TYPES)], names=_LINE_NAMES)

    return pages.select("page_id", "width", "height", "rgb", "error").mapInArrow(run, LINE_SCHEMA)


def on_page(lines: DataFrame) -> DataFrame:
    """``lines`` of ``prepare`` with page_x and page_y, their places on the page before it was cut."""
    return lines.withColumns({"page_x": F.col("x") + F.col("transform.crop_x"), "page_y": F.col("y") + F.col("transform.crop_y")})


def _batched(lines: DataFrame, options: Options) -> DataFrame:
    """``lines`` with prepared, bucket and batch_no, in the order in which they are run.

    Batches are made where the lines are (batch_no null): a task's lines are sorted by
    width and don't move. Or they are planned over all pages, from widths alone
    (``batching.plan``): the plan is joined to the lines, broadcast if it is small, and
    each batch's pixels go to one task by one exchange, which spills.
    """
    if options.batches == "local":
        made = batching.with_width(lines, options).withColumn("bucket", F.ceil(F.col("prepared") / options.bucket).cast("int"))
        made = made.withColumns({"bucket": F.lit(0) if options.sort else F.coalesce("bucket", F.lit(0)), "batch_no": F.lit(None).cast("long")})
        return made.sortWithinPartitions("bucket", *(["prepared"] if options.sort else []), "page_id", "line_no")
    lines = stored.kept(lines)
    plan = stored.kept(batching.plan(lines.where("error is null").select("page_id", "line_no", "width", "height"), options).select("page_id", "line_no", "prepared", "bucket", "batch_no"))
    plan = F.broadcast(plan) if plan.count() <= stored.BROADCAST_ROWS else plan
    return lines.join(plan, ["page_id", "line_no"], "left").repartition("bucket", "batch_no").sortWithinPartitions("bucket", "batch_no", *(["prepared"] if options.sort else []), "page_id", "line_no")


def infer(lines: DataFrame, options: Options, recogniser: Recogniser, timings: RunTimings | None = None) -> DataFrame:
    """(page_id, line_no, steps, scored, retried, error) of every line, and of every page that failed before.

    ``steps`` has the best class and its logit at each valid step; ``scored`` is false for
    models that give classes alone. Lines below the confidence ``options.retry`` are run
    again, larger, and have what comes of it. A batch that the model fails on is halved until
    the lines that it can't take stand alone: they have an ``error`` and null steps, or end
    the job, as ``options.on_error`` says. A line's preprocessing never depends on its batch.
    """
    spent = timings.inference if timings else None
    again = replace(options, scale=options.retry_scale)
    may_retry = options.retry > 0 and options.scale < options.retry_scale

    def tensor(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        widths = np.array([r["prepared"] for r in rows], np.int64)
        most = int(widths.max())
        most = next((w for w in options.widths if w >= most), most)
        out = np.zeros((len(rows), 1, options.line_height, most), np.float32)
        for i, r in enumerate(rows):
            raster = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
            line = np.full((options.line_height, r["prepared"], 3), 255, np.uint8)
            inner = r["prepared"] - 2 * options.pad
            line[:, options.pad : options.pad + inner] = resize(raster, options.line_height, inner)
            out[i, 0, :, : r["prepared"]] = pixels.preprocess(line, options.pre)
        return out, widths

    def told(rows: list[dict], steps: pa.Array, scored: bool, retried: bool, error: str | None) -> pa.RecordBatch:
        n = len(rows)
        keys = [pa.array([r["page_id"] for r in rows], pa.string()), pa.array([r["line_no"] for r in rows], pa.int32())]
        flags = [pa.array([scored] * n), pa.array([retried] * n), pa.array([error] * n, pa.string())]
        return pa.RecordBatch.from_arrays([*keys, steps, *flags], names=_STEP_NAMES)

    def failed(row: dict, error: str, retried: bool) -> pa.RecordBatch:
        return told([row], pa.nulls(1, decode.best_arrays(np.zeros((0, 0), int), None, np.zeros(0)).type), False, retried, error)

    def model(rows: list[dict], doubt: list[dict] | None) -> Iterator[pa.RecordBatch]:
        """Results of a batch; lines to run again are put to ``doubt``, if there is one, in place of a result."""
        retried = doubt is None and may_retry
        try:
            out, valid = recogniser(*tensor(rows))
            valid = np.asarray(valid)
            if len(out) != len(rows) or len(valid) != len(rows):
                raise ValueError(f"the model returned {len(out)} results for {len(rows)} lines")
            best, top = (out, None) if out.ndim == 2 else decode.best_kernel(out)
        except Exception as e:
            if options.on_error == "raise":
                raise
            if len(rows) == 1:
                yield failed(rows[0], str(e) or type(e).__name__, retried)
                return
            for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
                yield from model(part, doubt)
            return
        sure = np.ones(len(rows), bool)
        if doubt is not None and may_retry and top is not None:
            sure = np.array([not c < options.retry for c in decode.confidences(best, top, valid)])
            doubt += [row for row, s in zip(rows, sure) if not s]
        if sure.any():
            stay = [row for row, s in zip(rows, sure) if s]
            yield told(stay, decode.best_arrays(best[sure], None if top is None else top[sure], valid[sure]), top is not None, retried, None)

    def timed(rows: list[dict], doubt: list[dict] | None) -> list[pa.RecordBatch]:
        began = time.perf_counter()
        made = list(model(rows, doubt))
        if spent is not None:
            spent.add(time.perf_counter() - began)
        return made

    def second(doubt: list[dict]) -> Iterator[pa.RecordBatch]:
        """Lines run again, by width; ``prepared`` is that of the larger scale."""
        for r in doubt:
            r["prepared"] = r["again"]
        doubt.sort(key=lambda r: (r["prepared"], r["page_id"], r["line_no"]))
        for k in range(0, len(doubt), options.batch):
            yield from timed(doubt[k : k + options.batch], None)
        doubt.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        doubt: list[dict] = []
        for b in batches:
            for row in (r for k in range(0, b.num_rows, options.batch) for r in b.slice(k, options.batch).to_pylist()):
                if row["error"] is not None:
                    yield failed(row, row["error"], False)
                    continue
                if held and (len(held) == options.batch or (row["bucket"], row["batch_no"]) != (held[0]["bucket"], held[0]["batch_no"])):
                    yield from timed(held, doubt)
                    held = []
                    if len(doubt) >= 4 * options.batch:
                        yield from second(doubt)
                held.append(row)
        if held:
            yield from timed(held, doubt)
        yield from second(doubt)

    made = _batched(lines, options).withColumn("again", prepared_width(F.col("width"), F.col("height"), F.lit(again.scale), again.pad, again.line_height))
    return made.select("page_id", "line_no", "width", "height", "rgb", "prepared", "again", "bucket", "batch_no", "error").mapInArrow(run, STEP_SCHEMA)


def recognise_lines(lines: DataFrame, options: Options, recogniser: Recogniser, codec: Mapping[int, str], timings: RunTimings | None = None) -> DataFrame:
    """(page_id, line_no, text, confidence, retried, error) of every line; those with an error have no text."""
    told = decode.decode_steps(infer(lines, options, recogniser, timings), codec)
    return told.select("page_id", "line_no", "text", "confidence", "retried", "error")


def page_results(results: DataFrame) -> DataFrame:
    """(page_id, line_count, text, error): lines of ``recognise_lines`` put together; a page with an error has its first one and no text."""
    error = F.min(F.when(F.col("error").isNotNull(), F.struct("line_no", "error")))["error"]
    line = F.struct(F.col("line_no").alias("o"), F.coalesce("text", F.lit("")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["t"]), "\n")
    made = results.groupBy("page_id").agg(error.alias("error"), F.count(F.lit(1)).alias("n"), joined.alias("joined"))
    fine = F.col("error").isNull()
    return made.select("page_id", F.when(fine, F.col("n")).otherwise(0).alias("line_count"), F.when(fine, text.clean(F.col("joined"))).alias("text"), "error")


def recognise_prepared(lines: DataFrame, options: Options, recogniser: Recogniser, codec: Mapping[int, str], timings: RunTimings | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id, line_count, text, error) and the one-row summary (``run_summary``) of lines that were prepared before.

    Results of the lines are stored, so that the model runs once for both.
    """
    results = stored.kept(recognise_lines(lines, options, recogniser, codec, timings))
    return page_results(results), run_summary(results.where("error is null"))


def recognise(
    pages: DataFrame,
    options: Options,
    recogniser: Recogniser,
    codec: Mapping[int, str],
    layout: LayoutProvider | None = None,
    crop_to: tuple[float, float, float, float] | None = None,
    timings: RunTimings | None = None,
) -> DataFrame:
    """(page_id, line_count, text, error) of every page; failed pages have a null text, pages without lines an empty one.

    A page fails by itself, in segmentation or at the model; all others have their text.
    ``timings`` are told the seconds of the stages and the counts of the result.
    """
    if hasattr(recogniser, "check"):
        recogniser.check()
    lines = prepare(pages, options, layout, crop_to, timings)
    texts = page_results(recognise_lines(lines, options, recogniser, codec, timings))
    joined = pages.select("page_id").join(texts, "page_id", "left")
    out = joined.select("page_id", F.coalesce("line_count", F.lit(0)).alias("line_count"), F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error")
    return timings.watch(out) if timings else out


def ordered_regions(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Layout boxes in reading order, as padded and clipped regions."""
    return crop.regions(order.reading_order(boxes, width, height), width, height)
