"""What a deployment plugs in: a recognition model, layout analysis, PDF rendering."""

from __future__ import annotations

import os
from typing import Protocol

import numpy as np


class Recogniser(Protocol):
    def __call__(self, lines: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """float32 [n, 1, 48, width] and int64 [n] -> logits [n, classes, steps] or ids [n, steps], and valid steps."""


class LayoutProvider(Protocol):
    def __call__(self, rgb: np.ndarray, dpi: int, psm: int, binary_threshold: int) -> np.ndarray:
        """int32 [n, 4] text-line boxes (x0, y0, x1, y1) in natural order, or [n, 5] with the type of the line's block."""


class Rasteriser(Protocol):
    def __call__(self, pdf: bytes, page: int, scale: float) -> np.ndarray:
        """uint8 [height, width, 3] of a page, from 1."""


class StubRecogniser:
    """Deterministic stand-in: a step for each 8 pixels, its class by the step's darkness."""

    def __init__(self, classes: int = 8):
        self.classes = classes

    def __call__(self, lines: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, _, h, w = lines.shape
        steps = max(1, w // 8)
        dark = lines[:, 0, :, : steps * 8].reshape(n, h, steps, -1).mean(axis=(1, 3)) if w >= 8 else lines.mean(axis=(1, 2, 3))[:, None]
        best = np.minimum((dark * 3 * self.classes).astype(int), self.classes - 1)
        logits = np.zeros((n, self.classes, steps), np.float32)
        np.put_along_axis(logits, best[:, None, :], 1 + dark[:, None, :].astype(np.float32), axis=1)
        return logits, np.maximum(1, widths // 8)


class OnnxRecogniser:
    """A model file run by onnxruntime; its session is made once in each Python worker."""

    def __init__(self, path: str, threads: int = 1):
        self.path, self.threads, self.session = path, threads, None

    def check(self) -> None:
        """Fail before any task runs if the model isn't there."""
        if not os.path.isfile(self.path):
            raise FileNotFoundError(f"no model file {self.path}")

    def __getstate__(self) -> dict:
        return {"path": self.path, "threads": self.threads, "session": None}

    def __call__(self, lines: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.session is None:
            import onnxruntime as ort

            options = ort.SessionOptions()
            options.intra_op_num_threads = self.threads
            self.session = ort.InferenceSession(self.path, options, providers=["CPUExecutionProvider"])
        names = [o.name for o in self.session.get_outputs()]
        out = dict(zip(names, self.session.run(None, {"image": lines, "sequence_lengths": widths})))
        told = out.get("class_ids", out.get("logits", out[names[0]]))
        told = told.reshape(told.shape[0], -1, told.shape[-1]) if told.ndim > 2 else told
        told = told[:, 0] if "class_ids" in out and told.ndim == 3 else told
        return told, out.get("output_lengths", np.full(len(lines), told.shape[-1]))


def no_rasteriser(pdf: bytes, page: int, scale: float) -> np.ndarray:
    raise RuntimeError("no PDF rasteriser is configured: pass one to docgrid.sources.images.pdf_pages")
