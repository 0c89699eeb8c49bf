"""Options of a recognition run, with the defaults in use."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Width scales by quality profile (fixed values).
PROFILES = {"quality": 1.0, "balanced": 0.85, "turbo": 0.76, "extreme": 0.7}


@dataclass(frozen=True)
class Options:
    """``from_text`` reads flags as a URL gives them, where 0 means the default but for ``pad``."""

    batch: int = 32
    bucket: int = 24
    pad: int = 16
    scale: float = 1.0
    line_height: int = 48
    sort: bool = False
    batches: str = "local"
    pre: str = "none"
    widths: tuple[int, ...] = ()
    segmentation: str = "fast"
    retry: float = 0.0
    retry_scale: float = 1.0
    layout_scale: float = 1.0
    layout_trim: bool = False
    layout_psm: int = 3
    layout_binary: int = 0
    model: str = ""
    threads: int = 1
    on_error: str = "column"

    def __post_init__(self) -> None:
        if self.pre not in ("none", "otsu", "sauvola", "morph", "auto"):
            raise ValueError(f"unknown preprocessing {self.pre!r}")
        if self.segmentation not in ("fast", "none", "layout"):
            raise ValueError(f"unknown segmentation {self.segmentation!r}")
        if self.batches not in ("local", "planned"):
            raise ValueError(f"unknown batches {self.batches!r}")
        if self.on_error not in ("column", "raise"):
            raise ValueError(f"unknown error policy {self.on_error!r}")

    @classmethod
    def from_text(cls, flags: Mapping[str, str]) -> Options:
        got = {}
        for f in fields(cls):
            if (raw := flags.get(f.name)) is None:
                continue
            if f.name == "widths":
                got[f.name] = tuple(sorted(int(x) for x in raw.split(",") if x.strip().isdigit() and int(x) > 0))
            elif isinstance(f.default, bool):
                got[f.name] = raw not in ("", "0", "false", "off")
            elif isinstance(f.default, (int, float)):
                try:
                    value = type(f.default)(float(raw))
                except ValueError:
                    continue
                if value or f.name == "pad":
                    got[f.name] = value
            else:
                got[f.name] = raw
        return cls(**got)


def recognition_workers(cores: object) -> int:
    """Workers for a machine's cores: all but one above two, else one."""
    try:
        n = max(1, int(float(cores)))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        n = 1
    return n - 1 if n > 2 else 1
