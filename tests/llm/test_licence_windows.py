"""Licences that share their line or paragraph with other words."""

from __future__ import annotations

import pytest

from docgrid.llm import licences

FULL = max((t for n, t in licences.TEMPLATES if n == "MIT"), key=len)


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Copyright 2020 Example Authors. Released under the MIT License. See LICENSE for details.", "MIT"),
        (f"Copyright 2020 Example Authors. {FULL} " + "And more words. " * 30, "MIT"),
        (FULL, "MIT"),
        ("// some code here\n// Licensed under the Apache\n// License, Version 2.0.\n// and so on it goes with the code", "Apache-2.0"),
    ],
)
def test_mid_line(text, name):
    got = licences.Templates(licences.TEMPLATES, licences.LEAST).matches(text.encode())
    assert got and {n for _, n in got} == {name} and min(d for d, _ in got) >= 0.8


def test_windows_inside_matching_segments_do_not_count():
    of = licences.Templates(licences.TEMPLATES, licences.LEAST)
    assert len(of.matches(b"intro words\nReleased under the MIT License.\nmore")) == 1
    assert of.matches(b"nothing of the kind is under the license here") == []
