"""Removal of repeated byte strings against a plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest
from data import DOC_SCHEMA, documents

from docgrid.llm import repeats


def plain(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Removed spans of texts in the order that counts."""
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(gone) + b"\0", np.uint8).astype(int)))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


def corpus(seed: int) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢 ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(12, 60)) for _ in range(5)]
    texts = [prose(rng.randint(0, 30)) + rng.choice(passages) + prose(rng.randint(0, 20)) + rng.choice(passages)[7:] for _ in range(60)]
    texts += ["a" * 700, "a" * 99, "a" * 100, "ab" * 300, "", "x" * 50 + "y" * 130, "\0" * 300, "abc" * 90 + "d" + "abc" * 90]
    texts += [texts[3], texts[3][5:], texts[4] + texts[3]] + [prose(4000) + passages[0]]
    rng.shuffle(texts)
    return texts


def removed(spark, rows: list[tuple], length: int, schema: str = "doc_id long, text string") -> dict:
    got = repeats.remove_repeats(spark.createDataFrame(rows, schema).repartition(5), length=length).collect()
    return {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept), r.n_bytes) for r in got}


@pytest.mark.parametrize(("length", "slices", "piece"), [(100, 4096, 1 << 20), (100, 3, 700), (40, 3, 1 << 20), (8, 50, 1 << 20)])
def test_against_plain_search(spark, monkeypatch, length, slices, piece) -> None:
    monkeypatch.setattr(repeats, "PIECE", piece)
    texts = corpus(length + slices)
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "key long, text binary").repartition(5)
    found: dict[int, tuple[list, list]] = {}
    for r in repeats.repeated(rows, length, slices).collect():
        at, mask = found.setdefault(r.key, ([], []))
        at.append(r.at)
        mask.append(r.mask % 2**64)
    for i, want in enumerate(plain([t.encode() for t in texts], length)):
        at, mask = found.get(i, ([], []))
        got = repeats.spans_of(len(texts[i].encode()), np.array(at, np.int64), np.array(mask, np.uint64), length)
        assert [tuple(x) for x in got.tolist()] == want, (i, texts[i][:60])


def test_large_contexts_are_dealt_by_windows(spark) -> None:
    line = "Accept all cookies and continue reading this site or leave it now, whatever you like, and do so today. "
    rng = random.Random(3)
    mark = lambda: "".join(rng.choice("0123456789") for _ in range(90))
    texts = [mark() + line * (1 + i % 3) + mark() for i in range(120)]
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "key long, text binary")
    tell = lambda n: {(r.key, r.at, r.mask) for r in repeats.repeated(rows, 100, n).collect()}
    small, large = tell(4), tell(4096)
    assert small == large and len(large) > 100


def test_documents_in_order_of_their_ids(spark) -> None:
    t = corpus(1)
    rows = [(900 - i, x) for i, x in enumerate(t)]
    got = removed(spark, rows, 100)
    for (i, x), want in zip(sorted(rows), plain([x.encode() for _, x in sorted(rows)], 100)):
        raw = x.encode()
        ends = [0, *(e for s in want for e in s), len(raw)]
        assert got[i] == (want, b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])), len(raw))


def test_awkward_tables(spark) -> None:
    rows = documents()
    got = repeats.remove_repeats(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    # repeated ids: whichever order rows of one id have, as much is removed in all as of texts in any order
    texts = [(r[1] or "").encode() for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    assert sum(len(bytes(r.kept)) for r in got) == sum(len(t) for t in texts) - sum(e - s for x in plain(texts, 100) for s, e in x)
    last = [r for r in got if r.doc_id is None]
    assert all(r.n_bytes == 0 or not bytes(r.kept) for r in last)  # a null id comes after its copies
    assert repeats.remove_repeats(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
    assert removed(spark, [("b", "z" * 150), ("a", "z" * 150)], 100, "doc_id string, text string")["b"][1] == b""


def test_strings_too_short_to_parse() -> None:
    with pytest.raises(ValueError, match="too short"):
        repeats.span_of(7)
