"""Runs of periodic words, and the filter audit, against plain forms."""

from __future__ import annotations

import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from data import DOC_SCHEMA, documents
from pyspark.sql import functions as F

from docgrid.llm import filter_audit, periodic_runs


def plain_runs(words: list, least: int, times: int) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // times + 1):
        same = [words[i] == words[i + p] for i in range(len(words) - p)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                if i - start + p >= max(least, times * p):
                    found.setdefault((start, i + p), p)
                start = None
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (9, 3)])
def test_runs_against_plain_search(least: int, times: int) -> None:
    rng = random.Random(least)
    for case in range(250):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
        if case % 3 == 0:
            base = [rng.choice("ab") for _ in range(rng.randint(1, 6))]
            words = words[:5] + base * rng.randint(2, 9) + base[: rng.randint(0, 3)] + words[5:]
        assert [tuple(r) for r in periodic_runs.word_runs(words, least, times).tolist()] == plain_runs(words, least, times)


def test_long_text_of_one_word() -> None:
    assert periodic_runs.word_runs(["x"] * 30_000).tolist() == [[0, 30_000, 1]]
    words = ["w%d" % (i % 7919) for i in range(40_000)]
    assert periodic_runs.word_runs(words).tolist() == [[0, 40_000, 7919]]


def test_extensions() -> None:
    rng = random.Random(1)
    for n in (2, 3, 9, 64, 100):
        names = np.array([rng.randint(0, 2) for _ in range(n)])
        e = periodic_runs.Extensions(names)
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        want = [next((k for k in range(n) if max(i, j) + k >= n or names[i + k] != names[j + k]), n) for i, j in pairs]
        assert e(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])).tolist() == want


def test_planted_texts(spark) -> None:
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(None, "p q r s t u v"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = docs.select("doc_id", "text", periodic_runs.plant(F.col("text"), F.col("doc_id")).alias("t")).collect()
    changed = 0
    for r in told:
        w, h = (r.text or "").split(), zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a, changed = g % n, changed + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        assert (r.t or "").split() == w
    assert changed > 20


def test_runs_of_awkward_rows(spark) -> None:
    rows = documents() + [(1, "so it goes " * 8 + "on", "en", "s", 1, "x", 1, 2, 3, "y")]
    got = periodic_runs.find_runs(spark.createDataFrame(rows, DOC_SCHEMA), ["doc_id", "name", "n", "pos"]).collect()
    assert len(got) == len(rows) and {r.name for r in got} == {"x"}
    for r, row in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_words)), sorted(rows, key=lambda r: (str(r[0]), len((r[1] or "").encode().split())))):
        assert r.n_words == len((row[1] or "").encode().split())
    it = next(r for r in got if r.doc_id == 1)
    assert [tuple(x) for x in it.runs] == [(0, 24, 3)] and it.collapsed == "so it goes on"
    assert periodic_runs.find_runs(spark.createDataFrame([], DOC_SCHEMA), ["doc_id"]).collect() == []
    with pytest.raises(ValueError, match="twice"):
        periodic_runs.find_runs(spark.createDataFrame(rows, DOC_SCHEMA).withColumn("runs", F.lit(1)), ["runs"])


def plain_mask(row: tuple, rows: list[tuple]) -> int:
    t = row[1] or ""
    w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    a, b = len(w) < 200, 100 * len(set(w)) < 50 * len(w)
    c, d = 100 * sum("A" <= x <= "Z" for x in t) > 3 * len(t), any(x in "#$%&*|" for x in t)
    e = row[0] is not None and any(o[0] is not None and o[0] < row[0] and (o[1] or "") == t for o in rows)
    return a + 2 * b + 4 * c + 8 * d + 16 * e


def test_audit_against_plain_orders(spark) -> None:
    rows = [(i, t, [None, "en", "de"][i % 3] if i is not None else "fr", *rest) for i, t, _, *rest in documents()]
    rows += [(500 + i, t, "en", *rows[0][3:]) for i, t in enumerate(["#1 " + "word " * 300, "a " * 250, "ABC " * 201, "ABC " * 201, "ok fine\n" * 3])]
    labels = [(0, 1, 0), (3, 1, 1), (6, None, 1), (6, 0, 1), (501, 1, None), (502, 1, 1), (503, 1, 0), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    got = filter_audit.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    told = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got}
    good = {i for i, q, _ in labels if q == 1 and i is not None} - {6}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    masks = [(r[2] or "", plain_mask(r, rows), r[0]) for r in rows]
    parts = {m[0] for m in masks}
    assert len(told) == len(parts) * 600
    removed_by: dict[tuple[str, str], int] = {}
    for part in parts:
        for order in permutations("ABCDE"):
            left, gone = [m for m in masks if m[0] == part], []
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                out = [m for m in left if m[1] & bit]
                redundant = sum(1 for m in gone if m[1] & bit)
                left, gone = [m for m in left if not m[1] & bit], gone + out
                alone = sum(1 for m in masks if m[0] == part and m[1] == bit)
                assert told[part, "".join(order), step][:6] == (len(left), len(out), redundant, alone, sum(m[2] in good for m in out), sum(m[2] in toxic for m in out))
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(out)
    assert all(v[6] == removed_by[p, o[s - 1]] for (p, o, s), v in told.items())


def test_transform_and_back(spark) -> None:
    rng = random.Random(2)
    rows = [("p", rng.randint(0, 7)) for _ in range(300)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int"), ["part"], 3)
    cells = {r.mask: r.n for r in filter_audit.mask_cells(sums, ["part"], 3).collect()}
    assert cells == {m: sum(1 for r in rows if r[1] == m) for m in range(8)}
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert filter_audit.audit_documents(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
