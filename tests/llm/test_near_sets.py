"""The pipeline's near duplicates against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from data import DOC_SCHEMA, documents
from test_dedup import lower

from docgrid.llm import near_sets


def grams(text):
    w = lower(text).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    label = list(range(len(texts)))
    sets = [grams(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if label[i] != label[j] and (not either or len(sets[i] & sets[j]) / either >= 0.8):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def edited(rng, text, n):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("step", "cell"), [(100_000, 256), (1, 7)])
def test_stage_against_brute_force(spark, monkeypatch, step, cell):
    monkeypatch.setattr(near_sets, "STEP_PAIRS", step)
    monkeypatch.setattr(near_sets, "CELL", cell)
    rng = random.Random(11)
    texts = [None, "", " ", "one two", "One Two", "one two three"]
    for _ in range(25):
        base = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 300)))
        n = len(base.split(" "))
        texts += [base, *(edited(rng, base, max(1, round(n * share))) for share in (0.01, 0.02, 0.022, 0.025, 0.04, 0.1))]
    chain = " ".join(f"c{i}" for i in range(200))  # each link of the chain is alike to the next, its ends are not
    for _ in range(8):
        texts.append(chain)
        chain = edited(rng, chain, 3)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    groups: dict = {}
    for i, label in zip(ids, brute_groups(texts)):
        groups.setdefault(label, []).append(i)
    want = {min(g) for g in groups.values()}
    assert len(groups) < len(texts) - 60
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_awkward_rows(spark):
    docs = spark.createDataFrame(documents(), DOC_SCHEMA)
    got = near_sets.near_dedup(docs)
    assert got.columns == docs.columns
    assert got.count() == len(set(brute_groups([r["text"] for r in docs.collect()])))
    assert near_sets.near_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("part", "rounds"), [(64, 2), (6, 1)])
def test_a_bucket_with_half_of_all_rows(spark, part, rounds):
    """Pairs of a hot bucket, parted by bytes or dealt out in cells, are those of a plain search."""
    rng = np.random.default_rng(rounds)
    n, width, bands = 5000, near_sets.MINIMA, near_sets.BANDS * near_sets.BAND
    sketch = rng.integers(0, 256, (n, width)).astype(np.uint8)
    sketch[:2500, 40:44] = 7  # much alike in few places
    for i in range(0, 600, 2):  # near copies that agree in as few bytes as they may, or one fewer
        differ = rng.choice(width, width - near_sets.AGREE + (i % 6 == 0), replace=False)
        sketch[i + 1] = sketch[i]
        sketch[i + 1, differ] += 1
    key = [1] * 2500 + rng.integers(2, 900, n - 2500).tolist()
    label, size = rng.integers(0, 2000, n), rng.integers(80, 120, n)
    want = set()
    for k in set(key):
        of = np.flatnonzero(np.array(key) == k)
        for i in of:
            rest = of[of > i]
            near = (sketch[rest] == sketch[i]).sum(axis=1) >= near_sets.AGREE
            near &= (sketch[rest, :bands] == sketch[i, :bands]).sum(axis=1) >= near_sets.ROUGH
            near &= (label[rest] != label[i]) & (np.minimum(size[rest], size[i]) >= 0.8 * np.maximum(size[rest], size[i]) - 1e-9)
            want |= {(int(j), int(i)) for j in rest[near]}
    rows = [(key[i], i, int(label[i]), int(size[i]), sketch[i].tobytes()) for i in range(n)]
    entries = spark.createDataFrame(rows, f"key long, {near_sets.ROW} long, label long, size int, sketch binary")
    assert {tuple(r) for r in near_sets._crossing(entries, 0.8, 200, part, rounds).collect()} == want
    assert len(want) > 100


def test_stage_with_small_buckets_parted(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(300))
    texts = [edited(rng, base, rng.choice([2, 6, 8, 20])) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_sets.scratch.with_row_ids(docs, "docs")
    ids = {r[near_sets.ROW]: r["doc_id"] for r in rows.collect()}
    got: dict = {}
    for r in near_sets.near_rows(rows, hot=8).collect():
        got.setdefault(r["label"], set()).add(ids[r["node"]])
    want: dict = {}
    for i, label in enumerate(brute_groups(texts)):
        want.setdefault(label, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_fingerprints_propose_links(spark, monkeypatch):
    """Without any common band, texts whose fingerprints lie near are still linked, and only if they are alike."""
    monkeypatch.setattr(near_sets, "minima", lambda hashes: np.random.default_rng(int(hashes.sum() % 2**32)).integers(0, 2**63, near_sets.MINIMA, dtype=np.uint64))
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(400)) for _ in range(12)]
    texts = [t for b in base for t in (b, edited(rng, b, 1))]
    rows = near_sets.scratch.with_row_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    at = {r[near_sets.ROW]: r["doc_id"] for r in rows.collect()}
    near = {r["doc_id"]: r["component_id"] for r in near_sets.simhash.near_components(rows).collect()}
    want = {i for i in near if list(near.values()).count(near[i]) > 1}
    assert len(want) > 6
    assert {at[r["node"]] for r in near_sets.near_rows(rows).collect()} == want
    assert near_sets.near_rows(rows, least=0.999).count() == 0


@pytest.mark.parametrize("weight", [2 << 20, 9000])
def test_a_group_not_quite_alike_makes_no_table_of_its_pairs(spark, monkeypatch, weight):
    """Of texts of which most pairs just miss the similarity, no stored table has more rows than there are keys of bands."""
    monkeypatch.setattr(near_sets, "WEIGHT", weight, raising=False)
    rng = random.Random(7)
    base = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(300))
    texts = [edited(rng, base, 5) for _ in range(200)]
    texts += [edited(rng, t, 1) for t in texts[::10]]
    rows = near_sets.scratch.with_row_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    ids = {r[near_sets.ROW]: r["doc_id"] for r in rows.collect()}
    stored, keep = {}, near_sets.scratch.keep

    def counted(df, name):
        out = keep(df, name)
        stored[name] = max(stored.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_sets.scratch, "keep", counted)
    got: dict = {}
    for r in near_sets.near_rows(rows).collect():
        got.setdefault(r["label"], set()).add(ids[r["node"]])
    want: dict = {}
    for i, label in enumerate(brute_groups(texts)):
        want.setdefault(label, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    assert max(stored.values()) <= near_sets.BANDS * len(texts), stored
