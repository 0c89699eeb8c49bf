"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from data import DOC_SCHEMA, documents

from docgrid.llm import block_names, components, near_sets, positional_index, scratch, simhash, subword_quality


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOC_SCHEMA)


@pytest.mark.parametrize("size", [4096, 7])
def test_exact_groups(spark, docs, size):
    rows = scratch.with_row_ids(docs, "t")
    got = block_names.exact_groups(rows, size=size).collect()
    texts = {r[scratch.ROW]: (r["doc_id"], lower(r["text"])) for r in rows.collect()}
    assert len(got) == len(texts)
    by_text: dict = {}
    for row, (doc_id, text) in texts.items():
        by_text.setdefault(text, []).append((doc_id is not None, doc_id or 0, -row, doc_id, row))
    for r in got:
        doc_id, text = texts[r[scratch.ROW]]
        best = max(by_text[text])
        assert (r["doc_id"], r["keep_id"], r["group_size"]) == (doc_id, best[3], len(by_text[text]))
        assert r["kept"] == (r[scratch.ROW] == best[4])
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_keeps_columns(docs):
    kept = block_names.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = [lower(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lower(r["text"]) for r in docs.collect()})


def test_equal_hashes_of_different_blocks(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    rows = scratch.with_row_ids(docs, "t")
    want = sorted(map(str, block_names.exact_groups(rows).collect()))
    monkeypatch.setattr(block_names.F, "xxhash64", lambda c: F.length(F.col(c)).cast("long"))
    assert sorted(map(str, block_names.exact_groups(rows).collect())) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC_SCHEMA)
    assert block_names.exact_dedup(none).count() == 0
    assert simhash.near_components(none).count() == 0
    assert simhash.near_dedup(none).count() == 0


def fingerprint(text, shingle=4):
    w = lower(text).encode()
    for c in b"\t\n\x0b\x0c\r":
        w = w.replace(bytes([c]), b" ")
    w = [x for x in w.split(b" ") if x]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= radius:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    groups: dict = {}
    for x, i in zip(label, ids):
        groups.setdefault(x, []).append(i)
    return [min((i for i in groups[x] if i is not None), default=None) for x in label]


def test_near_components(docs):
    rows = docs.collect()
    prints = [fingerprint(r["text"]) for r in rows]
    want = sorted(map(str, zip([r["doc_id"] for r in rows], [f"{p:016x}" for p in prints], brute_components([r["doc_id"] for r in rows], prints, 4))))
    got = simhash.near_components(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_near_dedup_keeps_one_of_each_group(docs):
    got = simhash.near_dedup(docs)
    assert got.columns == docs.columns
    groups = {r["component_id"] for r in simhash.near_components(docs).collect()}
    assert got.count() == len(groups)


@pytest.mark.parametrize("radius", [0, 2, 4, 7])
def test_forest_search_is_complete(radius):
    rng = np.random.default_rng(radius)
    centre = rng.integers(-(2**63), 2**63, 6)
    near = [int(c) % 2**64 ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 6)))) for c in centre for _ in range(40)]
    values = np.array(near, np.uint64).view(np.int64)
    shard = np.sort(rng.integers(0, 3, len(values)))
    forest = simhash.Forest(values, shard)
    found = {(int(q), int(n)) for qs, ns in forest.search(values, shard, radius) for q, n in zip(qs, ns)}
    want = {(i, j) for i in range(len(near)) for j in range(len(near)) if shard[i] == shard[j] and (near[i] ^ near[j]).bit_count() <= radius}
    assert found == want


@pytest.mark.parametrize(("limit", "mean", "agree"), [(20_000, 512, 1), (25, 512, 1), (20_000, 0.02, 2), (20, 0.0001, 3)])
def test_links_join_what_brute_force_joins(spark, monkeypatch, limit, mean, agree):
    monkeypatch.setattr(simhash, "HOT_ROWS", limit)
    monkeypatch.setattr(simhash, "SHARD_ROWS", mean)
    assert simhash.shard_plan(300, 4)[1] == agree
    rng = random.Random(limit)
    prints = set()
    for _ in range(8):
        c = rng.getrandbits(64)
        for _ in range(40):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
            prints.add(c)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    got = {r["fp"]: r["label"] for r in simhash.near_groups(frame, 4).collect()}
    groups: dict = {}
    for p, x in got.items():
        groups.setdefault(x, set()).add(p)
    want: dict = {}
    for p, x in zip(signed, brute_components(list(range(len(signed))), [p & (2**64 - 1) for p in signed], 4)):
        want.setdefault(x, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("radius", [1, 4])
def test_finer_masks_keep_every_link(radius):
    rng = random.Random(radius)
    masks = simhash.masks(*simhash.shard_plan(10**7, radius))
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, radius)))
        agreed = [m % 2**64 for m in masks if not (a ^ b) & m]
        assert agreed
        for m in agreed:
            finer = simhash.finer_masks(m, radius)
            assert len(finer) == radius + 1 and all(f & m == m for f in (x % 2**64 for x in finer)) and any(not (a ^ b) & f for f in finer)


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "q", "t", "x"), (2, "A b", 8, "q", "t", "x"), (3, None, 9, "q", "t", "x")], "doc_id long, text string, __row long, __quality string, __text string, label string")
    items = spark.createDataFrame([(1, "zz")], "item_id long, text string")
    for got, ids in ((block_names.exact_dedup(docs), [2, 3]), (simhash.near_dedup(docs), [1, 3]), (near_sets.near_dedup(docs), [1, 3]), (positional_index.decontaminate(docs, items), [1, 2, 3])):
        assert got.columns == docs.columns
        assert sorted((r["doc_id"], r["__row"]) for r in got.collect()) == [(i, i + 6) for i in ids]
    model = (np.zeros(subword_quality.BUCKETS, np.float32), 0.5)
    got = subword_quality.score(docs, model, name="__quality")
    assert got.columns == ["doc_id", "text", "__row", "__text", "label", "__quality"] and {r["__text"] for r in got.collect()} == {"t"}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}


def test_words_are_taken_from_the_texts_once(spark, monkeypatch):
    rows = scratch.with_row_ids(spark.createDataFrame([(1, "a b c d"), (2, "b c"), (3, None)], "doc_id long, text string"), "t")
    windows = positional_index.Windows(spark.createDataFrame([(1, "b c")], "item_id long, text string"))
    plans, keep = [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    index = positional_index.Index(rows, windows)
    assert sum("regexp_extract_all" in p for p in plans) == 1
    assert sorted(r["start"] for r in index.phrases().collect()) == [0, 1]
