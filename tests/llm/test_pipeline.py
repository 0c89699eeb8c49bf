"""The pipeline against its stages in plain Python, and the entry without it."""

from __future__ import annotations

import os
import random

import corpus_pipeline
import pytest
from data import words
from test_dedup import lower
from test_near_sets import brute_groups
from test_text_ops import brute_contamination, needs_tokenizer

from docgrid.llm import scratch, subword_quality


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    top = tmp_path_factory.mktemp("sf")
    items = [(i, words(rng, 14)) for i in range(3)]
    texts = [words(rng, 60) for _ in range(30)]
    texts += [texts[0].upper(), texts[1], texts[2] + " tail", None, "", items[0][1] + " " + words(rng, 30)]
    texts += [" ".join(w.upper() + "!!" for w in words(rng, 50).split()) for _ in range(10)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    labels = [(i, int(i < 36), 0) for i in range(len(texts)) if i not in (33, 34)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


@needs_tokenizer
def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = subword_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = {r["doc_id"]: r["text"] for r in subword_quality.score(docs, model).where("score >= 0.5").collect()}
    assert set(range(30)) <= set(left) and not set(range(36, 46)) & set(left)
    last = {lower(t): i for i, t in sorted(left.items())}
    left = {i: left[i] for i in last.values()}
    ids = sorted(left)
    groups: dict = {}
    for i, g in zip(ids, brute_groups([left[i] for i in ids])):
        groups.setdefault(g, []).append(i)
    left = {min(g): left[min(g)] for g in groups.values()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not brute_contamination(t, items)[-1]}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(left)
    assert 35 not in left and 1 not in left and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def _tables(spark) -> set[str]:
    top = scratch.shared_dir(spark).removeprefix("file://")
    return {x.split("-", 2)[2] for x in os.listdir(top)}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_stages_leave_no_tables_of_their_way(spark, sf_dir, tmp_path, monkeypatch, k):
    """Only the numbered rows and what is dropped of them are still there when a stage's result is read."""
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    assert _tables(spark) == {"docs", ["copies", "gone", "contaminated"][k - 1]}
    assert 0 < got.count() < docs.count()
