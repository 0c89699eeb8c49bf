"""Awkward tables through the operators that score or scan, and the two forms of a text's mean vector."""

from __future__ import annotations

import random

import numpy as np
import pytest
from data import DOC_SCHEMA, documents, words
from pyspark.sql import functions as F

from docgrid.llm import filter_audit, licences, periodic_runs, queries, repeats, subword_quality, toxicity


@pytest.fixture(scope="module")
def rows():
    long = "an idiot said so, " * 20_000 + "Released under the MIT License."
    return [*documents(), (777, long, "en", "s", len(long), "x", 1, 2, 3, "y"), (778, long, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA).withColumns({"score": F.lit("mine"), "licence": F.lit(1), "a": F.lit(2), "mask": F.lit(3)})


def same_texts_same_results(rows: list[tuple], got: list[tuple]) -> None:
    """Results (id, result ...) have every row of ``rows``, and rows of one id and text one result."""
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in rows)
    texts: dict = {}
    for r in rows:
        texts.setdefault(str(r[0]), []).append(r[1])
    results: dict = {}
    for r in got:
        results.setdefault(str(r[0]), set()).add(tuple(r[1:]))
    assert all(len(results[i]) <= len(set(t)) for i, t in texts.items())


def test_toxicity(spark, rows, docs) -> None:
    rng = random.Random(3)
    learn = [(1000 + i, words(rng, 30) + (" you idiot" if i % 4 == 0 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, int(t.endswith("idiot"))) for i, t in learn] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text").unionByName(spark.createDataFrame(learn, "doc_id long, text string")), labels)
    got = [tuple(r) for r in toxicity.score(docs, model).collect()]
    same_texts_same_results(rows, got)
    score = {i: s for i, s in got}
    assert score[777] > 0.5 > score[0] and score[777] == score[778] and all(0 <= s <= 1 for _, s in got)
    assert toxicity.score(docs.limit(0), model).collect() == []
    verdicts = toxicity.Verdicts(model[0])
    for i, text in [(r[0], r[1]) for r in rows if r[0] is not None][:40]:
        if sum(r[0] == i for r in rows) == 1:
            z = model[1] @ np.array([1.0, *toxicity.evidence(verdicts, (text or "").encode())])
            assert score[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality(spark, rows, docs) -> None:
    labels = spark.createDataFrame([(r[0], int(len(r[1] or "") > 200)) for r in rows] + [(None, 1), (9, None), (9, 0)], "doc_id long, quality int")
    model = subword_quality.fit(docs, labels)
    got = subword_quality.score(docs, model)
    assert sorted(got.columns) == sorted(docs.columns)
    got = [tuple(r) for r in got.select("doc_id", "score").collect()]
    same_texts_same_results(rows, got)
    assert all(0 <= s <= 1 for _, s in got) and subword_quality.score(docs.limit(0), model).count() == 0


def test_mean_vectors_in_both_forms() -> None:
    rng = random.Random(8)
    array = np.random.default_rng(2).normal(size=subword_quality.BUCKETS).astype(np.float32)
    values = subword_quality.Values(array)
    for _ in range(150):
        text = " ".join(rng.choice(["a", "bb", "ccc", "Dd", "é!", words(rng, 1), "x" * rng.randint(1, 90)]) for _ in range(rng.randint(0, 40))).encode()
        ids, share = subword_quality.bag(text)
        assert share.sum() == pytest.approx(1, abs=1e-4)
        assert subword_quality.log_odds(values, 0.25, text) == pytest.approx(0.25 + float(share @ array[ids]), abs=1e-3)


def test_licences(spark, rows, docs) -> None:
    got = [tuple(r) for r in licences.scan(docs).withColumn("licences", F.array_join("licences", ",")).collect()]
    same_texts_same_results(rows, got)
    assert {r[1] for r in got if r[0] in (777, 778)} == {"MIT"} and {r[1] for r in got if r[0] == 0} == {None}
    assert licences.scan(docs.limit(0)).columns == ["doc_id", "licence", "dice", "n_matches", "licences"]


def test_new_operators_with_long_texts_and_clashing_names(rows, docs) -> None:
    found = {r.doc_id: r for r in periodic_runs.find_runs(docs, ["doc_id", "a", "mask"]).collect()}
    assert [tuple(x) for x in found[777].runs] == [(0, 80_000, 4)] and found[777].a == 2
    kept = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert len(bytes(kept[778].kept)) == 0 and kept[777].n_bytes == len(rows[-1][1])
    assert len(bytes(kept[777].kept)) < 300
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"), F.lit("x").alias("mask"))
    told = filter_audit.audit_documents(docs, labels)
    assert told.where("step = 1").agg(F.sum(F.col("kept") + F.col("removed"))).first()[0] == 120 * len(rows)


def test_every_query_says_what_it_does_with_awkward_rows() -> None:
    for query in queries.QUERIES.values():
        assert query.__doc__ and "mpty" in query.__doc__ and "epeat" in query.__doc__


@pytest.mark.parametrize(("kind", "named"), [("string", "text"), ("binary", "text"), ("string", "TEXT")])
def test_quality_of_text_columns(spark, kind, named):
    """Text and bytes have the same scores, also by a name in other case; all columns stay in place."""
    model = np.random.default_rng(3).normal(size=subword_quality.BUCKETS).astype(np.float32), 0.0
    docs = spark.createDataFrame([(1, None, "a"), (2, "one né", "b"), (3, "", "c"), (4, "one né", None)], "doc_id long, body string, rest string")
    told = docs.select(docs.rest, docs.body.cast(kind).alias("text"), docs.doc_id)
    got = subword_quality.score(told, model, named)
    assert got.columns == ["rest", "text", "doc_id", "score"] and got.drop("score").schema == told.schema
    rows = got.collect()
    assert sorted(repr(r[:3]) for r in rows) == sorted(repr(tuple(r)) for r in told.collect())
    values = subword_quality.Values(model[0])
    for r in rows:
        z = subword_quality.log_odds(values, 0.0, {1: b"", 3: b""}.get(r["doc_id"], "one né".encode()))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))
