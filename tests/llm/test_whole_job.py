"""Cases that earlier versions cut short."""

from __future__ import annotations

import random

import numpy as np
import pytest

from data import words

from docgrid.llm import html_blocks, positional_index, scratch, subword_quality


def test_quality_reads_whole_runs_without_spaces():
    rng = random.Random(1)
    buckets = np.random.default_rng(1).normal(size=subword_quality.BUCKETS)
    for letters in ("abcdefgh01", "日本語中文字母表天地"):
        head = "".join(rng.choice(letters) for _ in range(60))
        text = head + "".join(rng.choice(letters) for _ in range(25_000))
        raw = text.encode()
        grams = [f"<{text}>"[i : i + n] for n in subword_quality.NGRAMS for i in range(len(text) + 2 - n + 1)]
        assert len(subword_quality.features(raw)) == 1 + len(grams)
        values = subword_quality.Values(buckets)
        want = np.mean([buckets[i] for i in subword_quality.features(raw)])
        assert subword_quality.log_odds(values, 0.0, raw) == pytest.approx(want) and not len(values)
        ids, share = subword_quality.bag(raw)
        assert share.sum() == pytest.approx(1, abs=1e-4) and share @ buckets[ids] == pytest.approx(want, abs=1e-4)


RUSSIAN = "Вчера вечером на главной площади города собрались тысячи жителей чтобы посмотреть большое представление которое подготовили местные артисты вместе с учениками музыкальной школы и оркестром областной филармонии под руководством нового дирижёра " * 2


@pytest.mark.parametrize("text", [RUSSIAN.strip(), " ".join(f"x{i} = call_{i}(y{i});" for i in range(30))])
def test_main_text_keeps_long_blocks_without_stop_words(text):
    menu = "".join(f"<li><a href=/{i}>Menu entry number {i} of many</a></li>" for i in range(12))
    page = f"<body><ul>{menu}</ul><div>scrap</div><div>{text}</div><div>{text}</div></body>"
    got = html_blocks.main_text(page).split("\n\n")
    assert got.count(text) == 2 and not any("Menu entry" in x for x in got)


BODY = "The point of it is that the text is long and that it has the words of the language in it, as is the way of all of it, and so on."


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="has-sidebar"><div>{BODY}</div></body>',
        f'<html class="no-hidden menu"><body id="page" class="sidebar cookies"><p>{BODY}</p></body></html>',
        f'<body><article class="post comments"><p>{BODY}</p></article></body>',
        f'<body><div class="content with-sidebar"><p>{BODY}</p></div></body>',
        f'<body><article class="related-post"><p>{BODY}</p></article></body>',
        f'<body><main class="widget"><p>{BODY}</p></main></body>',
    ],
)
def test_main_text_of_holders_named_like_boilerplate(page):
    assert html_blocks.main_text(page) == BODY


@pytest.mark.parametrize("name", ["sidebar", "left-sidebar", "related-posts", "cookie-notice", "comment-list", "social share", "site-footer", "x ad-slot", "nav__links", "page-header"])
def test_main_text_drops_known_boilerplate(name):
    assert html_blocks.main_text(f'<body><div class="{name}"><p>{BODY} Not this.</p></div><div>{BODY}</div></body>') == BODY


def test_items_without_id_are_sought(spark):
    rng = random.Random(9)
    hidden, named = " ".join(f"h{i}" for i in range(14)), " ".join(f"n{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"{words(rng, 20)} {hidden}"), (2, named), (3, words(rng, 30))], "doc_id long, text string")
    items = spark.createDataFrame([(None, hidden), (5, named), (None, named)], "item_id long, text string")
    rows = scratch.with_row_ids(docs, "t")
    got = rows.join(positional_index.contamination(rows, items), scratch.ROW).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(14, 0, True), (14, 1, True), (0, 0, False)]
    assert [r["doc_id"] for r in positional_index.decontaminate(docs, items).collect()] == [3]
