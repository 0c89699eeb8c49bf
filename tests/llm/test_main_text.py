"""Main text against plain rewritings of its rules, and on awkward and very long pages."""

from __future__ import annotations

import random
import time
from html import escape
from html.parser import HTMLParser

import pytest
from data import words
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrid.llm import html_blocks
from docgrid.llm.html_blocks import main_text

BODY = "The point of it is that the text is long and that it has the words of the language in it, as is the way of all of it, and so on."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body class="no-sidebar"><article><p>{}</p></article>', "{}"),
        ('<div class="right-sidebar post"><article><p>{}</p></article></div>', "{}"),
        ('<div class="widget-content"><article><p>{}</p></article></div>', "{}"),
        ('<div id="social-science"><article><p>{}</p></article></div>', "{}"),
        ("<form><main><p>{}</p></main></form>", "{}"),
        ("<article><section id=login><p>{}</p></section><section id=comments><p>no</p></section><section class=login><p>no</p></section></article>", "{}"),
        ("<section id=search><p>no</p></section><article><section id=Search><p>{}</p></section></article>", "{}"),
        ('<main><article class="post comments"><p>{}</p></article></main>', "{}"),
        ('<div class="right-sidebar"><div class="post"><p>{}</p></div></div>', "{}"),
        ("<article><p>{}</p><p>&copy; is how this one begins</p><table><tr><td>cell</td></tr></table><pre>code</pre><figcaption>seen</figcaption></article>", "{}\n\n© is how this one begins\n\ncell\n\ncode\n\nseen"),
        ("<article>{}<section class=comments><article class=comment>no</article></section></article>", "{}"),
        ("<div class=comments><article class=comment>no</article></div><div>{}</div>", "{}"),
        ("<article>{}</article><div class=related-posts><article>teaser</article></div>", "{}"),
        ("<article><p>{} <span class='ad-slot'>buy</span>now</p><p hidden>no</p><p style='display: none'>no</p></article>", "{} now"),
        ("<article><p>{}<p>&amp;lt;b&gt; &#233;&eacute;&nbsp;x</article>", "{}\n\n&lt;b> éé x"),
        ("<article><h1>Head</h1><ul><li><a href=/>all</a> <a href=/x>links</a></li></ul><p>{}</p></article>", "Head\n\n{}"),
        ("<div class=comments><p>{}</p></div>", ""),
    ],
)
def test_wrappers_and_boilerplate(page, want):
    assert main_text(page.format(BODY)) == want.format(BODY)


@pytest.mark.parametrize("unit", ["<svg>", '<a "', "<a x='", "-", "<!--", "<p class=ad>", "<script>", "&", "<a =", "a!", "<td>x"])
def test_long_input_takes_linear_time(unit):
    began = time.perf_counter()
    main_text(unit * (1_000_000 // len(unit)))
    deep = "<div>" * 50_000 + "</p>" * 50_000
    main_text(deep)
    assert time.perf_counter() - began < 12  # seconds, on a busy machine; a scan that goes back takes hours


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["", "good", "bad"]), max_size=30))
def test_inherited_labels(labels):
    got = html_blocks.inherited(labels) if any(labels) else labels
    for i, label in enumerate(labels):
        near = min((abs(i - k) for k, x in enumerate(labels) if x), default=None)
        sides = {x for k, x in enumerate(labels) if x and abs(i - k) == near}
        assert got[i] == (label or ("good" if "good" in sides else "bad" if sides else ""))


class Plain(HTMLParser):
    """Blocks of a well-formed page, the plain way."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.skip = [], "", 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in html_blocks.RAW
        self.cut(tag)

    def handle_endtag(self, tag):
        self.skip -= tag in html_blocks.RAW
        self.cut(tag)

    def cut(self, tag):
        if tag in html_blocks.BLOCK:
            self.blocks.append(self.now)
            self.now = ""
        elif tag == "br" or tag in html_blocks.RAW:
            self.now += " "

    def handle_data(self, data):
        self.now += "" if self.skip else data


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 5)):
        kind = rng.randint(0, 5 if depth < 4 else 2)
        if kind == 0:
            out += escape(words(rng, rng.randint(1, 40))) + rng.choice(["", " ", "\n\t", "<br>", "&eacute;&nbsp;"])
        elif kind == 1:
            out += f"<b title='a>b'>{escape(words(rng, 2))}</b><!-- {words(rng, 2)} <p> -->"
        elif kind == 2:
            out += f'<script>var x = "<p>{words(rng, 2)}</p>";</script>'
        else:
            tag = rng.choice(["div", "p", "section", "ul", "table", "h2", "blockquote"] if depth else ["div", "section"])
            out += f'<{tag} data-x="1">' + (random_page(rng, depth + 1) if tag not in ("p", "h2") else escape(words(rng, 9))) + f"</{tag}>"
    return out


@pytest.mark.parametrize("seed", range(40))
def test_blocks_and_labels_against_plain_rules(seed):
    page = random_page(random.Random(seed))
    plain = Plain()
    plain.feed(page)
    plain.close()
    texts = [" ".join(b.split()) for b in [*plain.blocks, plain.now] if b.split()]
    assert [b.text for b in html_blocks.blocks(page)] == texts
    labels = []
    for t in texts:
        found = html_blocks._WORD.findall(t.lower())
        dense = sum(w in html_blocks.STOP_WORDS for w in found) >= 0.2 * max(1, len(found))
        labels.append("good" if len(t.split()) >= 30 or len(t.split()) >= 12 and dense else "")
    want = html_blocks.inherited(labels) if any(labels) else ["good"] * len(labels)
    assert main_text(page) == "\n\n".join(t for t, x in zip(texts, want) if x == "good")


def test_frame_of_awkward_rows(spark):
    rows = [(1, "u", f"<p>{BODY}</p>", "x"), (1, "u", f"<p>{BODY}</p>", "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<p>" + "long " * 300_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_blocks.extract(pages).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == [BODY] * 2
    assert {r["page_id"]: r["n_chars"] for r in got} == {1: len(BODY), 2: 0, None: 0, 3: 5 * 300_000 - 1}
    assert html_blocks.extract(pages.limit(0)).count() == 0 and html_blocks.extract(pages).columns == ["page_id", "url", "text", "n_chars"]
