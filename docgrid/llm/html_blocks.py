"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags by one scan from left to right.
The first pass labels each block from itself alone: blocks of menus, footers,
forms, adverts and the like, and those that are mostly links, are bad; long
blocks and those dense in stop words are good, whatever the language of a long
one; short ones stay undecided. The second pass gives an undecided block the
label of its nearest decided neighbour, and that of the good one if a good and a
bad one are equally near. Where a page marks its article, blocks outside it are
bad, and the first pass takes all blocks inside it but links and marked
boilerplate.

Class names, ids and roles that name boilerplate never hide the only article of
a page: if every marked article stands in an element so named (or is so named
itself), these names count for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm import scratch

#: Tags that bound a block (fixed by HTML).
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page: those that run to the page's end if unclosed, and others.
RAW = frozenset("script style title textarea noscript template".split())
SILENT = frozenset("svg math iframe object canvas audio video select".split())
#: Containers that are never part of an article, and those that aren't unless they hold the page's only one.
OUTSIDE = frozenset("nav footer aside menu dialog button fieldset".split())
UNLESS_ARTICLE = frozenset(["form"])
#: Class names, ids and roles that say the same of their element.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments respond disqus cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription share sharing social "
    "related recommended widget login signup search pagination pager toolbar copyright disclaimer complementary contentinfo hidden".split()
)
#: The same, but an article's own header may be called so.
PAGE_ONLY = frozenset("header masthead banner".split())
#: Hints that a section of an article may be about: as its id, with no other word, they don't count.
TOPICS = frozenset("login signup search subscription sharing notification alert consent cookie cookies copyright disclaimer advertising promotion navigation pagination".split())
#: Words that may stand beside a hint in a hyphenated name without changing what it says.
BESIDE = frozenset(
    "site page main global top bottom left right primary secondary first second container wrapper wrap box block list section area bar inner outer row column col "
    "link links item items form field button buttons icon icons text title heading message policy slot unit zone space google post posts article articles thread count reply widgets menus c l o m js u".split()
)
#: Hints that a page's layout may carry in a wrapper of everything: they count for nothing on a page that would be empty.
LAYOUT = frozenset("sidebar aside banner widget menu navbar toolbar overlay modal header masthead".split())
#: Elements that hold a page's text whatever they are called.
HOLDERS = frozenset("html body main".split())
#: Elements that end where the next of their kind, or one around it, begins (fixed by HTML); every block ends a ``p``.
ENDS = {"li": "p li", "dt": "p dt dd", "dd": "p dt dd", "td": "p td th", "th": "p td th", "tr": "p td th tr", "option": "p option"}
ENDED_BY = {tag: frozenset(names.split()) for tag, names in ENDS.items()}
_P = frozenset(["p"])

#: Frequent function words of the languages that pages are in.
STOP_WORDS = frozenset(
    "the of and to in a is that it for with was on are be this as by an or from at not have "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un une du que est pour dans qui par sur au avec pas plus "
    "el los las y se del por con no una su para al lo como más pero sus esta".split()
)
#: Elements without an end (fixed by HTML).
VOID = frozenset("area base col embed img input link meta param source track wbr".split())
SHORT_WORDS = 12
LONG_WORDS = 30
STOP_DENSE = 0.2
LINK_DENSE = 0.5

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+)?+""")
_CLOSES = {tag: re.compile(f"</{tag}(?![^\\s/>])", re.I) for tag in RAW | SILENT}
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_NONE = re.compile(r"display\s*:\s*none")


class Block:
    """A block's text, the share of it in links, and where it stands.

    ``barred``: in an element that is never part of an article, or boilerplate
    inside an article; ``hints`` and ``firm``: elements around it (or around its
    article) that are named like boilerplate, and those of them that aren't named
    like layout; ``named``: its article itself is named so.
    """

    __slots__ = ("text", "words", "linked", "barred", "hints", "firm", "named", "article", "label")

    def __init__(self, parts: list[tuple[str, bool]], barred: bool, hints: int, firm: int, named: bool, article: bool):
        told = [(unescape(t), link) for t, link in parts]
        self.words = "".join(t for t, _ in told).split()
        self.text = " ".join(self.words)
        self.linked = sum(len(t) for t, link in told if link) / max(1, sum(len(t) for t, _ in told))
        self.barred, self.hints, self.firm, self.named, self.article, self.label = barred, hints, firm, named, article, ""


def _says(name: str, hints: frozenset[str]) -> bool:
    """Whether a class name, id or role is a hint, alone or with words that don't change what it says."""
    parts = _PART.findall(name)
    return any(p in hints for p in parts) and all(p in hints or p in BESIDE or p in HINTS for p in parts)


def _attributes(html: str, at: int) -> tuple[int, dict[str, str]]:
    """(place of the closing sign or the page's end, attributes) of a tag from behind its name; the first of equal names counts."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()
        if at >= len(html) or html[at] == ">":
            return at, found
        if m.end() == m.start():  # an equals sign without a name
            at += 1


def _kind(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[str, bool, bool]:
    """What an element is - 'article', 'outside', 'hint' or '' - and whether it is named like boilerplate, and like layout only."""
    if tag in OUTSIDE or tag == "header" and not in_article:
        return "outside", False, False
    if tag not in HOLDERS and ("hidden" in attributes or "style" in attributes and _NONE.search(attributes["style"].lower()) or attributes.get("aria-hidden", "").lower() == "true"):
        return "outside", False, False
    keys = ("class", "id", "role") if not (in_article and tag == "section" and attributes.get("id", "").strip().lower() in TOPICS) else ("class", "role")
    names = [n for key in keys if key in attributes for n in attributes[key].lower().split()]
    said = [n for n in names if _says(n, HINTS) or not in_article and _says(n, PAGE_ONLY)] if tag not in HOLDERS else []
    layout = all(not (HINTS - LAYOUT).intersection(_PART.findall(n)) for n in said)
    if tag in ("article", "main"):
        return "article", bool(said), layout
    if said:
        return "hint", True, layout
    if tag in UNLESS_ARTICLE:
        return "hint", True, True
    if names and all(_PART.findall(n) == ["main"] for n in names) and tag in BLOCK and tag not in HOLDERS:
        return "article", False, False
    return "", False, False


class _Scan:
    """The open elements of a page, and the blocks found so far."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.parts: list[tuple[str, bool]] = []
        self.stack: list[tuple[str, str, bool]] = []
        self.open: dict[str, int] = {}
        self.outside = self.hints = self.firm = self.articles = self.muted = 0
        self.article_tags = 0
        self.around = (0, 0, False)  # hints and firm ones around the outermost article, and whether it is named so itself
        self.link = 0  # elements that were open, and one, where a link began

    def text(self, raw: str) -> None:
        if not self.muted:
            self.parts.append((raw, self.link > 0))

    def close(self) -> None:
        """End the block at hand."""
        if self.parts:
            hints, firm, named = self.around if self.articles else (self.hints, self.firm, False)
            inner = self.articles > 0 and self.hints > hints
            block = Block(self.parts, self.outside > 0 or inner, hints, firm, named, self.articles > 0)
            if block.words:
                self.out.append(block)
            self.parts = []

    def push(self, tag: str, kind: str, named: bool, layout: bool, inline: bool = False) -> None:
        if kind == "article" and named and self.article_tags:
            kind = "hint"  # a comment or teaser inside the article
        if kind == "article":
            if not self.articles:
                self.around = (self.hints, self.firm, named)
            self.articles += 1
            self.article_tags += tag == "article"
        self.outside += kind == "outside"
        self.hints += kind == "hint"
        self.firm += kind == "hint" and not layout
        self.muted += inline
        self.stack.append((tag, "inline" if inline else kind, layout))
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self) -> str:
        tag, kind, layout = self.stack.pop()
        self.open[tag] -= 1
        self.articles -= kind == "article"
        self.article_tags -= kind == "article" and tag == "article"
        self.outside -= kind == "outside"
        self.hints -= kind == "hint"
        self.firm -= kind == "hint" and not layout
        self.muted -= kind == "inline"
        if self.link > len(self.stack) + 1:
            self.link = 0
        return tag

    def end(self, tag: str) -> None:
        """Leave an element; an end without a beginning is passed over."""
        if self.open.get(tag):
            while self.pop() != tag:
                pass


def blocks(html: str) -> list[Block]:
    """The blocks of a page that have text, in page order.

    Every step moves forward, and what is sought in vain once isn't sought
    again, so that the time grows with the page's length alone.
    """
    scan, at, n = _Scan(), 0, len(html)
    unclosed: set[str] = set()
    while at < n:
        i = html.find("<", at)
        if i < 0:
            scan.text(html[at:])
            break
        if i > at:
            scan.text(html[at:i])
        ends = html.startswith("</", i)
        name = _NAME.match(html, i + 1 + ends)
        if not name:
            if html.startswith(("<!", "<?", "</"), i):
                sign = "-->" if html.startswith("<!--", i) else ">"
                j = html.find(sign, i + 2)
                at = n if j < 0 else j + len(sign)
            else:
                scan.text("<")
                at = i + 1
            continue
        tag = name[0].lower()
        if (j := name.end()) < n and html[j] == ">":
            attributes: dict[str, str] = {}
        else:
            j, attributes = _attributes(html, j)
        alone = html[j - 1] == "/"
        at = j + 1
        if tag in _CLOSES:
            if not ends and tag not in unclosed:
                m = _CLOSES[tag].search(html, at)
                if m:
                    j = html.find(">", m.end())
                    at = n if j < 0 else j + 1
                elif tag in RAW:
                    break
                else:
                    unclosed.add(tag)
            scan.text(" ")
        elif tag == "br":
            scan.text(" ")
        elif tag not in BLOCK:
            if ends:
                scan.link = 0 if tag == "a" else scan.link
                if scan.open.get(tag):
                    scan.end(tag)
            else:
                if tag == "a":
                    scan.link = len(scan.stack) + 1
                if attributes and not alone and tag not in VOID and _kind(tag, attributes, scan.articles > 0)[0] in ("outside", "hint"):
                    scan.push(tag, "", False, False, inline=True)
        else:
            scan.close()
            if ends:
                scan.end(tag)
            else:
                over = ENDED_BY.get(tag, _P)
                while scan.stack and (scan.stack[-1][0] in over or scan.stack[-1][1] == "inline"):
                    scan.pop()
                if tag != "hr" and not alone:
                    scan.push(tag, *_kind(tag, attributes, scan.articles > 0))
    scan.close()
    return scan.out


def _text_of_page(found: list[Block]) -> tuple[list[Block], bool]:
    """The blocks among which the text is sought, and whether the page marks them as its article."""
    free = [b for b in found if not b.barred]
    for holds in (lambda b: b.article and not b.hints and not b.named, lambda b: b.article and (b.hints > 0) != b.named):
        if any(map(holds, free)):
            return [b for b in free if holds(b)], True
    plain = [b for b in free if not b.hints and not b.named]
    return plain or [b for b in free if not b.firm and not b.named], False


def classify(found: list[Block]) -> None:
    """Label every block good or bad, in two passes."""
    inside, marked = _text_of_page(found)
    for b in found:
        b.label = "bad"
    for b in inside:
        n, told = len(b.words), _WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in told) / max(1, len(told))
        if b.linked > LINK_DENSE and (n < LONG_WORDS or stops < STOP_DENSE):
            continue
        # code, tables and other languages have few stop words
        b.label = "good" if marked or n >= LONG_WORDS or n >= SHORT_WORDS and stops >= STOP_DENSE else ""
    if not any(b.label == "good" for b in inside):
        for b in inside:  # nothing long enough to decide by: what isn't marked as boilerplate is the text
            b.label = b.label or "good"
        return
    for b, label in zip(inside, inherited([b.label for b in inside])):
        b.label = label


def inherited(labels: list[str]) -> list[str]:
    """``labels`` with each empty one replaced by the nearest other, by "good" where both sides are equally near."""
    n = len(labels)
    before, after = [-1] * n, [-1] * n  # places of the nearest decided ones
    for near, places in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = -1
        for i in places:
            last = i if labels[i] else last
            near[i] = last
    out = []
    for i, (j, k) in enumerate(zip(before, after)):
        if j < 0 or k < 0:
            out.append(labels[max(j, k)])
        elif i - j == k - i:
            out.append("good" if "good" in (labels[j], labels[k]) else labels[j])
        else:
            out.append(labels[j if i - j < k - i else k])
    return out


def main_text(html: str | None) -> str:
    """The good blocks of a page, joined by two line feeds; empty if there are none."""
    found = blocks(html or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    A null or empty html and a page without blocks have an empty text and zero
    characters. Every row is extracted by itself, so repeated rows give repeated
    rows, null ids and urls stay null, and an empty table gives an empty result.
    Other columns of ``pages`` are neither read nor returned, whatever their names.
    """
    rows = scratch.spread(pages.select("page_id", "url", F.col(html).alias("__html")))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
