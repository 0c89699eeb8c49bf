"""BPE, decontamination, classifiers, language model, licences, HTML and WARC against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re

import numpy as np
import pytest
from data import DOC_SCHEMA, documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrid.llm import chunked_bpe, html_blocks, licences, lm, positional_index, scratch, subword_quality, toxicity, warc
from docgrid.llm.queries import WORD_BPE

needs_tokenizer = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="tokenizer files are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOC_SCHEMA)


def whole(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


@needs_tokenizer
def test_bpe_of_documents(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD_BPE)
    want = []
    for r in docs.collect():
        ids, text = whole(plain, r["text"] or "")
        want.append((r["doc_id"], len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text))))
    got = [tuple(r) for r in chunked_bpe.encode(docs, WORD_BPE, ["doc_id"]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


ALPHABET = st.sampled_from([*"abAB 12'.,-\t\n\r", "'s", "don't", " ", " ", "　", "é", "é", "́", "ß", "İ", "Σ", "ς", "日本", "‍", "🙂", "<|endoftext|>", "<|startoftext|> ", "\u0085", " ", "한", "\x0b", "\x1c"])


SMALL_CHUNKS = [chunked_bpe.Encoder(WORD_BPE, bits=bits) for bits in (2, 4, chunked_bpe.CUT_BITS)] if os.path.exists(WORD_BPE) else []


@needs_tokenizer
@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join))
def test_bpe_of_any_text(text):
    for encoder in SMALL_CHUNKS:
        ids, decoded = whole(encoder.tokenizer, text)
        assert encoder.encode([text.encode()]) == [(len(ids), " ".join(map(str, ids)).encode(), decoded.encode())]
        assert "".join(chunked_bpe.chunks(text.encode(), encoder.bits)) == text


@needs_tokenizer
def test_bpe_with_little_memory():
    rng = random.Random(1)
    encoder = chunked_bpe.Encoder(WORD_BPE, memory=16)
    texts = [words(rng, 200) for _ in range(5)]
    for text, (n, ids, _) in zip(texts, encoder.encode([t.encode() for t in texts])):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)).encode())


@needs_tokenizer
def test_bpe_of_long_texts(spark):
    rng = random.Random(2)
    passage = words(rng, 20_000)
    texts = [passage * 12, "x" * 300_000, passage[:5000] + "日本語" * 100_000, " ".join(["one"] * 50_000), passage]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, __text string")
    assert max(map(len, texts)) > 1 << 20
    got = {r["doc_id"]: r for r in chunked_bpe.encode(docs, WORD_BPE, ["doc_id", "__text"], outputs=("token_ids", "decoded")).collect()}
    for i, t in enumerate(texts):
        ids, decoded = whole(SMALL_CHUNKS[0].tokenizer, t)
        assert (got[i]["token_ids"], got[i]["decoded"], got[i]["n_tokens"], got[i]["__text"]) == (ids, decoded, len(ids), "c")
    assert chunked_bpe.encode(docs.limit(0), WORD_BPE, ["doc_id"]).count() == 0


@needs_tokenizer
def test_bpe_chunks_are_encoded_once_and_windows_widen():
    rng = random.Random(3)
    encoder = chunked_bpe.Encoder(WORD_BPE)
    text = words(rng, 3000)
    encoder.encode([text.encode()])
    before = encoder.encoded
    [(n, ids, _)] = encoder.encode([("other words first. " + text + " and last.").encode()])
    assert encoder.encoded - before <= 6 and n > 3000
    # a chunk that is remembered wrongly at its ends doesn't agree with its windows, which then take its place
    [x] = [c for c in chunked_bpe.chunks(text.encode())][3:4]
    held = encoder.chunks.young[x]
    i, j, k, m = held.at
    held.ids[i:j] += 1
    held.ids[k:m] += 1
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode([text.encode()])[0][1] == " ".join(map(str, want)).encode() and encoder.widened == 1


@pytest.mark.parametrize("bits", [1, 3, 9])
def test_cuts_look_back_only(bits, monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    want = chunked_bpe.cuts(data, bits)
    monkeypatch.setattr(chunked_bpe, "CUT_BYTES", 100)
    assert (chunked_bpe.cuts(data, bits) == want).all()
    shifted = chunked_bpe.cuts(data[777:], bits) + 777
    assert set(want[want > 777 + chunked_bpe.LOOK_BACK]) == set(shifted[shifted > 777 + chunked_bpe.LOOK_BACK])


def brute_contamination(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, names = cut(text), set(), set()
    for item, t in items:
        v = cut(t)
        size = min(10, len(v))
        for i in range(len(v) - size + 1) if v and item is not None else ():
            for k in range(len(w) - size + 1):
                if w[k : k + size] == v[i : i + size]:
                    hit |= set(range(k, k + size))
                    names.add(str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast", [scratch.BROADCAST_ROWS, 0])
def test_contamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(scratch.sized, "__defaults__", (broadcast,))
    rng = random.Random(3)
    items = [(1, words(rng, 30)), (2, words(rng, 12)), (10, "one"), (3, "same same same"), (4, None), (5, " .,"), (None, words(rng, 15)), (7, words(rng, 12))]
    items += [(8, items[1][1].upper())]
    texts = [None, "", "one", "two ONE-two", "same same same same", *(words(rng, 50) for _ in range(5))]
    for _, t in items[:2]:
        w = t.split()
        texts += [words(rng, 20) + " " + " ".join(w[1:11]) + "! " + words(rng, 5), t + " " + t, " ".join(w[:9])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[-2])], "doc_id long, text string")
    rows = scratch.with_row_ids(docs, "t")
    got = rows.join(positional_index.contamination(rows, spark.createDataFrame(items, "item_id long, text string")), scratch.ROW).drop(scratch.ROW)
    for r in got.collect():
        assert tuple(r)[2:] == brute_contamination(r["text"], items), r
    assert got.count() == len(texts) + 1
    left = positional_index.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.count() == got.where("not contaminated").count()
    assert left.columns == docs.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert positional_index.decontaminate(docs, none).count() == docs.count()
    assert positional_index.decontaminate(docs.limit(0), none).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x rare y unusual z"), (2, "rare unusual"), (3, "unusual a b c d e f rare")], "doc_id long, text string")
    rows = scratch.with_row_ids(docs, "t")
    windows = positional_index.Windows(spark.createDataFrame([(1, "rare unusual")], "item_id long, text string"))
    found = positional_index.Index(rows, windows).proximities(1).join(rows, scratch.ROW)
    assert sorted((r["doc_id"], abs(r["shift"])) for r in found.collect()) == [(1, 1), (2, 0)]


def labelled(spark, rng, n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = words(rng, 40) if not bad else " ".join(w.upper() + "!!" for w in words(rng, 40).split())
        if i % 4 == 0:
            text += " you worthless clown " + words(rng, 3)
        rows.append((i, text))
        labels.append((i, int(not bad), int(i % 4 == 0)))
    rows += [(n, None), (n + 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark, random.Random(2))
    model = subword_quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in subword_quality.score(docs, model).collect()}
    truth = {i: i % 3 != 0 for i in range(300)}
    assert sum((got[i] >= 0.5) == truth[i] for i in truth) >= 297
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 302
    empty = subword_quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in subword_quality.score(docs, empty).collect()} == {0.5}


def test_toxicity(spark):
    docs, labels = labelled(spark, random.Random(2))
    lexicon, weights = toxicity.fit(docs, labels)
    assert {"worthless", "clown"} <= set(lexicon.terms)
    more = spark.createDataFrame([(1000, "such a WORTHLES thing"), (1001, 'he said "clown" once'), (1002, "alpha beta"), (1003, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.unionByName(more), (lexicon, weights)).collect()}
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in range(300)) >= 298
    assert got[1000] > got[1002] == got[1003]
    assert got[0] > got[1001]
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, none).collect())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["loser", "idiot", "worthless", "disgusting", "scum"]), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("dri"), st.sampled_from("abeost")), max_size=3))
def test_automaton_finds_what_edit_distance_finds(term, changes):
    lexicon = toxicity.Lexicon({t: 0.9 for t in ("loser", "idiot", "worthless", "disgusting", "scum")}, {})
    w = list(term)
    for at, kind, c in changes:
        at = min(at, len(w))
        w[at : at + (kind != "i")] = [] if kind == "d" else [c]
    word = "".join(w)
    most = 0 if len(word) < 4 else 1 if len(word) < 8 else 2
    want = any(t == word or (d := edits(word, t)) <= most and len(t) >= toxicity.EDITS[d - 1] for t in lexicon.terms)
    assert bool(lexicon.verdict(word.encode())) == want


def test_language_model(spark):
    rng = random.Random(4)
    pairs = {"a": "b", "b": "c", "c": "a"}
    texts = []
    for _ in range(400):
        w = [rng.choice("abc")]
        for _ in range(30):
            w.append(pairs[w[-1]] if rng.random() < 0.9 else rng.choice("abc"))
        texts.append(" ".join(w) + (" rare%d" % rng.randint(0, 50) if rng.random() < 0.3 else ""))
    texts += [None, "", "never seen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    from collections import Counter
    from zlib import crc32

    held = {i: crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    counts: Counter = Counter()
    for i, t in enumerate(texts):
        if not held[i]:
            counts.update([*(t or "").lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens = [*(t or "").lower().split(), None]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm.score(docs.limit(0)).count() == 0


def test_language_model_rare_words_by_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"x y z{i % 7} x w{i}") for i in range(60)], "doc_id long, text string")
    full = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "KNOWN", 3)
    few = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in lm.score(docs).collect()}
    assert {i: n for i, (_, n) in full.items()} == {i: n for i, (_, n) in few.items()}
    assert all(few[i][0] == pytest.approx(full[i][0]) for i in full)


def test_model_is_normalised():
    share = np.log(np.full(300, 1 / 300))
    model = lm.Model(share, np.log([128 / 300, 128 / 300, 44 / 300]))
    for one, two in ((0, 300), (3, 3), (300, 300)):
        logs = model.log(np.arange(300), np.full(300, one), np.full(300, two))
        assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)
        h = (model.one[one] + model.two[two]).astype(float)
        for w in (0, 130, 299):  # the formula, one output at a time
            c = w // lm.CLASS
            top = np.exp(model.cls @ h + model.cbias)
            leaf = np.exp(model.out[c * lm.CLASS : (c + 1) * lm.CLASS] @ h + model.bias[c * lm.CLASS : (c + 1) * lm.CLASS])
            assert logs[w] == pytest.approx(np.log(top[c] / top.sum() * leaf[w - c * lm.CLASS] / leaf.sum()), abs=1e-4)


def test_scores_are_those_of_the_model_token_by_token(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 4)
    monkeypatch.setattr(lm, "TAILS", 2)
    monkeypatch.setattr(lm, "CLASS", 3)
    monkeypatch.setattr(lm, "PORTION_BYTES", 64)
    monkeypatch.setattr(lm, "PORTION", 7)
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda docs, voc: kept.setdefault("model", (voc, train(docs, voc)))[1])
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["aa", "ba", "ca", "da", "xyz", "vyz", "q"]) + rng.choice(["", "", "s"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    texts += ["unseen words only", None, "", "aa " * 500]
    docs = spark.createDataFrame([*enumerate(texts), (None, "aa ba"), (3, texts[3])], "doc_id long, text string")
    got = lm.score(docs).collect()
    voc, model = kept["model"]
    from collections import Counter
    from zlib import crc32

    counts: Counter = Counter()
    for i, t in [*enumerate(texts), (3, texts[3])]:
        if crc32(str(i).encode()) % 5 != 1:
            counts.update((t or "").split())
    if crc32(b"") % 5 != 1:
        counts.update(["aa", "ba"])
    own = {w for w, i in voc.index.items() if not voc.shared[voc.output[i]]}
    for r in got:
        text = "aa ba" if r["doc_id"] is None else texts[r["doc_id"]]
        tokens = [w.encode() for w in (text or "").split()]
        outs = [int(voc.output[voc.index[w]]) if w in own else voc.tail(w) for w in tokens] + [voc.end]
        want = 0.0
        for k, o in enumerate(outs):
            one, two = outs[k - 1] if k else voc.size, outs[k - 2] if k > 1 else voc.size
            want += float(model.log(np.array([o]), np.array([one]), np.array([two]))[0]) / np.log(10)
            if k < len(tokens) and voc.shared[o]:
                members = {w: n for w, n in counts.items() if w.encode() not in own and voc.tail(w.encode()) == o}
                want += np.log10((counts[tokens[k].decode()] + 0.5) / (sum(members.values()) + 0.5 * (len(members) + 1)))
        assert r["score"] == pytest.approx(want, rel=1e-4, abs=1e-3), (r, tokens, outs, own, voc.endings, voc.other, voc.end, [str(x) for x in (voc.log_within, voc.shared)])


def test_rounds_and_tasks_learn_alike(spark, monkeypatch):
    rng = random.Random(4)
    after = {"a": "b", "b": "c", "c": "a"}
    texts = []
    for _ in range(600):
        w = ["a"]
        while len(w) < 40:
            w.append(after[w[-1]] if rng.random() < 0.9 else rng.choice("abc"))
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm, "LEAST_TOKENS", 100)
    for parts in (1, 12):
        rows = lm.score(docs.repartition(parts)).where("held_out").collect()
        gain = (sum(r["score"] for r in rows) - sum(r["base_score"] for r in rows)) / sum(r["n_tokens"] for r in rows)
        assert gain > 0.2  # log10 a token


def brute_dice(text):
    cut = lambda t: [w for w in re.findall("[a-z0-9]+", t.lower())]
    pairs = lambda t: set(zip(cut(t), cut(t)[1:]))
    found = []
    for s in licences.segments((text or "").encode()):
        own = pairs(s.decode())
        best = min(((-2 * len(own & pairs(body)) / (len(own) + len(pairs(body))), name) for name, body in licences.TEMPLATES), default=None)
        if own and -best[0] >= licences.LEAST:
            found.append(best)
    return (min(found)[1], -min(found)[0], len(found)) if found else (None, None, 0)


def test_licences(spark):
    bodies = [b for _, b in licences.TEMPLATES]
    texts = [None, "", "nothing here", *bodies, "intro\n" + bodies[0] + "\nmore", bodies[3].replace(", ", ",\n"), "a\n\n" + bodies[3].replace(" to ", "\nto ") + "\n\nb", "released under the mit licence", "MIT License"]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r["licence"], r["dice"], r["n_matches"]) == pytest.approx(brute_dice(texts[r["doc_id"]])), texts[r["doc_id"]]
    assert sum(r["n_matches"] > 0 for r in got) >= len(bodies) + 3


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>The &amp; title</h1><p>The first   paragraph of the text is\n here, and it is <b>long</b> enough to be what it is&nbsp;now.<br>Same block.</p><p>Short.
<p>Unclosed <a href="x>y">link</a> here</p><div class="ad">Buy now</div></article>
<aside>Side</aside><form>Name <input></form><div id="comments"><p>Reader says the article is good and it is what it was to be.</p></div><footer>&copy; me</footer><!-- x <p>no</p> --></body></html>"""


def test_main_text():
    assert html_blocks.main_text(PAGE).split("\n\n") == ["The & title", "The first paragraph of the text is here, and it is long enough to be what it is now. Same block.", "Short.", "Unclosed link here"]
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<nav>x</nav>") == ""
    assert html_blocks.main_text("plain words") == "plain words"
    assert html_blocks.main_text("<script>open <p>x") == ""


def test_unmarked_page_uses_densities():
    body = "The point of it is that the text is long and that it has the words of the language in it, as is the way of all of it, and so on."
    page = f"<div><a href=/>Home</a> <a href=/b>Blog</a></div><div>Heading of it</div><div>{body}</div><div>short one</div><div>{body}</div><div><a href=/c>more</a> <a href=/d>and more</a></div>"
    assert html_blocks.main_text(page).split("\n\n") == ["Heading of it", body, "short one", body]


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_blocks.extract(pages).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[None]["text"] == ""


def test_warc_round_trip(spark):
    big = "WARC/1.1\r\nWARC-Type: fake\r\n\r\n" + "né " * 200
    rows = [(5, "http://a/ b", big), (3, None, big), (9, "u\r\nX: y", big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None), (6, "u", ""), (3, "again", big), (None, "u", big), (None, "u", "z" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r)[:5] for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = html == big and page != 3
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)


def test_warc_pushdown(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", ("body %d " % (i // 2)) * 30) for i in range(10)], "page_id long, url string, html string")
    path = scratch.new_path(spark, "w")
    warc.write(pages, path)
    some = warc.read(spark, path).where("record_type = 'response' and target_uri in ('http://h/2', 'http://h/4', 'http://h/3')")
    assert sorted((r["target_uri"], bytes(r["payload"]).decode()) for r in some.collect()) == [("http://h/2", "body 1 " * 30), ("http://h/4", "body 2 " * 30)]
    assert warc.read(spark, path, payload=False).where("payload is not null").count() == 0
    assert warc.read(spark, path).count() == 10
    reader = warc.WarcReader({"path": "x"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 3)]))
    assert len(left) == 1 and reader.wanted == [("warc-type", frozenset(["revisit"]))]


def test_warc_truncated_and_packed(tmp_path):
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    reader = warc.WarcReader({"path": str(tmp_path)})
    rows = [b for part in reader.partitions() for b in reader.read(part)]
    assert [p for b in rows for p in b.column("payload").to_pylist()] == [b"hello"] * 5
    for cut in (record[:30], record[:-7]):
        (tmp_path / "a.warc").write_bytes(record + cut)
        with pytest.raises(ValueError, match="archive ends"):
            for part in reader.partitions():
                list(reader.read(part))


NOTICES = {
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
    "This work is licensed under the GNU General Public License, version 1.": "GPL-1.0",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "CC-BY-3.0",
    "Licensed under the Eclipse Public License, Version 2.0.": "EPL-2.0",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)": "BSL-1.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.": "LGPL-3.0",
}


def test_notices_of_every_version(spark):
    rows = [(i, text) for i, text in enumerate(NOTICES)]
    rows += [(100, f"Copyright 2020 A. Body. {licences._CONDITIONS} {licences._TWO} {licences._DISCLAIMER}"), (101, f"Hi. {licences._CONDITIONS} {licences._TWO} {licences._THIRD} {licences._DISCLAIMER}")]
    got = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(NOTICES.values())) | {100: "BSD-2-Clause", 101: "BSD-3-Clause"}


def test_licences_of_awkward_tables(spark, docs):
    assert licences.scan(docs).count() == docs.count()
    assert licences.scan(docs.limit(0)).count() == 0


def archive(tmp_path, *heads, body=b"x" * 20, tail=b""):
    (tmp_path / "a.warc").write_bytes(b"".join(b"WARC/1.1\r\n" + h + b"\r\n\r\n" + body + b"\r\n\r\n" for h in heads) + tail)
    return str(tmp_path)


def test_warc_presence_is_tested(spark, tmp_path):
    path = archive(tmp_path, b"WARC-Type: response\r\nContent-Length: 20", b"WARC-Record-ID: <u>\r\nContent-Length: 20", b"WARC-Type: revisit\r\nContent-Length: 20")
    got = warc.read(spark, f"file://{path}")
    assert got.where("record_type is not null").count() == 2 and got.where("record_type is null").count() == 1
    assert got.where("record_id is not null").select("record_type").collect()[0][0] is None
    assert got.where("record_type = 'response'").count() == 1


@pytest.mark.parametrize("wanted", [[], [("warc-type", frozenset(["other"]))]])
def test_warc_that_ends_early_is_an_error_behind_filters(tmp_path, wanted):
    good = b"WARC-Type: response\r\nContent-Length: 20"
    for heads, tail, message in (([good], b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 20\r\n\r\nshort", "ends"), ([good, b"WARC-Type: response"], b"", "Content-Length"), ([good, b"Content-Length: -4"], b"", "Content-Length")):
        reader = warc.WarcReader({"path": archive(tmp_path, *heads, tail=tail)})
        reader.wanted = wanted
        with pytest.raises(ValueError, match=message):
            [list(reader.read(p)) for p in reader.partitions()]


def test_warc_of_many_small_records_and_long_ones(spark, tmp_path):
    import time

    heads = [b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 20" % i for i in range(100_000)]
    reader = warc.WarcReader({"path": archive(tmp_path, *heads)})
    began = time.perf_counter()
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(heads)
    assert time.perf_counter() - began < 10  # seconds where the buffer is copied for every record it is over a minute
    long = "z" * (3 * warc.READ_BYTES + 7)
    rows = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, None, long + "y"), (None, "u", None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(rows).collect()}
    assert got == {1: (len(long), "response", None), 2: (len(long), "revisit", 1), 3: (len(long) + 1, "response", None), None: (0, "response", None)}
    clash = rows.limit(0).withColumn("record_type", rows.url).withColumn("payload", rows.url)
    assert warc.round_trip(clash).count() == 0


@needs_tokenizer
def test_bpe_words_are_known_by_stem_and_case(monkeypatch):
    """What differs in case or in the punctuation behind it goes through the tokenizer once; ids stay its own."""
    encoder = chunked_bpe.Encoder(WORD_BPE)
    stems = ["wörter", "naïveté", "x1y2", "it's", "łódź", "\u01f0et"]
    text = " ".join(s.upper() if i % 2 else s + end for s in stems for i, end in enumerate(["", ".", ",", "!?", "...", "***", "$$$", "'", "\x01", "|>", "<|endoftext|>"]))
    odd = ["J\u030cet. Abc", "A\u0301b e\u0301,", "<|ENDOFTEXT|> a", "<|endoftext|>. b<|startoftext|>,", "don't, WE'LL. 's' a''s.", "\x01 \x01. a\x01b", "ﬁ, Σας. ς", "a\x85b.\xa0c, d", "İstanbul. \x1c, e\x1d."]
    for t in [text, *odd, " ".join(odd)]:
        e = encoder.tokenizer.encode(t, add_special_tokens=False)
        assert encoder.encode([t.encode()])[0] == (len(e.ids), " ".join(map(str, e.ids)).encode(), encoder.tokenizer.decode(e.ids, skip_special_tokens=False).encode())
    sent: list[bytes] = []
    fresh = chunked_bpe.Encoder(WORD_BPE)
    monkeypatch.setattr(fresh, "_through_joined", lambda ws, f=fresh._through_joined: sent.extend(ws) or f(ws))
    fresh.encode([b"One one, ONE. one! One? w0rd w0rd, W0RD;"])
    assert sorted(sent) == [b"!", b",", b".", b";", b"?", b"w0rd"]
