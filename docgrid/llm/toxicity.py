"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon comes from a bounded sample of labelled rows: words, and beginnings
of words, that occur in toxic texts far more surely than elsewhere (by the lower
bound of a confidence interval, over texts that aren't copies of each other). A
word's Levenshtein automaton is run along a trie of the lexicon, which finds all
terms within the allowed number of edits at once and so catches misspellings;
words that are known from harmless texts don't count as misspellings. Each hit
is looked at in its window of words: hits inside quotation marks or after a
verb of saying count as quoted. A small logistic model over plain, misspelled
and quoted hits, fitted on the same sample, gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm import scratch
from docgrid.llm.sampling import labelled_sample
from docgrid.llm.text import crc32_mod

#: Most labelled rows that lexicon and weights are fitted on; the lexicon takes all sure terms that these hold.
SAMPLE_ROWS = 12_000
#: A term's lower bound of the share of toxic texts among those it occurs in.
SURE = 0.6
#: That of terms which explain a toxic text by themselves: less sure ones must help with texts that have none of these.
VERY_SURE = 0.85
STEMS = (4, 5, 6)
#: Letters from which a word may have one edit, and two.
EDITS = (5, 9)
#: Words before and after a hit that are looked at.
WINDOW = 12
#: Words whose verdict a worker remembers before it starts anew.
MEMORY = 400_000

#: Verbs of saying, in the languages of the texts.
SAYING = frozenset(b"said says wrote writes called calls quote quoted dit dits sagte schrieb dijo escribi\xc3\xb3 \xc3\xa9crit".split())
OPENS, CLOSES = "\"“„«‹‘'", "\"”“»›’'"
_LEET = str.maketrans("013457@$", "oieastas")
_LETTER = re.compile(r"[^\W_]")
_INNER = re.compile(r"[\W_]+")


def plain(token: bytes) -> tuple[str, bool]:
    """A token's letters and digits in lower case, and whether signs within it were undone."""
    word = token.decode("utf-8", "replace").lower()
    if word.isalpha():
        return word, False
    first, end = _LETTER.search(word), len(word)
    if not first:
        return "", False
    while not word[end - 1].isalnum():
        end -= 1
    word = word[first.start() : end]
    if word.isalpha():
        return word, False
    bare = _INNER.sub("", word.translate(_LEET) if not word.isdigit() else word)
    return bare, bare != word


def _cut(term: str, parts: int) -> list[str]:
    return [term[len(term) * k // parts : len(term) * (k + 1) // parts] for k in range(parts)]


class Lexicon:
    """Terms with their sureness: a trie for whole words, a table of stems, and harmless neighbours."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], harmless: frozenset[str] = frozenset()):
        self.terms, self.stems, self.harmless = terms, stems, harmless
        self.trie: dict = {}
        self.pieces: set[tuple[int, int, str]] = set()
        for term in terms:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            for e in (1, 2):
                if len(term) >= EDITS[e - 1]:  # e edits leave one of e + 1 pieces as it was
                    self.pieces |= {(e, len(term), p) for p in _cut(term, e + 1)}
        self.sizes = sorted({(e, n) for e, n, _ in self.pieces})

    def may_match(self, word: str, edits: int) -> bool:
        """Whether the word holds a piece of a term of about its length near the piece's place."""
        n, pieces = len(word), self.pieces
        for e, size in self.sizes:
            if e <= edits and abs(size - n) <= e:
                for k in range(e + 1):
                    low, high = size * k // (e + 1), size * (k + 1) // (e + 1)
                    for shift in range(-e if k else 0, e + 1 if k else 1):
                        if (e, size, word[max(0, low + shift) : high + shift]) in pieces:
                            return True
        return False

    def near(self, word: str, edits: int) -> tuple[str, int] | None:
        """The term within ``edits`` edits that has the fewest, and their number.

        The automaton's state after a path of the trie is, for each number of
        edits, the set of places in the word that it may have reached, as bits.
        """
        n = len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        full = (1 << n + 1) - 1
        start = [(1 << e + 1) - 1 & full for e in range(edits + 1)]  # letters of the word may be left over
        best: tuple[str, int] | None = None
        todo = [(self.trie, start)]
        while todo:
            node, state = todo.pop()
            for c, below in node.items():
                if c == "":
                    for e, reached in enumerate(state):
                        if reached >> n & 1 and (best is None or (e, below) < (best[1], best[0])) and len(below) >= EDITS[min(e, 2) - 1] * (e > 0):
                            best = (below, e)
                    continue
                same = at.get(c, 0)
                new = []
                for e, reached in enumerate(state):
                    now = (reached & same) << 1
                    if e:
                        # a letter replaced, a letter of the term missing in the word, a letter too many in the word
                        now |= state[e - 1] << 1 | state[e - 1] | new[e - 1] << 1
                    new.append(now & full)
                if new[-1]:
                    todo.append((below, new))
        return best

    def verdict(self, token: bytes) -> tuple[float, bool] | None:
        """(sureness, misspelled) of the term that a token stands for, if any."""
        word, undone = plain(token)
        if not word:
            return None
        if word in self.terms:
            return self.terms[word], undone
        for k in STEMS:
            if word[:k] in self.stems and len(word) > k:
                return self.stems[word[:k]], undone
        edits = 0 if len(word) < EDITS[0] - 1 else 1 if len(word) < EDITS[1] - 1 else 2
        if not edits or word in self.harmless or not self.may_match(word, edits):
            return None
        found = self.near(word, edits)
        return found and (self.terms[found[0]], True)


class Verdicts(dict):
    """Verdicts of tokens, each worked out when first asked for."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: bytes) -> tuple[float, bool] | None:
        if len(self) >= MEMORY:
            self.clear()
        v = self[token] = self.lexicon.verdict(token)
        return v


def _quoted(words: list[bytes], at: int) -> bool:
    """Whether a hit stands between quotation marks, or behind a verb of saying and a mark, in its window."""
    before = [w.decode("utf-8", "replace") for w in words[max(0, at - WINDOW) : at + 1]]
    after = [w.decode("utf-8", "replace") for w in words[at : at + WINDOW + 1]]
    opened = False
    for w in before:
        if w[0] in OPENS:
            opened = True
        if w is not before[-1] and len(w) > 1 and w.rstrip(".,;:!?")[-1:] in CLOSES:
            opened = False
    closed = any(w.rstrip(".,;:!?")[-1:] in CLOSES and (len(w) > 1 or k) for k, w in enumerate(after))
    said = any(w.strip(b".,;:") in SAYING for w in words[max(0, at - WINDOW) : at])
    return opened and (closed or said)


def evidence(verdicts: Verdicts, text: bytes | None) -> tuple[float, float, float]:
    """Sureness of plain, misspelled and quoted hits of a text, summed, as log(1 + x)."""
    words = (text or b"").lower().split()
    sums = [0.0, 0.0, 0.0]
    for i, v in enumerate(map(verdicts.__getitem__, words)):
        if v is not None:
            sums[2 if _quoted(words, i) else int(v[1])] += v[0]
    return tuple(np.log1p(sums).tolist())


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (bias, plain, misspelled, quoted), drawn to a prior where the sample says little."""
    prior = np.array([-3.0, 8.0, 4.0, 2.0])
    if not len(y):
        return prior
    w, x = prior.copy(), np.c_[np.ones(len(x)), x]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - (w - prior) / 9
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(4) / 9
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def _signature(words: set[str]) -> int:
    """Equal for most copies and near copies of a text: two of its least word hashes."""
    from zlib import crc32

    h = [crc32(w.encode()) for w in words]
    return hash((min(h), min(x * 2654435761 % 2**32 for x in h))) if h else 0


def _low(t: str, n: str):  # noqa: ANN202
    """Lower bound of the share t / n (Wilson's interval at 95 %)."""
    share, n, z2 = F.col(t) / F.col(n), F.col(n), 1.96**2
    return (share + z2 / (2 * n) - 1.96 * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from at most ``limit`` labelled rows whose crc32(doc_id) modulo 5 isn't 0.

    Rows without an id or a label teach nothing; without labelled rows the lexicon
    is empty and the weights are the prior's, so that no text is called toxic.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, limit, lambda i: crc32_mod(i, 5) != 0)
    sample = scratch.keep(sample.select(F.col("text").cast("binary").alias("text"), "y"), "sample")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, y, terms = [], [], []
            for x, label in zip(b.column(0), b.column(1)):
                words = {plain(t)[0] for t in set((x.as_py() or b"").lower().split())} - {""}
                sig.append(_signature(words))
                y.append(label.as_py())
                terms.append([*words, *{f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}])
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(y, pa.int32()), pa.array(terms, pa.list_(pa.string()))], names=["sig", "y", "terms"])

    told = sample.mapInArrow(words_of, "sig long, y int, terms array<string>")
    told = told.groupBy("sig", "y").agg(F.max_by("terms", F.size("terms")).alias("terms"))
    told = scratch.keep(told.withColumn("id", F.monotonically_increasing_id()), "texts")
    counts = told.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("t"), F.count(F.lit(1)).alias("n"))
    counts = scratch.keep(counts, "terms")
    sure = scratch.keep(counts.where("t >= 4").withColumn("low", _low("t", "n")).where(F.col("low") >= SURE).select("term", "low"), "sure")
    strong = sure.where(F.col("low") >= VERY_SURE)
    weak = sure.where(F.col("low") < VERY_SURE)
    if not weak.isEmpty() and not strong.isEmpty():
        each = told.select("id", "y", F.explode("terms").alias("term"))
        explained = each.join(scratch.sized(strong.select("term")), "term", "left_semi").select("id").distinct()
        rest = each.join(scratch.sized(weak.select("term")), "term", "left_semi").join(scratch.sized(scratch.keep(explained, "explained")), "id", "left_anti")
        rest = rest.groupBy("term").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).where("t >= 3").where(_low("t", "n") >= SURE - 0.2)
        sure = strong.union(weak.join(scratch.keep(rest.select("term"), "helpful"), "term", "left_semi"))
    found = {r["term"]: float(r["low"]) for r in sure.orderBy(F.desc("low"), "term").collect()}
    terms = {t: low for t, low in found.items() if not t.endswith("*")}
    stems = {t[:-1]: low for t, low in found.items() if t.endswith("*")}
    lexicon = Lexicon(terms, stems)

    # words of harmless texts that a misspelling could be taken for
    sent = spark.sparkContext.broadcast(lexicon)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [w for w in b.column(0).to_pylist() if (v := sent.value.verdict(w.encode())) and v[1]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["term"])

    clean = counts.where("t < n and right(term, 1) <> '*'").select("term").mapInArrow(neighbours, "term string")
    lexicon = Lexicon(terms, stems, frozenset(r["term"] for r in clean.collect()))
    told = _evidence(sample, lexicon).toArrow()
    order = np.lexsort([np.array(told[c].to_pylist(), float) for c in ("a", "b", "c", "y")])
    x = np.array([told[c].to_pylist() for c in ("a", "b", "c")], float).reshape(3, -1).T[order]
    return lexicon, fit_weights(x, np.array(told["y"].to_pylist(), float)[order])


def _evidence(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` with their binary ``text`` replaced by a, b, c: the evidence."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)
    others = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*(rows.schema[c] for c in others), *(T.StructField(c, T.DoubleType()) for c in ("a", "b", "c"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = Verdicts(sent.value)
        for b in batches:
            found = [evidence(verdicts, x.as_py()) for x in b.column(len(others))]
            cols = [pa.array([f[k] for f in found], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)

    return rows.select(*others, "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray]) -> DataFrame:
    """doc_id and a ``score`` from 0 to 1 for each row of ``docs`` (doc_id, text); null counts as empty.

    A text without hits, so also an empty one, gets the score of the bias alone.
    Every row is scored by itself: repeated rows have equal scores, null ids stay
    null, and an empty table gives an empty result. Other columns of ``docs`` are
    neither read nor returned, whatever their names.
    """
    lexicon, w = model
    rows = _evidence(scratch.spread(docs.select("doc_id", "text")).select("doc_id", F.col("text").cast("binary").alias("text")), lexicon)
    z = F.lit(float(w[0])) + sum(F.col(c) * float(v) for c, v in zip(("a", "b", "c"), w[1:]))
    return rows.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).alias("score"))
