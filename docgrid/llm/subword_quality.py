"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of learned vectors of the word itself and of its
character n-grams, hashed to a fixed number of buckets; that of two adjacent words
is the learned vector of their pair, hashed likewise, with a word behind itself
the mean of it and of a vector that all such pairs share. A document's vector is
the mean over its words and pairs. A softmax over two classes gives the score. Vectors and output
weights are learned together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows. Because everything before the softmax is
linear, a trained model is one number per bucket, broadcast to the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm import scratch
from docgrid.llm.sampling import labelled_sample
from docgrid.llm.text import crc32_mod, free_name

BUCKETS = 1 << 16
DIM = 8
EPOCHS = 6
#: Steps that a small sample is learnt for at least, in more epochs.
LEAST_STEPS = 3_000
RATE = 0.4
NGRAMS = (3, 4)
#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 3_000
#: Words whose value a worker remembers before it starts anew.
MEMORY = 400_000
#: Longest word that a worker remembers, and characters of a longer one whose n-grams are taken at once.
REMEMBERED = 100
SPAN = 10_000

REPEAT, EMPTY = 0, 1  # buckets of a word behind itself and of a text without words


def features(word: bytes) -> list[int]:
    """Buckets of a word and its character n-grams, its borders marked."""
    return [i for part in _features(word) for i in part]


def _features(word: bytes) -> Iterator[list[int]]:
    """The same in parts: those of the n-grams that begin in ``SPAN`` characters."""
    out = [crc32(word)]
    if word.isascii():
        raw = b"<" + word + b">"
        for k in range(0, len(raw), SPAN):
            out += [crc32(raw[i : i + n], n) for n in NGRAMS for i in range(k, min(k + SPAN, len(raw) - n + 1))]
            yield [2 + h % (BUCKETS - 2) for h in out]
            out = []
    else:
        text = f"<{word.decode('utf-8', 'replace')}>"
        for k in range(0, len(text), SPAN):
            out += [crc32(text[i : i + n].encode(), n) for n in NGRAMS for i in range(k, min(k + SPAN, len(text) - n + 1))]
            yield [2 + h % (BUCKETS - 2) for h in out]
            out = []


def _counted(word: bytes) -> tuple[list[int], list[int]]:
    """Distinct buckets of a long word and how often each occurs; at most ``BUCKETS`` whatever its length."""
    held = np.zeros(BUCKETS, np.int64)
    for part in _features(word):
        held += np.bincount(part, minlength=BUCKETS)
    at = np.flatnonzero(held)
    return at.tolist(), held[at].tolist()


def pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs of adjacent words, and which of them are a word behind itself."""
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    mixed = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) & np.uint64(0xFFFFFFFF)
    return (2 + mixed % np.uint64(BUCKETS - 2)).astype(np.int64), h[:-1] == h[1:]


class Features(dict):
    """Buckets of a word of bounded length, worked out when first asked for."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= MEMORY // 4:
            self.clear()
        f = self[word] = features(word)
        return f


def bag(text: bytes, known: Features | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights in its mean vector."""
    words = text.split()
    known = Features() if known is None else known
    if not words:
        return np.array([EMPTY], np.int32), np.ones(1, np.float32)
    two, again = pairs(words)
    held = np.bincount(two, np.where(again, 0.5, 1.0), BUCKETS).astype(float)  # counts, where there are no pairs
    held[REPEAT] += again.sum() / 2
    at: list[int] = []
    times: list[float] = []
    sizes: list[int] = []
    for w, n in Counter(words).items():
        if len(w) > REMEMBERED:
            f, often = _counted(w)
            held[f] += n * np.array(often) / sum(often)
            continue
        f = known[w]
        at += f
        times.append(n / len(f))
        sizes.append(len(f))
    held += np.bincount(np.array(at, np.int64), np.repeat(np.array(times, float), np.array(sizes, np.int64)), BUCKETS)
    held /= 2 * len(words) - 1
    ids = np.flatnonzero(held)
    return ids.astype(np.int32), held[ids].astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """(value of each bucket, bias): the log odds of label 1 of a mean vector."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    ones = max(1, int(y.sum()))
    weigh = np.sqrt(np.array([len(y) / 2 / max(1, len(y) - ones), len(y) / 2 / ones]))  # the rarer class counts somewhat more
    epochs = max(EPOCHS, LEAST_STEPS // max(1, len(y)))
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share = bags[k]
            hidden = share @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= min(weigh[y[k]], 3.0)
            back = out @ p
            out -= rate * np.outer(hidden, p).astype(np.float32)
            bias -= rate * 0.1 * p.astype(np.float32)
            # a bucket's step is scaled up for its small share, as if each occurrence were a step of its own
            vectors[ids] -= (rate * np.minimum(share * 40, 1))[:, None] * back[None, :].astype(np.float32)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Train on at most ``limit`` labelled rows whose crc32(doc_id) modulo 3 isn't 1.

    Without labelled rows every text scores one half.
    """
    sample = labelled_sample(docs, labels, label, limit, lambda i: crc32_mod(i, 3) != 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                bags = [bag(x.as_py() or b"", known) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i].tobytes() for x in bags]) for i in (0, 1)), part.column(1)], names=["ids", "share", "y"])

    rows = sample.select(F.col("text").cast("binary"), "y").mapInArrow(run, "ids binary, share binary, y int").toArrow()
    if not rows.num_rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    raw = sorted(zip(rows["ids"].to_pylist(), rows["share"].to_pylist(), rows["y"].to_pylist()))
    bags = [(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for i, s, _ in raw]
    return train(bags, np.array([y for _, _, y in raw]))


class Values(dict):
    """A word's mean bucket value, worked out when first asked for."""

    def __init__(self, buckets: np.ndarray):
        super().__init__()
        self.array = buckets.astype(float)
        self.buckets = self.array.tolist()

    def __missing__(self, word: bytes) -> float:
        if len(word) > REMEMBERED:
            n, total, b = 0, 0.0, self.buckets
            for part in _features(word):
                n += len(part)
                total += sum([b[i] for i in part])
            return total / n
        if len(self) >= MEMORY:
            self.clear()
        f = features(word)
        b = self.buckets
        v = self[word] = sum([b[i] for i in f]) / len(f)
        return v


def log_odds(values: Values, bias: float, text: bytes) -> float:
    words = text.split()
    if not words:
        return bias + values.buckets[EMPTY]
    two, again = pairs(words)
    of_pairs = values.array[two]
    of_pairs[again] = (of_pairs[again] + values.buckets[REPEAT]) / 2
    return bias + (sum(map(values.__getitem__, words)) + float(of_pairs.sum())) / (2 * len(words) - 1)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double ``name`` from 0 to 1: how likely label 1 is.

    A null text counts as empty and has the score of an empty one; equal texts
    have equal scores. A column that has the name already is replaced; all others
    stay as they are. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != name), T.StructField(name, T.DoubleType())])
    kept = [c for c in docs.columns if c != name]
    columns = [docs[f"`{c}`"] for c in kept]
    if text in kept and isinstance(docs.schema[text].dataType, (T.StringType, T.BinaryType)):
        at = kept.index(text)  # sent to the workers once, and not as bytes beside it
    else:
        at = len(kept)
        columns.append(F.col(text).cast("binary").alias(free_name("text", docs)))
    rows = scratch.spread(docs.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, bias = sent.value
        values = Values(buckets)
        for b in scratch.released(batches):
            z = np.array([log_odds(values, bias, x.as_py() or b"") for x in b.column(at).cast(pa.binary())])
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(p, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)
