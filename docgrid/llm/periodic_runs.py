"""Runs of periodic text, found on a harmonic grid of longest common extensions.

A text is its sequence of words. A stretch of period p and at least four periods
holds four neighbouring points of the grid 0, p, 2p, ...; for every pair of
neighbouring points whose words agree so, the longest common extensions forward
and backward give the stretch in full. The extensions come from a suffix array
of the words, another of the reversed words, and range minima over their common
prefixes. All grids together have n log n points; each point is asked for once, in
numpy, and a stretch is told at its first point alone. A stretch of more than one
period is named by the smallest, which is asked first.

Texts are worked on one at a time: memory is that of n log n numbers for the longest
text with a periodic stretch, and that of a few grids for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST = 6
TIMES = 4
#: Pairs of grid points that are extended at once.
STEP = 1 << 18

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Extensions:
    """Longest common extensions of any two places of a sequence of small integers."""

    def __init__(self, names: np.ndarray):
        n = len(names)
        rank, levels, width = np.unique(names, return_inverse=True)[1].astype(np.int64), [], 1
        while True:
            levels.append(rank.astype(np.int32))
            if width >= n or rank.max() == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            pair = rank * (n + 1) + after
            order = np.argsort(pair, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
            width *= 2
        self.n, self.rank = n, rank
        array = np.empty(n, np.int64)
        array[rank] = np.arange(n)
        a, b = array[:-1].copy(), array[1:].copy()
        low = np.zeros(n - 1, np.int32)
        for k in range(len(levels) - 1, -1, -1):  # ranks of 2^k words are equal exactly if these words are, or both end
            fits = np.maximum(a, b) + (1 << k) <= n
            same = np.zeros(n - 1, bool)
            same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
            low[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        self.minima = [low]
        while 2 << (len(self.minima) - 1) <= n - 1:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from ``i`` and ``j`` (different) on; places past the end agree in none."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero(np.maximum(i, j) < self.n)
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.minima[k]
            out[inside[at]] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out


def _grid(names: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of all grids from which ``times`` neighbours on have the same word, with their periods."""
    points, periods = [], []
    for p in range(1, len(names) // times + 1):
        words = names[::p]
        same = words[1:] == words[:-1]
        chain = same[: len(same) - times + 2]
        for k in range(1, times - 1):
            chain = chain & same[k : len(same) - times + 2 + k]
        if chain.any():
            at = np.flatnonzero(chain) * p
            points.append(at)
            periods.append(np.full(len(at), p, np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *points]), np.concatenate([none, *periods])


def word_runs(words: list, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """[k, 3] start, length and smallest period of every run of a list of words, by start, then period.

    A run has at least ``least`` words and ``times`` (two or more) periods.
    """
    none = np.zeros((0, 3), np.int64)
    n = len(words)
    if n < max(least, times):
        return none
    known: dict = {}
    names = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    point, period = _grid(names, times)
    if not len(point):
        return none
    forward, backward = Extensions(names), Extensions(names[::-1])
    found = []
    for k in range(0, len(point), STEP):
        i, p = point[k : k + STEP], period[k : k + STEP]
        ahead = forward(i, i + p)
        back = backward(n - i, n - i - p)
        good = (back < p) & (ahead + back + p >= np.maximum(least, times * p))
        found.append(np.stack([(i - back)[good], (ahead + back + p)[good], p[good]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: it's in no run, or in the first period of all that hold it."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def find_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns ``keep`` of every row, with n_words, runs and collapsed.

    Words are what stands between ASCII white space. ``runs`` has start (a word's
    number), length and smallest period of every run, by start, then period;
    ``collapsed`` is the text without the words that repeat a run's first period,
    words joined by one space. Null and empty texts have no words and no runs. Rows
    are independent: repeated rows, null ids and ties are answered row by row, and
    an empty table stays empty. ``keep`` must not name n_words, runs or collapsed.
    """
    made = {"n_words", "runs", "collapsed"}
    if clash := [c for c in keep if c.lower() in made]:
        raise ValueError(f"columns {clash} would stand twice in the result")
    rows = docs.select(*keep, F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, texts = [], [], []
            for x in b.column(b.num_columns - 1):
                words = (x.as_py() or b"").split()
                got = word_runs(words, least, times)
                stay = kept_words(len(words), got) if len(got) else None
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in got.tolist()])
                texts.append(b" ".join(words if stay is None else [w for w, s in zip(words, stay.tolist()) if s]))
            made = [pa.array(sizes, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "n_words", "runs", "collapsed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{fields}, n_words long, runs {RUNS}, collapsed string")


def plant(text: Column, doc_id: Column) -> Column:
    """Text in which, for a tenth of the ids, the words from one on repeat a few times.

    With h the unsigned crc32 of the decimal id and g = h // 10: where h % 10 is 0 and
    there are n > 0 words, every word i from a = g % n on is word a + (i - a) % p,
    p = 1 + (n - a) // (3 + g % 8). Other texts stay as they are. A null id counts as
    empty text.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    period = F.slice(words, a + 1, p)
    repeated = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
    told = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), repeated), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & (n > 0), told).otherwise(text)
