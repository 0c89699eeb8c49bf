"""Removal of repeated byte strings, by prefix-free parsing and suffix order.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier,
in a row with a smaller id or further ahead in its own.

**Parsing.** A rolling hash runs over every text. The trigger of a window of ``length``
bytes is the place of its least hash among the first ``SPAN`` places (the first of
equals), so it depends on the window's own bytes alone and every window has one.
Windows in a row that share a trigger form a phrase; equal windows lie at the same
distance before their triggers. A trigger's context is the ``length - SPAN + 1`` bytes
that all of its windows hold, a phrase's reach all bytes of its windows.

**Dictionary.** Triggers are dealt out by their context and sorted by phrase (two
64-bit hashes of the reach) and place. Of a phrase that occurs again every later
occurrence is removed whole. What is left is the dictionary: each distinct phrase once,
at its first place. A phrase whose context has no other phrase holds no repeated window.

**Suffix order.** Phrases that share a context are compared by their bytes. The order of
the phrases' suffixes (read backward from the trigger) and the order of what follows
the trigger, each with the common prefixes of neighbours, together give for every
distance the classes of equal windows; all but the first of a class are removed.
That is done for slices of bounded size. A context of more phrases than a slice holds
has its windows dealt out by two hashes instead, so no task meets an unbounded group.

Memory is bounded by ``PIECE`` bytes of texts, a slice, and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm import scratch

LENGTH = 100
#: Bytes under the rolling hash, and most places a trigger lies behind the start of its window.
HASHED = 8
SPAN = 64
#: Bytes of texts that are parsed together, and most phrases of one context, or of a slice, that are compared together.
PIECE = 1 << 20
SLICE = 4096

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[base][0][:n], _powers[base][1][:n]


class Rolling:
    """Hashes of any substrings of a buffer, by differences of running sums."""

    def __init__(self, buffer: np.ndarray, base: int):
        up, self.down = _powers_of(base, len(buffer))
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def span_of(length: int) -> int:
    if length < HASHED:
        raise ValueError(f"strings of {length} bytes are too short to be parsed, the least is {HASHED}")
    return min(SPAN, length - HASHED + 1)


def triggers(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling | None]:
    """First and last window of each phrase, and its trigger, of the texts at ``starts``..``ends`` in a buffer."""
    span = span_of(length)
    none = np.zeros(0, np.int64)
    if len(buffer) < length:
        return none, none, none, None
    hashes = Rolling(buffer, _BASES[0])
    at = np.arange(len(buffer) - HASHED + 1)
    key = (hashes(at, at + HASHED) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # equal hashes: the first place
    done = 1
    while done < span:
        step = min(done, span - done)
        key = np.minimum(key[:-step], key[step:])
        done += step
    trigger = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(buffer) + 1, np.int64)
    whole = ends - starts >= length
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(trigger)])
    if not len(windows):
        return none, none, none, None
    trigger = trigger[windows]
    cut = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(windows) != 1)) + 1
    first = np.concatenate([[0], cut])
    return windows[first], windows[np.concatenate([cut - 1, [len(windows) - 1]])], trigger[first], hashes


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about ``PIECE`` bytes with the starts, ends, ids and offsets of the texts, or parts of them, inside.

    Long texts are cut; a part takes ``length - 1`` bytes of the next one along, so that
    every window lies in one part.
    """
    held: list[bytes] = []
    about: list[tuple[int, int]] = []
    size = 0

    def told():  # noqa: ANN202
        sizes = np.array([len(x) for x in held], np.int64)
        ends = np.cumsum(sizes)
        ids, offsets = np.array(about, np.int64).reshape(-1, 2).T
        return np.frombuffer(b"".join(held), np.uint8), ends - sizes, ends, ids, offsets

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = text.as_py() or b""
            for k in range(0, max(1, len(raw) - length + 1), PIECE):
                part = raw[k : k + PIECE + length - 1] if len(raw) > PIECE else raw
                if len(part) < length:
                    continue
                if size + len(part) > PIECE and held:
                    yield told()
                    held.clear()
                    about.clear()
                    size = 0
                held.append(part)
                about.append((doc, k))
                size += len(part)
    if held:
        yield told()


def _parsed(rows: DataFrame, length: int) -> DataFrame:
    """(context, phrase, more, key, at, back): a row a phrase of every text, but of equal ones within a piece.

    ``at`` is the trigger's place, ``back`` the mask of the distances from the phrase's
    windows to it. Phrases that a piece met before need no comparison: they have a null
    ``phrase`` and a ``context`` that only deals them out.
    """
    core = length - span_of(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer, starts, ends, ids, offsets in _pieces(batches, length):
            first, last, at, hashes = triggers(buffer, starts, ends, length)
            if hashes is None:
                continue
            text = np.searchsorted(starts, first, "right") - 1
            context, phrase = hashes(at, at + core), hashes(first, last + length)
            more = Rolling(buffer, _BASES[1])(first, last + length)
            key, place = ids[text], offsets[text] + at - starts[text]
            order = np.lexsort((place, key, more, phrase, context))
            same = np.zeros(len(order), bool)
            a, b = order[1:], order[:-1]
            same[a] = (context[a] == context[b]) & (phrase[a] == phrase[b]) & (more[a] == more[b])
            context[same] = (key[same].astype(np.uint64) * np.uint64(_BASES[0])) ^ place[same].astype(np.uint64)
            cols = [
                pa.array(context.view(np.int64)),
                pa.array(phrase.view(np.int64), mask=same),
                pa.array(more.view(np.int64), mask=same),
                pa.array(key),
                pa.array(place.astype(np.int32)),
                pa.array(_between(at - last, at - first).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["context", "phrase", "more", "key", "at", "back"])

    return rows.mapInArrow(run, "context long, phrase long, more long, key long, at int, back long")


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Masks with the bits low..high set."""
    full = np.uint64(2**64 - 1)
    return (full << low.astype(np.uint64)) & (full >> (np.uint64(63) - high.astype(np.uint64)))


def _sorted_classes(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common prefix of each row, in order, with the one before."""
    wide = np.zeros((len(texts), -(-texts.shape[1] // 8) * 8), np.uint8)
    wide[:, : texts.shape[1]] = texts
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort(tuple(words[:, k] for k in range(words.shape[1] - 1, -1, -1)))
    common = np.zeros(len(texts), np.int64)
    differs = texts[order[1:]] != texts[order[:-1]]
    common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), texts.shape[1])
    return order, common


def repeated_windows(behind: np.ndarray, ahead: np.ndarray, back: np.ndarray, age: np.ndarray, length: int) -> np.ndarray:
    """Masks of the windows, by distance to the trigger, that an older phrase of the slice holds too.

    ``behind``: [n, span - 1] bytes before each trigger, the nearest first; ``ahead``:
    [n, length] bytes from it on; ``back``: the distances at which the phrase has windows.
    """
    n, span = len(age), span_of(length)
    suffixes, parse = _sorted_classes(behind), _sorted_classes(ahead)
    out = np.zeros(n, np.uint64)
    by_age = np.argsort(age, kind="stable")
    for d in range(span):
        mine = by_age[(back[by_age] >> np.uint64(d)) & np.uint64(1) == 1]
        if len(mine) < 2:
            continue
        pair = np.zeros(n, np.int64)
        for (order, common), depth in ((suffixes, d), (parse, length - d)):
            names = np.empty(n, np.int64)
            names[order] = np.cumsum(common < depth)
            pair = pair * (n + 1) + names
        again = np.ones(len(mine), bool)
        again[np.unique(pair[mine], return_index=True)[1]] = False
        out[mine[again]] |= np.uint64(1 << d)
    return out


def _reach(raw: bytes, at: int, back: int, length: int) -> tuple[bytes, bytes]:
    """Bytes before and from a trigger on that the windows of its phrase hold."""
    low, high = (back & -back).bit_length() - 1, back.bit_length() - 1
    return raw[at - high : at], raw[at : at - low + length]


def _cut(found: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """``found`` (context, key, at, back) with the bytes behind and ahead of every trigger."""
    need = found.groupBy("key").agg(F.collect_list(F.struct("context", "at", "back")).alias("need"))
    texts = rows.join(need, "key").select("key", "text", "need")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for key, text, need in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = text.as_py()
                for x in need.as_py():
                    sides = _reach(raw, x["at"], x["back"] % 2**64, length)
                    for col, value in zip(cols, (x["context"], key, x["at"], x["back"], *sides)):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CUT)], names=_CUT_NAMES)

    return texts.mapInArrow(run, "context long, key long, at int, back long, behind binary, ahead binary")


_CUT = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
_CUT_NAMES = ["context", "key", "at", "back", "behind", "ahead"]


def _compared(cut: DataFrame, length: int) -> DataFrame:
    """(key, at, mask) of phrases with windows that an older phrase of the same context has; whole contexts in a task."""
    span = span_of(length)
    dealt = cut.repartition("context").sortWithinPartitions("context")

    def matrix(texts: list[bytes], width: int, backward: bool) -> np.ndarray:
        return np.frombuffer(b"".join((x[::-1] if backward else x)[:width].ljust(width, b"\0") for x in texts), np.uint8).reshape(len(texts), width)

    def told(held: pa.Table) -> pa.RecordBatch:
        key, at = held.column("key").to_numpy(), held.column("at").to_numpy()
        age = np.empty(len(key), np.int64)
        age[np.lexsort((at, key))] = np.arange(len(key))
        behind = matrix(held.column("behind").to_pylist(), max(1, span - 1), True)
        ahead = matrix(held.column("ahead").to_pylist(), length, False)
        mask = repeated_windows(behind, ahead, held.column("back").to_numpy().view(np.uint64), age, length)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(at), pa.array(mask.view(np.int64))], names=["key", "at", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < 2 * SLICE:
                continue
            t = pa.Table.from_batches(held)
            context = t.column(0).to_numpy()
            end = int(np.searchsorted(context, context[-1]))  # the last context may go on
            if end:
                yield told(t.slice(0, end))
            held = t.slice(end).to_batches()
            rows = len(context) - end
        if rows:
            yield told(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "key long, at int, mask long")


def _windows(cut: DataFrame, length: int) -> DataFrame:
    """(h, more, key, at, start): every window of the phrases, by two hashes, the first of equal ones within a batch of them alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [p + q for p, q in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            if not texts:
                continue
            sizes = np.array([len(x) for x in texts], np.int64)
            begin = np.cumsum(sizes) - sizes
            buffer = np.frombuffer(b"".join(texts), np.uint8)
            count = sizes - length + 1
            row = np.repeat(np.arange(len(texts)), count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            first = begin[row] + within
            at = b.column(2).to_numpy()[row]
            ahead = np.array([len(p) for p in b.column(4).to_pylist()], np.int64)[row]
            cols = [Rolling(buffer, base)(first, first + length).view(np.int64) for base in _BASES]
            cols += [b.column(1).to_numpy()[row], at, (at - ahead + within).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "more", "key", "at", "start"])

    return cut.mapInArrow(run, "h long, more long, key long, at int, start int")


def _hashed(cut: DataFrame, length: int) -> DataFrame:
    """(key, at, mask) as ``_compared`` gives it, for contexts of any number of phrases: windows meet by their hashes."""
    windows = scratch.keep(_windows(cut, length), "windows")
    first = windows.groupBy("h", "more").agg(F.min(F.struct("key", "start")).alias("f")).select("f.key", "f.start")
    again = windows.join(first, ["key", "start"], "left_anti")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") - F.col("start"))
    return again.groupBy("key", "at").agg(F.bit_or(bit).alias("mask"))


def repeated(rows: DataFrame, length: int = LENGTH, slices: int = SLICE) -> DataFrame:
    """Stored (key, at, mask): for each phrase with repeated windows, the distances from these to the trigger at byte ``at``.

    ``rows``: a unique long ``key``, in the order that counts, and binary ``text``.
    """
    by_context = Window.partitionBy("context")
    parsed = _parsed(rows, length).withColumn("before", F.lag(F.struct("phrase", "more")).over(by_context.orderBy("phrase", "more", "key", "at")))
    known = F.col("phrase").isNull()
    again = known | ((F.col("before.phrase") == F.col("phrase")) & (F.col("before.more") == F.col("more")))
    parsed = parsed.withColumn("again", F.coalesce(again, F.lit(False)))
    phrases = F.sum(F.when(F.col("again"), 0).otherwise(1)).over(by_context)
    parsed = parsed.withColumn("phrases", phrases).where("again or phrases > 1")
    found = scratch.keep(parsed.select("context", "key", "at", "back", "again", "phrases"), "phrases")
    mixed = found.where("not again")
    cut = scratch.keep(_cut(mixed.select("context", "key", "at", "back"), rows, length), "cut")
    large = scratch.keep(mixed.where(F.col("phrases") > slices).select("context").distinct(), "large")
    out = found.where("again").select("key", "at", F.col("back").alias("mask"))
    if large.isEmpty():
        return scratch.keep(out.unionByName(_compared(cut, length)).where("mask <> 0"), "repeated")
    hot = scratch.sized(large)
    out = out.unionByName(_compared(cut.join(hot, "context", "left_anti"), length)).unionByName(_hashed(cut.join(hot, "context", "left_semi"), length))
    return scratch.keep(out.where("mask <> 0"), "repeated")


def spans_of(size: int, at: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """[k, 2] start and end of the maximal runs of bytes that the windows of the masks cover, of a text of ``size`` bytes."""
    row, distance = np.nonzero((mask[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1))
    start = at[row] - distance
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    inside = np.cumsum(edge[:size]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return turn.reshape(-1, 2)


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``key``, id and binary ``text`` of every row; keys are unique and ascend with the ids.

    Ids that are unique and not null are their own keys. Otherwise rows are numbered by
    id (null ids last), and rows of one id in a stable order of their texts' hashes.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    ids = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if dict(rows.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint") and ids.isEmpty():
        return rows.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text")
    by = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    return scratch.keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("key", F.monotonically_increasing_id()), "numbered")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, n_bytes, spans (array of removed start, end) and kept (binary, the other bytes).

    Null texts are empty and nothing is removed of texts shorter than ``length``. Rows that
    repeat an id are texts of their own, of which the one with the lower hash counts as
    earlier (equal texts: either); null ids come after all others. Cuts may fall inside a
    character, so what is kept is bytes. An empty table gives an empty result.
    """
    rows = numbered(scratch.spread(docs.select(doc_id, text)), doc_id, text)
    found = repeated(rows.select("key", "text"), length).groupBy("key").agg(F.collect_list(F.struct("at", "mask")).alias("found"))
    joined = rows.join(found, "key", "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(b.column(1), b.column(2)):
                raw, cut = text.as_py(), np.zeros((0, 2), np.int64)
                if found.is_valid:
                    at, mask = (found.values.field(k).to_numpy() for k in (0, 1))
                    cut = spans_of(len(raw), at.astype(np.int64), mask.view(np.uint64), length)
                ends = [0, *cut.ravel().tolist(), len(raw)]
                sizes.append(len(raw))
                spans.append([{"start": s, "end": e} for s, e in cut.tolist()])
                kept.append(b"".join(raw[i:j] for i, j in zip(ends[::2], ends[1::2])))
            cols = [b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "spans", "kept"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
