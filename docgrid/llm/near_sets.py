"""Near duplicates by the Jaccard similarity of word shingles, checked exactly.

A text is the set of its shingles of five words, and what links two texts is the
exact similarity of these sets. Pairs to check come from ``simhash`` first: every text
with the first of its group there, by SimHash fingerprints and BK-trees. A radius of few
bits reaches a part of the texts that are alike, so MinHash bands propose what else may
be: ``BANDS`` keys of ``BAND`` minima each, so that a pair of similarity 0.8
shares no key with a probability of (1 - 0.8^4)^20 = 0.00003. Two passes check
these: first every text with the
first of each of its buckets, which joins a large group without all its pairs;
then texts of one bucket that are still in different groups. Of the
second only pairs go to the exact check whose sizes allow the similarity and
whose minima agree often enough. Pairs of texts that are not quite alike grow with the
square of a bucket, so they never leave the task that compares them: it gets the texts
too, checks the pairs, those that agree most first, and gives the links by which
groups become one. Buckets of many texts are parted before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm import scratch, simhash
from docgrid.llm.components import components
from docgrid.llm.scratch import ROW

SHINGLE = 5
LEAST = 0.8
BANDS = 20
BAND = 4
SEED = 42
#: Minima of which a byte each makes a text's sketch; the first BANDS * BAND of them make the bands too.
MINIMA = 512
#: Agreeing bytes, of those of the bands and of all, that a pair needs for an exact check: 4.5 deviations below those expected at LEAST.
ROUGH = 48
AGREE = 369
#: Shingles whose minima are taken at once, and pairs that a step of a bucket compares.
STEP = 512
STEP_PAIRS = 100_000
STEP_AGREE = 8192
#: Texts of a bucket that are compared together, blocks of so many into which larger ones are dealt, and
#: rounds in which those of more blocks are parted.
HOT = 4096
PART = 64
ROUNDS = 2
#: Shingles in the cells whose texts are compared exactly; larger cells are dealt out in blocks.
WEIGHT = 2 << 20
#: Texts, and bytes of texts, in a block of those whose pairs are checked.
CELL = 256
CELL_BYTES = 16 << 20

_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(start, end[shingle - 1 :].tolist())), np.uint64, n))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the permutations; all ones for an empty set."""
    low = np.full(len(_TIMES), 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), STEP):
        part = hashes[k : k + STEP]
        low = np.minimum(low, (part[None, :] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1))
    return low


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes; two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(rows: DataFrame, text: str) -> DataFrame:
    """(ROW, size, sketch, keys): number of shingles, a byte of each minimum and the keys as bytes behind them, and the keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.released(batches):
            sizes, sketches, keys = [], [], []
            for x in b.column(1):
                hashes = shingles(x.as_py())
                low = minima(hashes)
                sizes.append(len(hashes))
                raw = low.tobytes()
                own = [xxhash.xxh64_intdigest(raw[8 * BAND * k : 8 * BAND * (k + 1)], k) for k in range(BANDS)]
                sketches.append(((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes() + np.array(own, np.uint64).tobytes())
                keys += own
            lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), pa.array(np.array(keys, np.uint64).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), lists], names=[ROW, "size", "sketch", "keys"])

    return rows.select(ROW, F.col(text).cast("binary")).mapInArrow(run, f"{ROW} long, size int, sketch binary, keys array<long>")


def _alike(pairs: DataFrame, rows: DataFrame, text: str, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b: rows) whose sets are at least so similar.

    Rows are dealt into blocks of about ``CELL`` texts and ``CELL_BYTES``; the pairs
    of two blocks form a cell, which gets each text of its pairs once. So a text
    moves once for each block that it has pairs with, and not once for each pair.
    """
    used = scratch.keep(pairs.select(F.col("a").alias(ROW)).union(pairs.select("b")).distinct(), "used")
    texts = rows.join(scratch.sized(used), ROW, "left_semi").select(ROW, F.col(text).cast("binary").alias("t"))
    n, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first()
    blocks = 1 + max(n // CELL, (size or 0) // CELL_BYTES)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    placed = pairs.select(block("a").alias("p"), block("b").alias("q"), "a", "b")
    needed = placed.select("p", "q", F.col("a").alias(ROW)).union(placed.select("p", "q", "b")).distinct()
    sides = needed.join(texts, ROW).select("p", "q", F.col(ROW).alias("a"), F.lit(None).cast("long").alias("b"), "t")
    cells = sides.union(placed.select("p", "q", "a", "b", F.lit(None).cast("binary")))
    cells = cells.repartition("p", "q").sortWithinPartitions("p", "q", F.col("b").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in scratch.released(batches):
            good = np.zeros(batch.num_rows, bool)
            for i, (p, q, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                if (p, q) != cell:  # a cell's texts come before its pairs
                    cell, held = (p, q), {}
                if b is None:
                    held[a] = shingles(batch.column(4)[i].as_py())
                else:
                    good[i] = similarity(held[a], held[b]) >= least - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3)], names=["a", "b"]).filter(pa.array(good))

    return cells.mapInArrow(run, "a long, b long")


def _agreement(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bytes the sketches of each pair of rows agree."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), STEP_AGREE):
        part = slice(k, k + STEP_AGREE)
        out[part] = (sketch[i[part]] == sketch[j[part]]).sum(axis=1)
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one key after the other; the batches are sorted by their first column, the key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for i, j in zip(cuts, cuts[1:]):
            if held and i < j and held[-1].column(0)[0].as_py() != key[i]:
                yield pa.Table.from_batches(held)
                held = []
            if i < j:
                held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(t: pa.Table, label: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, agreeing bytes) of rows of one cell in different groups that may be alike, in steps; ``label`` may change between these.

    ``t``: key, ROW, label, size, sketch, about twice ``HOT`` rows at most. Rows that meet in several buckets are told by the first.
    """
    if len(label) < 2 or (label == label[0]).all():
        return
    size = t.column(3).to_numpy()
    made = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(len(label), -1)
    sketch, rough = np.ascontiguousarray(made[:, :MINIMA]), np.ascontiguousarray(made[:, : BANDS * BAND])
    keys = np.ascontiguousarray(made[:, MINIMA:]).view(np.int64)
    band = np.flatnonzero(keys[0] == t.column(0)[0].as_py())  # none in a part or cell of a bucket
    step = max(1, STEP_PAIRS // len(label))
    for k in range(0, len(label), step):
        left, right = slice(k, k + step), slice(k, None)
        may = label[left][:, None] != label[right][None, :]
        may &= np.minimum(size[left][:, None], size[right][None, :]) >= least * np.maximum(size[left][:, None], size[right][None, :]) - 1e-9
        i, j = np.nonzero(np.triu(may, 1))
        i, j = i + k, j + k
        near = _agreement(rough, i, j) >= ROUGH
        i, j = i[near], j[near]
        agree = _agreement(sketch, i, j)
        near = agree >= AGREE
        if len(band):
            near &= ~(keys[i, : band[0]] == keys[j, : band[0]]).any(axis=1)
        if near.any():
            yield i[near], j[near], agree[near]


def _by_key(entries: DataFrame, *more: str) -> DataFrame:
    return entries.select("key", ROW, "label", "size", "sketch", *more).repartition("key").sortWithinPartitions("key")


def _compared(entries: DataFrame, least: float) -> DataFrame:
    """(a, b): all rows of one cell in different groups that may be alike; ``entries``: key, ROW, label, size, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(scratch.released(batches)):
            row = t.column(1).to_numpy()
            for i, j, _ in _candidates(t, t.column(2).to_numpy(), least):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(row[i], row[j])), pa.array(np.minimum(row[i], row[j]))], names=["a", "b"])

    return _by_key(entries).mapInArrow(run, "a long, b long")


def _linked(entries: DataFrame, least: float, rows: DataFrame, text: str) -> DataFrame:
    """(a, b): links that join all rows of one cell in different groups whose sets are alike; ``entries`` as for ``_compared``.

    Sketches first tell which rows of a cell may be alike to another of it: these alone get their
    texts. The task that has a cell checks its pairs exactly and gives a link where two groups
    become one, so a cell has fewer links than rows, however many of its pairs are to be checked.
    Cells of over ``WEIGHT`` shingles are dealt out in cells of two blocks before.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(scratch.released(batches)):
            met = np.zeros(t.num_rows, bool)
            for i, j, _ in _candidates(t, t.column(2).to_numpy(), least):
                met[i] = met[j] = True
            if met.any():
                yield from t.filter(pa.array(met)).to_batches()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.released(batches):
            sets = [shingles(x.as_py()) for x in b.column(5)]
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets])))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], lists], names=b.schema.names)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(hashed(batches)):
            row, label = t.column(1).to_numpy(), t.column(2).to_numpy().copy()
            sets = [x.values.to_numpy() for x in t.column(5)]
            a, b = [], []
            for i, j, agree in _candidates(t, label, least):
                for k in np.argsort(-agree, kind="stable").tolist():
                    x, y = i[k], j[k]
                    if label[x] != label[y] and similarity(sets[x], sets[y]) >= least - 1e-12:
                        a.append(max(row[x], row[y]))
                        b.append(min(row[x], row[y]))
                        label[label == label[x]] = label[y]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = f"key long, {ROW} long, label long, size int, sketch binary"
    met = scratch.keep(_by_key(entries).mapInArrow(meet, columns), "met")
    used = scratch.keep(met.select(ROW).distinct(), "used")
    texts = rows.join(scratch.sized(used), ROW, "left_semi").select(ROW, F.col(text).cast("binary").alias("t"))
    heavy = met.groupBy("key").agg(F.sum("size").alias("weight")).where(F.col("weight") > WEIGHT)
    heavy = scratch.keep(heavy.select("key", F.ceil(F.col("weight") / WEIGHT).cast("int").alias("blocks")), "heavy")
    if not heavy.isEmpty():
        cut = _in_cells(met.join(scratch.sized(heavy), "key"))
        met = met.join(scratch.sized(heavy), "key", "left_anti").unionByName(cut)
    return _by_key(met.join(texts, ROW), "t").mapInArrow(link, "a long, b long")


def _in_cells(entries: DataFrame) -> DataFrame:
    """Entries of a key's ``blocks`` blocks, dealt out: each two blocks form a cell, with a key of its own."""
    mine = F.pmod(F.xxhash64(ROW, F.lit(1)), F.col("blocks")).cast("int")
    dealt = entries.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return dealt.select(cell.alias("key"), ROW, "label", "size", "sketch")


def _mixed(entries: DataFrame) -> DataFrame:
    """Stored entries of the buckets that hold several groups, with the number of their texts, ``n``."""
    told = entries.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    return scratch.keep(entries.join(scratch.keep(told.select("key", "n"), "buckets"), "key"), "mixed")


def _crossing(entries: DataFrame, least: float, hot: int = HOT, part: int = PART, rounds: int = ROUNDS, check: Callable[[DataFrame, float], DataFrame] = _compared) -> DataFrame:
    """(a, b), distinct: what ``check`` finds among rows of one bucket in different groups whose minima and sizes allow the similarity.

    Buckets of over ``hot`` texts are dealt out: each two blocks of such a bucket form a cell.
    Those of over ``part`` blocks are parted before, by two further bytes of the sketch at a time.
    Two texts that agree in ``AGREE`` bytes agree in at least ``sure`` of these pairs of
    bytes, so they meet again at the first pair in which they do, and with the next pair
    of bytes in the next round. So no bucket is gathered, and no pair of texts is lost.
    """
    halves = MINIMA // 2
    sure = halves - (MINIMA - AGREE)
    now = _mixed(entries.withColumn("after", F.lit(-1)))
    out = []
    for k in range(rounds + 1):
        most = part * hot if k < rounds else None
        dealt = now.where(F.col("n") > hot) if most is None else now.where((F.col("n") > hot) & (F.col("n") <= most))
        dealt = _in_cells(dealt.withColumn("blocks", F.ceil(F.col("n") / hot).cast("int")))
        out.append(check(now.where(F.col("n") <= hot).select(dealt.columns).union(dealt), least))
        if most is None or (large := now.where(F.col("n") > most)).isEmpty():
            break
        last = F.lit(halves - sure + k)  # a later pair of bytes is never the first, or next, that two such texts share
        large = large.where(F.col("after") < last).withColumn("after", F.explode(F.sequence(F.col("after") + 1, last)))
        again = F.xxhash64("key", "after", F.substring("sketch", 2 * F.col("after") + 1, F.lit(2)))
        now = _mixed(large.select(again.alias("key"), ROW, "label", "size", "sketch", "after"))
    return reduce(DataFrame.union, out).distinct()


def _printed(rows: DataFrame, text: str) -> DataFrame:
    """(a, b): every row with the first of its group by fingerprints, as ``simhash`` links these."""
    prints = scratch.keep(simhash.fingerprints(rows.select(ROW, text), [ROW], text), "fingerprints")
    near = simhash.near_groups(prints).withColumnRenamed("fp", "fingerprint")
    told = scratch.keep(prints.join(near, "fingerprint").select(ROW, "label"), "printed")
    first = scratch.keep(told.groupBy("label").agg(F.min(ROW).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "first"), "firsts")
    return told.join(first, "label").where(F.col(ROW) != F.col("first")).select(F.col(ROW).alias("a"), F.col("first").alias("b"))


def near_rows(rows: DataFrame, text: str = "text", least: float = LEAST, hot: int = HOT) -> DataFrame:
    """Stored (node, label): the rows of ``rows`` (with a stored ``ROW``) that are alike to another; what links reach has one label."""
    signed = scratch.keep(_signed(rows, text), "signed")
    entries = signed.select(ROW, "size", F.explode("keys").alias("key"))
    hubs = entries.groupBy("key").agg(F.min(ROW).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    shared = scratch.keep(entries.join(scratch.keep(hubs, "hubs"), "key"), "shared")
    pairs = shared.where(F.col(ROW) != F.col("hub")).select(F.col(ROW).alias("a"), F.col("hub").alias("b"))
    pairs = scratch.keep(_printed(rows, text), "by_prints").union(pairs).distinct()
    sides = signed.select(ROW, "size")
    pairs = pairs.join(sides.toDF("a", "sa"), "a").join(sides.toDF("b", "sb"), "b").where(F.least("sa", "sb") >= least * F.greatest("sa", "sb") - 1e-9)
    first = scratch.keep(_alike(scratch.keep(pairs.select("a", "b"), "pairs"), rows, text, least), "alike")
    links, label = first, components(first)
    sketches = signed.select(ROW, "size", "sketch")
    check = partial(_linked, rows=rows, text=text)

    def mixed(label: DataFrame) -> DataFrame:
        """(key, ROW, label, n): entries of the buckets that hold several groups, with the number of their texts."""
        told = scratch.keep(shared.join(label.withColumnRenamed("node", ROW), ROW, "left").select("key", ROW, F.coalesce("label", ROW).alias("label")), "told")
        several = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
        return told.join(scratch.keep(several.select("key", "n"), "several"), "key")

    entries = mixed(label)
    many = entries.where(F.col("n") > hot)
    if not many.isEmpty():  # what a block of a large bucket joins needn't be checked in each of its cells
        block = F.pmod(F.xxhash64(ROW, F.lit(1)), F.ceil(F.col("n") / hot))
        found = check(many.withColumn("key", F.xxhash64("key", block)).join(sketches, ROW), least)
        links = links.union(scratch.keep(found, "in_blocks"))
        label = components(links)
        entries = mixed(label)
    found = scratch.keep(_crossing(entries.drop("n").join(sketches, ROW), least, hot, check=check), "crossing")
    return label if found.isEmpty() else components(links.union(found))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with one row of every group: the smallest ``doc_id`` (null ids last), then the smallest ``ROW``.

    Texts without words, null ones among them, are alike. Rows that repeat an id are rows of
    their own. Columns of any names are kept as they are, and an empty table stays empty.
    """
    rows = scratch.with_row_ids(docs, "docs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(ROW)))

    def gone() -> DataFrame:
        near = near_rows(rows, text, least).withColumnRenamed("node", ROW)
        named = scratch.keep(near.join(rows.select(ROW, F.col(doc_id).alias("doc_id")), ROW), "named")
        stay = named.groupBy("label").agg(first.alias("low")).select(F.col(f"low.{ROW}").alias(ROW))
        return named.select(ROW).join(stay, ROW, "left_anti")

    return scratch.without_rows(rows, scratch.settled(gone, "gone"), docs)
