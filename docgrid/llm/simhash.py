"""Near duplicates by SimHash fingerprints and BK-trees.

A fingerprint has 64 bits: a bit is set if it is set in over half of the
XXH64 hashes of the text's word shingles. Texts whose fingerprints differ in
at most ``radius`` bits are linked; groups are what links reach.

Distinct fingerprints are dealt into shards: the 64 bits are cut into blocks,
and a shard holds the fingerprints that agree on a choice of these blocks. With
``radius + agree`` blocks, two linked fingerprints agree on at least ``agree`` of
them, so every link lies within some shard. Each shard gets a BK-tree, whose
children are keyed by their integer Hamming distance to the parent; a search
follows only the edges within ``radius`` of the distance it has measured. The
trees grow with the data, so they are not broadcast: fingerprints are sent to
the tree of their shard. A shard too large for one task is dealt anew: the bits
that its members don't share yet are cut into ``radius + 1`` blocks, on one of
which two linked members agree, and so on for up to ``LEVELS`` levels. What is
large even then differs in few bits, and is cut into chunks whose trees meet chunk
by chunk. A shard returns a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm import scratch
from docgrid.llm.components import components
from docgrid.llm.scratch import ROW
from docgrid.llm.text import free_name

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints that one task gathers, and those of a shard above which it is dealt anew or cut into chunks.
TASK_ROWS = 200_000
HOT_ROWS = 20_000
#: How often large shards are dealt anew.
LEVELS = 2
#: Mean fingerprints of a shard above which shards agree on one more block.
SHARD_ROWS = 512
#: Tree nodes that a step of a search looks at together.
STEP_NODES = 4_000_000


def fingerprint_bytes(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """The 8 bytes of a text's fingerprint, highest bit first; zero for a text without words."""
    words = (text or b"").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return bytes(8)
    if n <= 1:
        return xxhash.xxh64_digest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    hashes = np.frombuffer(b"".join([digest(joined[i:j], seed) for i, j in zip(start, end[shingle - 1 :].tolist())]), np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, ids: list[str], text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns ``ids`` and a long ``fingerprint`` of every row.

    A text of fewer words than a shingle counts as one shingle; a null text or
    one without words gets fingerprint zero.
    """
    rows = scratch.spread(docs.select(*ids, F.col(text).cast("binary").alias(free_name("text", docs))))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.released(batches):
            raw = b"".join(fingerprint_bytes(x.as_py(), shingle, seed) for x in b.column(len(ids)))
            found = pa.array(np.frombuffer(raw, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=schema.names)

    return rows.mapInArrow(run, schema)


class Forest:
    """BK-trees of many shards at once, in arrays; node i is the i-th of ``values``.

    ``shard`` numbers must ascend. A shard's first value is its root. Every other
    value descends by its distance to each node it meets, and stays where no
    child has that distance yet; the trees are those of inserting the values in
    order, but all values descend together, one level a step.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        values = values.view(np.uint64)  # the bits of a signed number's absolute value are others
        self.values = values
        n = len(values)
        self.root = np.full(int(shard[-1]) + 1 if n else 0, -1, np.int64)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.root[shard[first]] = first
        edges, here = [], np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[shard[here]]
        while len(here):
            key = at * 65 + np.bitwise_count(values[here] ^ values[at])
            order = np.argsort(key, kind="stable")
            new = np.r_[True, key[order][1:] != key[order][:-1]]
            child = here[order][new]
            edges.append((key[order][new], child))
            rest = order[~new]
            at = child[np.cumsum(new) - 1][~new]
            here = here[rest]
        key = np.concatenate([k for k, _ in edges]) if edges else np.zeros(0, np.int64)
        child = np.concatenate([c for _, c in edges]) if edges else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, node numbers) of what lies within ``radius``, level by level."""
        queries = queries.view(np.uint64)
        q = np.arange(len(queries))
        node = self.root[shard]
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right") - low
            q = np.repeat(q, many)
            node = self.child[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(q))]


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked places the smaller label until nothing changes."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(up := label[label], label):
            label[:] = up
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]


def spanning_links(values: np.ndarray, shard: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, value) that join all values of a shard which links within ``radius`` join.

    ``side`` is 0 for values that stand in the tree and are sought in it, 1 for
    those that are only sought in it (the other chunk of a cut shard).
    """
    order = np.lexsort((values, side, shard))
    values, shard, side = values[order], shard[order], side[order]
    tree = np.flatnonzero(side == 0)
    if not len(tree):
        return values[:0], values[:0]
    cut_shard = np.isin(shard, shard[side == 1])  # of these only the other chunk's values are sought
    where = np.flatnonzero(np.isin(shard, shard[tree]) & ((side == 1) | ~cut_shard))
    numbers, dense = np.unique(shard[tree], return_inverse=True)
    forest = Forest(values[tree], dense)
    label = np.arange(len(values))
    of = np.searchsorted(numbers, shard[where])
    most = np.bincount(dense)[of]
    cut = np.flatnonzero(np.diff(np.cumsum(most) // STEP_NODES)) + 1
    for w, s in zip(np.split(where, cut), np.split(of, cut)):
        for q, node in forest.search(values[w], s, radius):
            i, j = w[q], tree[node]
            _settle(label, i[i != j], j[i != j])
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def shard_plan(n: int, radius: int) -> tuple[int, int]:
    """(blocks, blocks that agree) for ``n`` distinct fingerprints: mean shards stay below SHARD_ROWS."""
    agree = 1
    while n / 2 ** (64 * agree // (radius + agree)) > SHARD_ROWS and agree < 8:
        agree += 1
    return radius + agree, agree


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(blocks: int, agree: int) -> list[int]:
    """Bits of every choice of ``agree`` of the blocks."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    return [_signed(sum(((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in chosen)) for chosen in combinations(range(blocks), agree)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """``mask`` with each of ``radius + 1`` blocks of the other bits added; two values that agree on it and are linked agree on one of these."""
    free = [k for k in range(64) if not mask >> k & 1]
    blocks = [free[len(free) * i // (radius + 1) : len(free) * (i + 1) // (radius + 1)] for i in range(radius + 1)]
    return [_signed((mask & (1 << 64) - 1) | sum(1 << k for k in block)) for block in blocks]


def _shards(prints: DataFrame, radius: int, blocks: int, agree: int) -> DataFrame:
    """(fp, mask, bits): every fingerprint once for each choice of blocks, and those of large shards once more for each finer choice."""
    spark = prints.sparkSession
    choices = [F.lit(m) for m in masks(blocks, agree)]
    dealt = prints.select("fp", F.explode(F.array(*choices)).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
    small = None
    for _ in range(LEVELS):
        hot = dealt.groupBy("mask", "bits").count().where(F.col("count") > HOT_ROWS).select("mask", "bits")
        hot = scratch.keep(hot.where(F.bit_count("mask") < 64 - radius), "hot")
        found = [r["mask"] for r in hot.select("mask").distinct().collect()]
        if not found:
            break
        rest = dealt.join(scratch.sized(hot), ["mask", "bits"], "left_anti")
        small = rest if small is None else small.unionByName(rest)
        finer = spark.createDataFrame([(m, f) for m in found for f in finer_masks(m, radius)], "mask long, finer long")
        dealt = dealt.join(scratch.sized(hot), ["mask", "bits"], "left_semi").join(F.broadcast(finer), "mask")
        dealt = dealt.select("fp", F.col("finer").alias("mask")).distinct()
        dealt = scratch.keep(dealt.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))), "dealt")
    return dealt if small is None else small.unionByName(dealt)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join all distinct fingerprints ``fp`` which links within ``radius`` join."""
    n = prints.count()
    blocks, agree = shard_plan(n, radius)
    dealt = _shards(prints, radius, blocks, agree)
    large = dealt.groupBy("mask", "bits").count().where(F.col("count") > HOT_ROWS)
    large = scratch.keep(large.select("mask", "bits", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("chunks")), "large")
    if large.isEmpty():
        tasks = dealt.select("fp", "mask", "bits", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    else:
        cut = dealt.join(scratch.sized(large), ["mask", "bits"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        tasks = cut.select("fp", "mask", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    parts = max(prints.sparkSession.sparkContext.defaultParallelism, n * comb(blocks, agree) // TASK_ROWS + 1)
    tasks = tasks.withColumn("shard", F.xxhash64("mask", "bits", "i", "j")).repartition(parts, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not held:
            return
        fp, shard, side = (np.concatenate(x) for x in zip(*held))
        a, b = spanning_links(fp, shard, side, radius)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return tasks.select("fp", "shard", "side").mapInArrow(run, "a long, b long")


def near_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, label) of every distinct value of ``fingerprint``: what links reach has one label."""
    distinct = scratch.keep(prints.select(F.col("fingerprint").alias("fp")).distinct(), "prints")
    found = components(scratch.keep(links(distinct, radius), "pairs"))
    found = found.withColumnRenamed("node", "fp")
    return scratch.keep(distinct.join(found, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "near")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest ``doc_id`` of the group, null ids aside (a
    group of null ids alone has null). Rows with equal ids and texts are in one
    group. An empty table gives an empty result.
    """
    prints = scratch.keep(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", shingle), "fingerprints")
    near = near_groups(prints, radius)
    least = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("low")).join(near, "fp")
    least = scratch.keep(least, "least")
    group = least.groupBy("label").agg(F.min("low").alias("component_id"))
    of = scratch.keep(least.join(group, "label").select(F.col("fp").alias("fingerprint"), "component_id"), "groups")
    return prints.join(of, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of every group: the smallest ``doc_id`` (null ids last), then the first row.

    Columns keep their names and values, whatever they are called.
    """
    rows = scratch.with_row_ids(docs, "docs")
    prints = scratch.keep(fingerprints(rows.select(ROW, F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), [ROW, "doc_id"], "text", shingle), "fingerprints")
    near = near_groups(prints, radius).withColumnRenamed("fp", "fingerprint")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(ROW)))
    least = scratch.keep(prints.groupBy("fingerprint").agg(first.alias("low")).join(near, "fingerprint"), "least")
    stay = scratch.keep(least.groupBy("label").agg(F.min("low").alias("low")).select(F.col(f"low.{ROW}").alias(ROW)), "stay")
    gone = scratch.keep(prints.select(ROW).join(stay, ROW, "left_anti"), "gone")
    return scratch.without_rows(rows, gone, docs)
