"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Tokens are the words of a text and one end. The end and frequent words are
outputs of their own; all others share outputs by their last characters, and
within such an output a word has its add-half share of the training counts. The
log-bilinear model predicts the output from the two outputs before it: a context
vector is the sum of a vector for each place, an output's score its product with
the output's vector plus a bias. Outputs are numbered by their mass and dealt into
classes of ``CLASS``; classes have vectors and biases likewise. A token's
probability is that of its class times that of its output within the class, both
normalised by batched matrix products, so that a token costs as much as a
class and the list of classes, not the whole vocabulary.

Training, in numpy, tells a token (and its class) from noise drawn from the
unigram distribution. It takes ``ROUNDS`` rounds, each over its own share of
the training texts, all together over all of them: every task starts from the
round's parameters and learns from its partition, with steps scaled by each
row's past gradients. Then the tasks' moves of a row are put together in a tree of
small groups: a row whose past gradients are many moves by the tasks' mean, one
with few by their sum, as if a single task had met it all.

Exact token counts come from all training texts. Counts of the most frequent
words, a bounded number found by a count threshold, are broadcast; every other
word of a text finds its count by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm import scratch
from docgrid.llm.scratch import ROW
from docgrid.llm.text import crc32_mod

#: Most words with an output of their own, endings with one, and characters of an ending.
WORDS = 16_000
TAILS = 384
ENDING = 2
#: Outputs of a class.
CLASS = 128
#: Words whose counts are broadcast; the others' counts are joined.
KNOWN = 200_000
DIM = 24
NOISE = 24
BATCH = 1024
RATE = 0.12
ROUNDS = 3
#: Mean square gradient that every row starts from.
FIRST = 1e-2
#: Distinct words that a counting task holds before it hands them on, and tokens that a training step gathers.
HELD = 400_000
GATHER = 400_000
#: Tokens of a training task: more tasks than cores from the first on, none below the second; moves that are put together at once.
TASK_TOKENS = 4_000_000
LEAST_TOKENS = 1_600_000
FAN = 8
#: Tokens that are scored together, and bytes of text of a portion of rows.
PORTION = 200_000
PORTION_BYTES = 2 << 20
#: Contexts whose sums are taken at once: few enough for a core's own cache.
SUMMED = 1024


def _words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def count_tokens(docs: DataFrame) -> DataFrame:
    """Stored (token, n): how often each word occurs in the texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for x in b.column(0):
                held.update(_words(x.as_py()))
                if len(held) > HELD:
                    yield _counted(held)
                    held.clear()
        if held:
            yield _counted(held)

    raw = docs.select(F.col("text").cast("binary")).mapInArrow(run, "token string, n long")
    return scratch.keep(raw.groupBy("token").agg(F.sum("n").alias("n")), "counts")


def _counted(held: Counter[bytes]) -> pa.RecordBatch:
    tokens = pa.array(list(held), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([tokens, pa.array(list(held.values()), pa.int64())], names=["token", "n"])


def _step(n: str = "n"):  # noqa: ANN202
    """Counts in steps of a sixteenth of a doubling."""
    return F.floor(F.log2(F.col(n)) * 16)


def _least_step(hist: list[tuple[int, int]], limit: int) -> int:
    """The lowest step from which on there are at most ``limit`` words."""
    lowest, many = 1 << 30, 0
    for step, words in sorted(hist, reverse=True):
        many += words
        if many > limit:
            break
        lowest = step
    return lowest


class Vocabulary:
    """Outputs of the model and counts of the most frequent words; of bounded size.

    Outputs ascend as their mass falls. ``size`` is one more than the last; as a
    context that number stands for the beginning.
    """

    def __init__(self, counts: DataFrame, texts: int):
        self.texts = texts
        self.total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.total += texts
        self.kinds = kinds + (texts > 0)
        hist = [(r["step"], r["count"]) for r in counts.groupBy(_step().alias("step")).count().collect()]
        known, own = _least_step(hist, KNOWN), _least_step(hist, WORDS)
        top = counts.withColumn("step", _step()).where(F.col("step") >= known).toArrow().sort_by([("n", "descending"), ("token", "ascending")])
        words, self.counts = [w.encode() for w in top["token"].to_pylist()], top["n"].to_numpy().astype(np.int64)
        self.index = {w: i for i, w in enumerate(words)}
        n_own = int((top["step"].to_numpy() >= own).sum())
        ends = counts.where(_step() < own).groupBy(F.right("token", F.lit(ENDING)).alias("e")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
        ends = scratch.keep(ends, "endings")
        best = ends.orderBy(F.desc("n"), "e").limit(TAILS).collect()
        rest = ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
        # in this order: the end, words of no listed ending, endings, words of their own
        mass = np.array([texts, rest[0] - sum(r["n"] for r in best), *(r["n"] for r in best), *self.counts[:n_own]], float)
        types = np.array([0, rest[1] - sum(r["k"] for r in best), *(r["k"] for r in best)], float)
        order = np.argsort(-mass, kind="stable")
        place = np.empty(len(mass), np.int32)
        place[order] = np.arange(len(mass), dtype=np.int32)
        self.size = len(mass)
        self.end, self.other = int(place[0]), int(place[1])
        self.endings = {r["e"]: int(place[2 + i]) for i, r in enumerate(best)}
        share = mass[order] + 0.5
        self.log_share = np.log(share / share.sum())
        self.first = np.arange(0, self.size, CLASS)
        self.log_class = np.log(np.add.reduceat(share, self.first) / share.sum())
        #: log10 of what the add-half share within an output is divided by; nothing for the end and words of their own
        self.log_within = np.zeros(self.size)
        shared = place[1 : len(types)]
        self.log_within[shared] = np.log10(mass[1 : len(types)] + 0.5 * (types[1:] + 1))
        self.shared = np.zeros(self.size, bool)
        self.shared[shared] = True
        first = len(types)
        self.output = np.array([place[first + i] if i < n_own else self.tail(w) for i, w in enumerate(words)] or [self.other], np.int32)
        self.log_count = np.log10(self.counts + 0.5)
        self.log_base = np.log10(self.total + 0.5 * (self.kinds + 1))

    def tail(self, word: bytes) -> int:
        """The output of a word that has none of its own."""
        return self.endings.get(word.decode("utf-8", "replace")[-ENDING:], self.other)

    def places(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number among the known words or -1, output) of each word."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        out = self.output[at] if len(words) else np.zeros(0, np.int32)
        for i in np.flatnonzero(at < 0).tolist():
            out[i] = self.tail(words[i])
        return at, out


def contexts(outputs: np.ndarray, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Outputs one and two places before each, ``begin`` before a text's first."""
    one = np.r_[begin, outputs[:-1]]
    one[starts] = begin
    two = np.r_[begin, one[:-1]]
    two[starts] = begin
    return one, two


class Model:
    """Parameters: vectors of the last and the last but one output, of outputs and classes, and the biases of both."""

    def __init__(self, log_share: np.ndarray, log_class: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        n, k = len(log_share), len(log_class)
        self.one, self.two, self.out, self.cls = (rng.normal(0, 0.1, (m, DIM)).astype(np.float32) for m in (n + 1, n + 1, n, k))
        self.bias, self.cbias = log_share.astype(np.float32), log_class.astype(np.float32)
        self.width = CLASS  # outputs of a class

    def parts(self) -> list[np.ndarray]:
        return [self.one, self.two, self.out, self.cls, self.bias[:, None], self.cbias[:, None]]

    def past(self) -> list[np.ndarray]:
        """For each row the squares of the gradients that it starts from."""
        return [np.full((len(p), 1), FIRST, np.float32) for p in self.parts()]

    def copy(self) -> Model:
        other = object.__new__(Model)
        for name, value in vars(self).items():
            setattr(other, name, value.copy() if isinstance(value, np.ndarray) else value)
        return other

    def log(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of outputs behind their contexts."""
        cut = range(0, len(target), PORTION)
        return np.concatenate([np.zeros(0, np.float32), *(self._log(*(x[k : k + PORTION] for x in (target, one, two))) for k in cut)])

    def _log(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        h = self.one[one] + self.two[two]
        cls = target // self.width
        told = np.einsum("ij,ij->i", h, self.cls[cls]) + self.cbias[cls] - _log_sums(h, self.cls, self.cbias)
        told += np.einsum("ij,ij->i", h, self.out[target]) + self.bias[target]
        order = np.argsort(cls, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(cls[order]) != 0, True]) if len(order) else []
        for i, j in zip(edge[:-1], edge[1:]):
            of = order[i:j]
            k, n = cls[of[0]] * self.width, self.width
            told[of] -= _log_sums(h[of], self.out[k : k + n], self.bias[k : k + n])
        return told


def _log_sums(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all ``vectors`` for each context."""
    out = np.empty(len(h), np.float32)
    for k in range(0, len(h), SUMMED):
        z = h[k : k + SUMMED] @ vectors.T
        z += bias
        with np.errstate(over="ignore", divide="ignore"):
            told = np.log(np.exp(z, out=z).sum(axis=1))
        if not np.isfinite(told).all():  # too large or too small for plain sums
            z = h[k : k + SUMMED] @ vectors.T + bias
            high = z.max(axis=1)
            told = np.log(np.exp(z - high[:, None]).sum(axis=1)) + high
        out[k : k + SUMMED] = told
    return out


def _gathered(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct places, sums of their rows)."""
    order = np.argsort(at, kind="stable")  # of 16 bits: in linear time
    sorted_ = at[order]
    new = np.ones(len(at), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return sorted_[first].astype(np.intp), np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation with steps scaled by past gradients."""

    def __init__(self, model: Model, past: list[np.ndarray], log_share: np.ndarray, log_class: np.ndarray, seed: int):
        self.start, self.before = model, past
        self.m, self.past, self.rng = model.copy(), [p.copy() for p in past], np.random.default_rng(seed)
        self.noise = [(np.cumsum(np.exp(x)), (x + np.log(NOISE)).astype(np.float32)) for x in (log_share, log_class)]
        self.kind = np.min_scalar_type(len(model.one))
        self.seen = 0

    def learn(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        self.seen += len(target)
        target, one, two = (x.astype(self.kind) for x in (target, one, two))
        order = self.rng.permutation(len(target))
        for k in range(0, len(target), BATCH):
            part = order[k : k + BATCH]
            self.step(target[part], one[part], two[part])

    def told_apart(self, h: np.ndarray, target: np.ndarray, vectors: np.ndarray, bias: np.ndarray, noise: tuple) -> tuple:
        """Gradients of the contexts, of the met vectors and of their biases, for one of the two levels."""
        cum, log_noise = noise
        other = np.minimum(np.searchsorted(cum, self.rng.random(NOISE)), len(cum) - 1)
        q, qn = vectors[target], vectors[other]
        told = np.einsum("ij,ij->i", h, q) + bias[target] - log_noise[target]
        seen = h @ qn.T + (bias[other] - log_noise[other])
        up = 1 / (1 + np.exp(np.clip(told, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(seen, -30, 30)))
        n = len(target)
        rows = np.empty((n + NOISE, DIM + 1), np.float32)
        np.multiply(up[:, None], h, out=rows[:n, :-1])
        rows[:n, -1] = up
        rows[n:, :-1] = down.T @ h
        rows[n:, -1] = down.sum(axis=0)
        at, rows = _gathered(rows, np.concatenate([target, other.astype(self.kind)]))
        q *= up[:, None]
        q += down @ qn
        return q, at, rows[:, :-1], rows[:, -1:]

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.m
        h = m.one[one] + m.two[two]
        dh, at_out, out, bias = self.told_apart(h, target, m.out, m.bias, self.noise[0])
        dc, at_cls, cls, cbias = self.told_apart(h, (target // m.width).astype(self.kind), m.cls, m.cbias, self.noise[1])
        dh += dc
        moves = [_gathered(dh, one), _gathered(dh, two), (at_out, out), (at_cls, cls), (at_out, bias), (at_cls, cbias)]
        for p, past, (at, g) in zip(m.parts(), self.past, moves):
            scale = np.float32(32 / BATCH)
            held = past[at, 0] + np.einsum("ij,ij->i", g, g) * (scale * scale / np.float32(g.shape[1]))
            past[at, 0] = held
            g *= (np.float32(RATE) * scale / np.sqrt(held))[:, None]
            p[at] += g

    def moves(self) -> bytes:
        """Each row's move times the square gradients that it has met, and these."""
        grown = [new - old for new, old in zip(self.past, self.before)]
        moved = [(new - old) * (FIRST + g) for new, old, g in zip(self.m.parts(), self.start.parts(), grown)]
        return np.concatenate([x.ravel() for x in (*moved, *grown)]).tobytes()


def _moved(start: Model, past: list[np.ndarray], raw: bytes) -> tuple[Model, list[np.ndarray]]:
    """Parameters and past square gradients after the summed ``moves`` of all tasks."""
    flat, at, out, new = np.frombuffer(raw, np.float32), 0, start.copy(), []
    sums = []
    for p in (*out.parts(), *past):
        sums.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    for p, before, total, grown in zip(out.parts(), past, sums, sums[6:]):
        new.append(before + grown)
        p += total / (FIRST + grown)
    return out, new


def train(docs: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Model:
    """A model of the texts of ``docs`` (doc_id, text)."""
    model = Model(voc.log_share, voc.log_class)
    past = model.past()
    share = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(rounds))
    for k in range(rounds):
        model, past = _round(docs.where(share == k), voc, model, past, k)
    return model


def _round(docs: DataFrame, voc: Vocabulary, start: Model, past: list[np.ndarray], k: int) -> tuple[Model, list[np.ndarray]]:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((voc, start, past))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        voc, model, past = sent.value
        number = TaskContext.get().partitionId()
        trainer = Trainer(model, past, voc.log_share, voc.log_class, number)
        outs: list[np.ndarray] = []
        held = 0

        def learn() -> None:
            starts = np.cumsum([0, *map(len, outs[:-1])])
            flat = np.concatenate(outs)
            trainer.learn(flat, *contexts(flat, starts, voc.size))

        for b in batches:
            for x in b.column(0):
                outs.append(np.r_[voc.places(_words(x.as_py()))[1], voc.end])
                held += len(outs[-1])
                if held >= GATHER:
                    learn()
                    outs, held = [], 0
        if outs:
            learn()
        if trainer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([trainer.moves()])], names=["part", "params"])

    tasks = min(max(spark.sparkContext.defaultParallelism, int(voc.total // TASK_TOKENS)), max(1, int(voc.total // LEAST_TOKENS)))
    learnt = scratch.keep(docs.select(F.col("text").cast("binary")).coalesce(tasks).mapInArrow(run, "part long, params binary"), f"learnt{k}")
    parts = learnt.agg(F.max("part")).first()[0]
    if parts is None:
        return start, past
    while parts > 0:
        parts //= FAN
        learnt = learnt.withColumn("part", F.floor(F.col("part") / FAN))
        learnt = scratch.keep(learnt.groupBy("part").applyInArrow(_added, "part long, params binary"), "learnt")
    return _moved(start, past, learnt.first()["params"])


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    """The sum of the moves of at most FAN tasks or groups."""
    whole = sum(np.frombuffer(x.as_py(), np.float32) for x in rows["params"])
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "params": pa.array([whole.tobytes()])})


def score(docs: DataFrame, held_out_of: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    Rows whose crc32(doc_id as text) modulo 5 is 1 are held out of all learning.
    Scores are log10 probabilities of the whole text and its end. A null text
    counts as empty and has the end alone; without training texts nothing is
    known and both scores are those of a single unknown token each. Null ids count
    as empty texts for the choice of what is held out; rows may repeat ids or
    whole rows, and each is scored by itself. Other columns are passed over,
    whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = scratch.spread(docs.select("doc_id", "text"), stored=True).select("doc_id", F.col("text").cast("binary").alias("text"), (crc32_mod(F.col("doc_id"), held_out_of) == held_out).alias("held_out"))
    learn = docs.where(~F.col("held_out"))
    counts = count_tokens(learn)
    voc = Vocabulary(counts, learn.count())
    model = train(learn, voc)
    sent = spark.sparkContext.broadcast((voc, model))
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            *(T.StructField(n, t) for n, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("model", T.DoubleType()))),
            T.StructField("rare", T.ArrayType(T.StringType())),
            T.StructField("times", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, model = sent.value
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            edge = np.flatnonzero(np.diff(ends // PORTION_BYTES, prepend=0)) if b.num_rows else []
            for i, j in pairwise(sorted({0, b.num_rows, *(int(k) for k in edge)})):
                yield _scored(b.slice(i, j - i), voc, model, schema.names)

    cols = docs.select("doc_id", "held_out", "text")
    told = scratch.keep(cols.mapInArrow(run, schema).withColumn(ROW, F.monotonically_increasing_id()), "told")
    rare = told.select(ROW, F.explode(F.arrays_zip("rare", "times")).alias("r")).select(ROW, F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    rare = rare.join(counts, "token", "left").groupBy(ROW).agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("s"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("k"))
    some = F.coalesce("s", F.lit(0.0))
    return told.join(rare, ROW, "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(int(voc.total)).cast("long").alias("train_tokens"),
        (F.col("base") + some).alias("base_score"),
        (F.col("model") + some).alias("score"),
    )


def _scored(b: pa.RecordBatch, voc: Vocabulary, model: Model, names: list[str]) -> pa.RecordBatch:
    """Scores of a batch's texts but for the counts of rare words, which are handed on by name."""
    texts = [_words(x.as_py()) for x in b.column(2)]
    size = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(size) - size
    at, out = voc.places([w for t in texts for w in (*t, b"")])
    last = starts + size - 1
    out[last] = voc.end
    one, two = contexts(out, starts, voc.size)
    told = model.log(out, one, two).astype(np.float64) / np.log(10)
    known = at >= 0
    known[last] = False
    part = np.where(known, voc.log_count[at] if len(voc.log_count) else 0.0, 0.0)
    end = np.log10(voc.texts + 0.5)
    base = np.add.reduceat(part, starts) + end - size * voc.log_base
    within = np.where(voc.shared[out], part - voc.log_within[out], 0.0)
    told = np.add.reduceat(told + within, starts)
    n_known = np.add.reduceat(known.astype(np.int64), starts) + (voc.texts > 0)
    rare, times = [], []
    missing = np.flatnonzero(~known)
    cut = np.searchsorted(missing, np.r_[starts, starts[-1] + size[-1]])
    for i, t in enumerate(texts):
        held = Counter([t[k - starts[i]] for k in missing[cut[i] : cut[i + 1] - 1].tolist()])
        rare.append([w.decode() for w in held])
        times.append(list(held.values()))
    cols = [*b.columns[:2], pa.array(size), pa.array(n_known), pa.array(base), pa.array(told), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=names)
