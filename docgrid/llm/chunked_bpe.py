"""BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over the last bytes decides where a text is cut, so equal
passages are cut alike wherever they stand. A chunk is encoded once and then
looked up, whichever document it comes from; of a new chunk only words that no
chunk of late had go through the tokenizer, many in one text with a mark between
each two; those of the letters a-z alone, which nothing before the tokenizer's model
changes or divides, go to the model itself. Words are known by their lower-case form where
a chunk is Latin, and one with punctuation behind it by its stem and that. Where two chunks join, a window is
encoded anew: from the whole word before the one that the cut meets to the whole
word behind it. Its ids take the place of both chunks' ids there if they agree
with the left chunk on the window's first word and with the right chunk on its
last; otherwise the window is widened over these chunks and encoded again, until
both sides agree or the window is the text. Chunks without such words (or of one
long word) are part of a window from the start.

Agreement over a whole word is enough where white space is where encoding starts
anew; only tokenizers for which this holds are accepted: see ``load``. The tests
hold ids and decoded texts against the tokenizer's own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm.scratch import released, spread
from docgrid.llm.text import free_name

#: A cut after a byte whose rolling hash has these bits at zero: 2**bits bytes a chunk on average.
CUT_BITS = 9
#: Bytes that the rolling hash looks back on, and those that are cut at once.
LOOK_BACK = 16
CUT_BYTES = 1 << 20
#: Chunks of a generation of a worker's memory, windows, and words.
MEMORY = 12_000
WORDS = 60_000
#: Bytes of text that are cut and looked up together, and chunks or windows that go through the tokenizer together.
PORTION_BYTES = 512 << 10
RUN = 4096
#: Words that go through the tokenizer as one text, and what stands between them.
JOINED = 64
MARK = "\x01"

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_HEAD = re.compile(r"[^ \t-\r]*+[ \t-\r]++")
_WORD = re.compile(r"[^ \t-\r]++[ \t-\r]++")
_TAIL = re.compile(r"[ \t-\r]++([^ \t-\r]++)[ \t-\r]++([^ \t-\r]*+)\Z")


def cuts(data: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places where content-defined chunks end."""
    found = []
    for k in range(0, len(data), CUT_BYTES):
        low = max(0, k - LOOK_BACK + 1)
        gear = _GEAR[data[low : k + CUT_BYTES]]
        rolled, i = gear, 1
        while i < LOOK_BACK:  # of 2 bytes, of 4 and so on
            back = rolled[:-i] << np.uint32(i)
            rolled = rolled.copy()
            rolled[i:] += back
            i *= 2
        found.append(np.flatnonzero(rolled[k - low :] >> np.uint32(32 - bits) == 0) + k + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(text: bytes, bits: int = CUT_BITS) -> list[str]:
    """A text's content-defined chunks; a cut inside a character moves behind it."""
    data = np.frombuffer(text, np.uint8)
    at = cuts(data, bits)
    for _ in range(3):
        inside = (at < len(data)) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80) if len(at) else at[:0].astype(bool)
        at = at + inside
    edge = np.unique(np.r_[0, at, len(data)]).tolist()
    return [text[i:j].decode() for i, j in zip(edge, edge[1:])]


def load(path: str):  # noqa: ANN201
    """The tokenizer of a file, if white space separates what it does to a text."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = next((p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), {})
    if not (split.get("behavior") == "Removed" and split.get("invert") and spec["decoder"] is None and spec["post_processor"] is None):
        raise ValueError(f"{path}: not a tokenizer that drops white space and joins decoded tokens by spaces")
    if not split.get("pattern", {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
        raise ValueError(f"{path}: not a tokenizer whose words end at white space")
    if any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
        raise ValueError(f"{path}: an added token reaches over white space")
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@dataclass(slots=True)
class Chunk:
    """Ids of a chunk, and where in it and in them whole words at both ends lie.

    ``left``: the number of characters up to the word that a window on the left
    ends with, and of that and it; ``right``: the place of the word that a window
    on the right begins with, and that of the cut word behind it. ``at``: the same four
    places in ``ids``; None if the chunk has no two such words.
    """

    ids: np.ndarray
    left: int = 0
    right: int = 0
    at: tuple[int, int, int, int] | None = None


def _tail(text: str) -> re.Match[str] | None:
    """The last whole word and the cut one behind it, sought in an end that is widened as needed."""
    size = 64
    while True:
        m = _TAIL.search(text, max(0, len(text) - size))
        if m or size >= len(text):
            return m
        size *= 4


def described(text: str, words: list[bytes]) -> Chunk:
    """A chunk from the ids of its words (int32), and what a window needs to know of it."""
    out = Chunk(np.frombuffer(bytearray().join(words), np.int32))
    head = _HEAD.match(text)
    word = head and _WORD.match(text, head.end())
    tail = word and _tail(text)
    if not tail or word.end() > tail.start(1):
        return out
    first = 0 if text[0] in " \t\n\v\f\r" else 1  # the word behind the one that a cut may have met
    last = len(words) - (2 if tail[2] else 1)
    size = [len(w) // 4 for w in (*words[: first + 1], *words[last:])]
    low, high = sum(size[:first]), len(out.ids) - sum(size[first + 1 :])
    place = low, low + size[first], high, high + size[first + 1]
    if place[0] < place[1] <= place[2] < place[3]:
        out.left, out.right, out.at = word.end(), tail.start(1), place
    return out


class Memory:
    """Results by text, in two generations.

    What is used while a generation fills moves into it; the rest is forgotten
    with the generation before, at the next ``turn`` after it is full. So
    frequent entries stay, at any length of run.
    """

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}

    def lacking(self, wanted: set) -> list:
        """Those of ``wanted`` that aren't known; all others are in ``young`` afterwards."""
        young, old, new = self.young, self.old, []
        for x in wanted:
            if x not in young:
                if x in old:
                    young[x] = old[x]
                else:
                    new.append(x)
        return new


class Encoder:
    """Encodes whole texts from remembered chunks: (number of ids, ids as text, decoded text) of each."""

    def __init__(self, path: str, memory: int = MEMORY, bits: int = CUT_BITS):
        self.tokenizer, self.bits = load(path), bits
        self.encoded = self.widened = 0
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(n)]
        self.numbers = [b"%d" % i for i in range(n)]
        self.chunks, self.windows, self.words = Memory(memory), Memory(memory), Memory(WORDS)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        normal = spec["normalizer"] or {}
        steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in normal.get("normalizers", [normal] if normal else [])]
        known = all(n in (("NFC", None), ("Lowercase", None), ("Replace", r"\s+")) for n in steps)
        cut = spec["pre_tokenizer"]["pretokenizers"]
        known &= [p["type"] for p in cut] == ["Split", "ByteLevel"] and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        self.lower = known and ("Lowercase", None) in steps
        #: punctuation that is a piece of its own behind a letter or digit, and no part of an added token
        self.ends = "".join(c for c in string.punctuation if not any(c in t for t in self.added)).encode() if known else b""
        self.model = self.tokenizer.model if known and not any(t.isalpha() for t in self.added) else None
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _split(self, text: str) -> list[bytes]:
        """The words of a text, in lower case if it is Latin-1, where no character composes with another, and has the same ids by that."""
        if self.lower:
            raw = text.encode("latin-1", "replace")
            if text.isascii() or raw.decode("latin-1") == text:
                low = text.lower()
                if not any(t in low for t in self.added):
                    text = low
        return text.encode().split()

    def _through(self, texts: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Texts with their ids from the tokenizer."""
        for k in range(0, len(texts), RUN):
            part = texts[k : k + RUN]
            yield from zip(part, (e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)))

    def _through_joined(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words with their ids (int32), ``JOINED`` of them as one text; one by one where a word has the mark's own id."""
        runs = [words[k : k + JOINED] for k in range(0, len(words), JOINED)] if self.mark is not None else []
        apart = [] if runs else list(words)
        between = f" {MARK} ".encode()
        for k in range(0, len(runs), RUN // JOINED):
            part = runs[k : k + RUN // JOINED]
            made = self.tokenizer.encode_batch_fast([between.join(r).decode() for r in part], add_special_tokens=False)
            for run, e in zip(part, made):
                ids = np.array(e.ids, np.int32)
                at = (4 * np.flatnonzero(ids == self.mark)).tolist()
                if len(at) == len(run) - 1:
                    raw = ids.tobytes()
                    yield from zip(run, map(raw.__getitem__, map(slice, [0, *(i + 4 for i in at)], [*at, len(raw)])))
                else:
                    apart += run
        yield from ((w.encode(), np.array(ids, np.int32).tobytes()) for w, ids in self._through([w.decode() for w in apart]))

    def _learn_words(self, wanted: set[bytes]) -> None:
        """Ids (int32) of words; one with punctuation behind a letter or digit of ASCII is its stem and that."""
        new, young, ended = self.words.lacking(wanted), self.words.young, []
        if self.ends:
            for w in new:
                if w[-1:] in self.ends and (stem := w.rstrip(self.ends))[-1:].isalnum():
                    ended.append((w, stem, w[len(stem) :]))
            new = set(new).difference(w for w, _, _ in ended)
            new.update(self.words.lacking({x for _, *two in ended for x in two}))
        rest = []
        for w in new:
            if self.model is not None and w.isalpha() and w.islower():
                young[w] = array("i", [t.id for t in self.model.tokenize(w.decode())]).tobytes()
            else:
                rest.append(w)
        young.update(self._through_joined(rest))
        young.update((w, young[stem] + young[end]) for w, stem, end in ended)

    def _learn_chunks(self, wanted: set[str]) -> None:
        new = self.chunks.lacking(wanted)
        self.encoded += len(new)
        cut = list(map(self._split, new))
        self._learn_words(set(chain.from_iterable(cut)))
        word = self.words.young.__getitem__
        self.chunks.young.update((x, described(x, list(map(word, w)))) for x, w in zip(new, cut))

    def _learn_windows(self, wanted: set[str]) -> None:
        """Windows go through the tokenizer whole."""
        new = self.windows.lacking(wanted)
        self.encoded += len(new)
        self.windows.young.update((x, np.array(ids, np.int32)) for x, ids in self._through(new))

    def _windows(self, text: list[str], known: list[Chunk], whole: list[bool]) -> list[tuple[int, int, str]]:
        """(chunk before or -1, chunk behind or their number, window) between each two chunks that aren't ``whole``ly in one.

        A window reaches from the last whole word of the chunk before it to the first of that behind it.
        """
        out, before = [], -1
        for i in range(len(text) + 1):
            if i < len(text) and whole[i]:
                continue
            if before >= 0 or i:
                if before < 0 and i == len(text):
                    out.append((-1, i, "".join(text)))
                elif not (before < 0 and i == 0) and not (before == len(text) - 1 and i == len(text)):
                    first = text[before][known[before].right :] if before >= 0 else ""
                    last = text[i][: known[i].left] if i < len(text) else ""
                    out.append((before, i, "".join([first, *text[before + 1 : i], last])))
            before = i
        return out

    def encode(self, texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """For each text the number of ids, the decimal ids joined by spaces, and the decoded text."""
        self.chunks.turn()
        self.windows.turn()
        self.words.turn()
        cut = [chunks(t, self.bits) for t in texts]
        self._learn_chunks(set(chain.from_iterable(cut)))
        known = [list(map(self.chunks.young.__getitem__, c)) for c in cut]
        # a chunk in a window whole: one without words of its own, but not a text's only chunk, which needs no window
        whole = [[x.at is None and len(c) > 1 for x in c] for c in known]
        ids: list[np.ndarray | None] = [None] * len(texts)
        todo = list(range(len(texts)))
        while todo:
            found = {i: self._windows(cut[i], known[i], whole[i]) for i in todo}
            self._learn_windows({w for ws in found.values() for _, _, w in ws})
            again = []
            for i in todo:
                wide = self._repaired(known[i], whole[i], found[i])
                if isinstance(wide, np.ndarray):
                    ids[i] = wide
                else:
                    again.append(i)
            todo = again
        return [self._told(x) for x in ids]

    def _repaired(self, known: list[Chunk], whole: list[bool], windows: list[tuple[int, int, str]]) -> np.ndarray | None:
        """The ids of a text, if every window agrees with the chunks at its ends; else these go into the windows."""
        young, agree = self.windows.young, True
        parts: dict[int, np.ndarray] = {}
        low, high = {}, {}
        for a, b, w in windows:
            ids = young[w]
            parts[a] = ids
            if a >= 0:
                _, _, i, j = known[a].at
                high[a] = i
                if ids[: j - i].tobytes() != known[a].ids[i:j].tobytes():
                    whole[a], agree = True, False
            if b < len(known):
                i, j, _, _ = known[b].at
                low[b] = j
                if ids[max(0, len(ids) - (j - i)) :].tobytes() != known[b].ids[i:j].tobytes():
                    whole[b], agree = True, False
        if not agree:
            self.widened += 1
            return None
        out = [parts[-1]] if -1 in parts else []
        for i, x in enumerate(known):
            if not whole[i]:
                out.append(x.ids[low.get(i, 0) : high.get(i, len(x.ids))])
                if i in parts:
                    out.append(parts[i])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _told(self, ids: np.ndarray) -> tuple[int, bytes, bytes]:
        raw = ids.tolist()
        return len(raw), b" ".join(map(self.numbers.__getitem__, raw)), b" ".join(map(self.names.__getitem__, raw))

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
        """``encode`` in portions of bounded size, or of one text."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > PORTION_BYTES:
                yield from self.encode(held)
                held, size = [], 0
        yield from self.encode(held)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker, so that chunks stay known from task to task."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, ids: list[str], text: str = "text", outputs: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``ids`` with n_tokens, ids_sha256, decoded_sha256 of every row.

    ``outputs`` may name token_ids (array of int) and decoded, to be returned too. A
    null text counts as empty: no ids, and both digests are those of the empty text. Every row is
    encoded by itself, so repeated rows and ids give repeated rows; null ids stay
    null, and an empty table gives an empty result. Columns other than ``ids`` and
    ``text`` are passed over, whatever their names.
    """
    rows = spread(docs.select(*ids, F.col(text).cast("binary").alias(free_name("text", docs))))
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    more = {"token_ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    new += [(name, more[name]) for name in outputs]
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, t) for n, t in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path)
        for b in released(batches):
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                done = list(of.encode_all([x.as_py() or b"" for x in part.column(len(ids))]))
                cols = [pa.array([n for n, _, _ in done], pa.int64())]
                cols += [pa.array([hashlib.sha256(x[i]).hexdigest() for x in done], pa.string()) for i in (1, 2)]
                for name in outputs:
                    if name == "decoded":
                        cols.append(pa.array([x[2].decode() for x in done], pa.string()))
                    else:
                        told = b" ".join(x[1] for x in done if x[0])
                        flat = np.fromstring(told, np.int32, sep=" ") if told else np.zeros(0, np.int32)
                        cols.append(pa.ListArray.from_arrays(np.cumsum([0, *(x[0] for x in done)]).astype(np.int32), pa.array(flat)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=schema.names)

    return rows.mapInArrow(run, schema)
