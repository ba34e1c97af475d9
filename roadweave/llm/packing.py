"""Cost-balanced packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Known(dict):
    """A cache of bounded size, and what did not fit in it, for as long as the texts at hand need it."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.beside = most, {}

    def __missing__(self, key):
        return self.beside[key]

    def keep(self, key, value, large: bool = False) -> None:
        (self if len(self) < self.most and not large else self.beside)[key] = value


class WordTokens:
    """Ids of byte strings by a word-splitting BPE tokenizer whose pieces never cross white space.

    The tokenizer splits at white space and drops it, so a text's ids are the
    ids of its words in turn.  Words and their letter, digit and sign runs are
    looked up in two caches of bounded size; the runs that these lack are
    encoded together, parted by spaces.  Words with characters outside Latin,
    where lower-casing and composing could depend on neighbours, and with
    ``<``, which may begin a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str, most_words: int = 240_000, most_runs: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_file(path)
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n").findall
        self._whole = regex.compile("[^\u0000-įı-ſ]|<").search
        self._words, self._runs = _Known(most_words), _Known(most_runs)

    def _ids(self, text: str) -> bytes:
        return array("H", self._encoder.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode_runs(self, runs: list[str]) -> None:
        for lo in range(0, len(runs), 256):
            part = runs[lo : lo + 256]
            got = self._encoder.encode(" ".join(part), add_special_tokens=False)
            ids, of = np.array(got.ids, "<u2"), np.array(got.word_ids, np.int64)
            if len(np.unique(of)) == len(part):  # each run is a word of its own to the tokenizer
                ends = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
                found = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            else:
                found = [self._ids(run) for run in part]
            for run, x in zip(part, found):
                self._runs.keep(run, x)

    def _learn(self, words: set[bytes]) -> None:
        """The ids of the words that are not known yet, worked out together: what can be is done on all of them joined."""
        self._words.beside.clear()
        self._runs.beside.clear()
        new = words.difference(self._words)
        plain = [w for w in new if w.isalpha()]  # of bytes: A-Z and a-z only
        rest = [w for w in new if not w.isalpha()]
        texts = b"\n".join(rest).decode("utf-8", "replace").split("\n") if rest else []
        odd = self._whole
        for word, text in zip(rest, texts):
            if odd(text):
                self._words.keep(word, self._ids(text), len(word) >= 64)
        mixed = [(word, text) for word, text in zip(rest, texts) if not odd(text)] if odd("".join(texts)) else list(zip(rest, texts))
        letters = b"\n".join(plain).lower().decode().split("\n") if plain else []
        pieces = self._split("\n".join([text for _, text in mixed]).lower())
        unknown = {run for run in letters if run not in self._runs}
        unknown.update(run for run in pieces if run != "\n" and run not in self._runs)
        self._encode_runs(sorted(unknown))
        known, beside, keep = self._runs, self._runs.beside, self._words.keep
        of_run = lambda run: known[run] if run in known else beside[run]
        for word, run in zip(plain, letters):
            keep(word, of_run(run), len(word) >= 64)
        found, at = [], 0
        for run in pieces:
            if run == "\n":
                keep(mixed[at][0], b"".join(found), len(mixed[at][0]) >= 64)
                found, at = [], at + 1
            else:
                found.append(of_run(run))
        if mixed:
            keep(mixed[at][0], b"".join(found), len(mixed[at][0]) >= 64)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [text.split() for text in texts]
        self._learn(set().union(*split))
        of_word = self._words.__getitem__
        return [np.frombuffer(b"".join(map(of_word, words)), "<u2") for words in split]


class Packer:
    """Packs the documents of one task, window by window.

    ``capacity`` tokens fill a sequence.  A document's whole multiples of it
    become sequences of their own.  The rests gather until they fill
    ``window`` sequences exactly (the last of them is cut there, its end goes
    to the next window).  Longest first, each rest goes to the sequence of
    least cost, ``linear * n + quadratic * n * n`` summed over its pieces,
    that has room for it whole; those that fit nowhere are cut to fill the
    room that is left.  So sequences are full.  What remains at the end of the
    task is cut into sequences of decreasing powers of two.
    """

    def __init__(self, first_id: int, capacity: int = 2048, window: int = 256, linear: float = 1.0, quadratic: float = 1 / 1024):
        self.next_id, self.capacity, self.window, self.linear, self.quadratic = first_id, capacity, window, linear, quadratic
        self.rests: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.waiting = 0

    def _piece(self, rest: tuple, n: int, sequence: int, offset: int) -> tuple:
        doc, start, ids, total = rest
        return doc, start, n, zlib.crc32(ids[:n].astype("<u4").tobytes()), total, sequence, offset

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        full = len(ids) // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            yield self._piece((doc, start, ids[start:], len(ids)), self.capacity, self.next_id, 0)
            self.next_id += 1
        room = self.window * self.capacity - self.waiting
        for a, b in ((full, min(len(ids), full + room)), (full + room, len(ids))):
            if b > a:
                self.rests.append((doc, a, ids[a:b], len(ids)))
                self.waiting += b - a
                if self.waiting == self.window * self.capacity:
                    yield from self._flush([self.capacity] * self.window)

    def end(self) -> Iterator[tuple]:
        rest = self.waiting % self.capacity
        tail = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        yield from self._flush([self.capacity] * (self.waiting // self.capacity) + tail)

    def _flush(self, room: list[int]) -> Iterator[tuple]:
        first, used, cost = self.next_id, [0] * len(room), [0.0] * len(room)
        self.next_id += len(room)
        heap = [(0.0, i) for i in range(len(room))]

        def put(rest: tuple, n: int, i: int) -> tuple:
            out = self._piece(rest, n, first + i, used[i])
            used[i] += n
            room[i] -= n
            cost[i] += self.linear * n + self.quadratic * n * n
            return out

        unfit = []
        for rest in sorted(self.rests, key=lambda r: -len(r[2])):
            n, aside, at = len(rest[2]), [], None
            while heap:
                _, i = heapq.heappop(heap)
                if room[i] >= n:
                    at = i
                    break
                if room[i]:
                    aside.append((cost[i], i))
            for x in aside:
                heapq.heappush(heap, x)
            if at is None:
                unfit.append(rest)
                continue
            yield put(rest, n, at)
            if room[at]:
                heapq.heappush(heap, (cost[at], at))
        order = sorted(range(len(room)), key=lambda i: cost[i])
        for doc, start, ids, total in unfit:
            while len(ids):
                while not room[order[0]]:
                    order.pop(0)
                i = order[0]
                n = min(room[i], len(ids))
                yield put((doc, start, ids, total), n, i)
                start, ids = start + n, ids[n:]
        self.rests, self.waiting = [], 0


@common.tidy
def _pack(batches, path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tokens, packer = common.kept(("tokens", path), partial(WordTokens, path)), Packer(TaskContext.get().partitionId() << 40, capacity)
    end = np.array([end_id], "<u2")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
    rows: list[tuple] = []
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        for first, texts in common.slices(batch, "text", 2 << 20):
            for k, ids in enumerate(tokens([text or b"" for text in texts])):
                rows += packer.add(docs[first + k], np.concatenate([ids, end]))
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
    rows += packer.end()
    if rows:
        yield batch_of(rows)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of the documents' token ids in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs``: doc_id LONG, text STRING; other columns are not read.
    ``tokenizer``: file of a word-splitting BPE tokenizer.  A text's ids plus
    ``end_id`` are cut into pieces that lie in sequences of ``capacity``
    tokens; see :class:`Packer`.  Each task packs its own partition, so
    nothing is shuffled, memory holds one window of sequences and one slice of
    texts, and a task that runs again after a lost executor packs the same
    rows.  sequence_id carries the partition in its upper bits.

    A null text counts as empty: its document has one token.  A null doc_id
    stays null; repeated rows are packed each on their own.  An empty table
    gives no pieces.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(partial(_pack, path=tokenizer, capacity=capacity, end_id=end_id), SCHEMA)
