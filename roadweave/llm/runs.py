"""Periodic runs of words: repeated k-grams mask the words that no run can hold, Main-Lorentz searches the rest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Words that are searched together: a slice ends at the first document beyond this many bytes of text.
SLICE_BYTES = 2 << 20


def gram_length(least_words: int, least_periods: int) -> int:
    """The k of the mask: a run of period q and length n repeats n - q consecutive words q places on; the smallest such overlap.

    From q * least_periods >= least_words on, the overlap only grows.
    """
    turn = -(-least_words // least_periods)
    return max(1, min(max(least_words, least_periods * q) - q for q in range(1, turn + 1)))


def surviving(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that occurs twice or more in its document; a collision of hashes only lets more words through."""
    n, out = len(words), np.zeros(len(words), bool)
    if n < k:
        return out
    m = n - k + 1
    h = doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):
        h = (h ^ (words[j : j + m].astype(np.uint64) + np.uint64(j + 1))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    _, which, times = np.unique(h[at], return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + k, -1)
    return np.cumsum(edge[:-1]) > 0


class Extensions:
    """Longest common extensions between places of a sequence, by names of all stretches of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n, self.names = len(symbols), [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        while 2 << (len(self.names) - 1) <= longest:
            last, step = self.names[-1], 1 << (len(self.names) - 1)
            if self.n < 2 * step:
                break
            pair = last[: self.n - 2 * step + 1] * (int(last.max()) + 1) + last[step : self.n - step + 1]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` on equal those from ``j`` on."""
        out = np.zeros(len(i), np.int64)
        for names, step in self._down():
            while True:
                a, b = i + out, j + out
                fits = (a < len(names)) & (b < len(names))
                same = fits & (names[np.where(fits, a, 0)] == names[np.where(fits, b, 0)])
                out[same] += step
                if step < self._top or not same.any():
                    break
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before ``i`` equal those before ``j``."""
        out = np.zeros(len(i), np.int64)
        for names, step in self._down():
            while True:
                a, b = i - out - step, j - out - step
                fits = (a >= 0) & (b >= 0)
                same = fits & (names[np.where(fits, a, 0)] == names[np.where(fits, b, 0)])
                out[same] += step
                if step < self._top or not same.any():
                    break
        return out

    @property
    def _top(self) -> int:
        return 1 << (len(self.names) - 1)

    def _down(self) -> Iterator[tuple[np.ndarray, int]]:
        return ((names, 1 << h) for h, names in reversed(list(enumerate(self.names))))


def runs_of(symbols: np.ndarray, first: np.ndarray, end: np.ndarray, least_words: int, least_periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all runs in the segments ``first`` to ``end`` of ``symbols``, by start, then period.

    Main-Lorentz: the sequence is halved again and again.  A run belongs to
    the highest cut that it meets, and reaches no further than the halves on
    both sides.  For every cut and period, the symbols that equal those one
    period on are counted to both sides of the cut (what lies right of it) and
    of one period before it (what lies left).  All cuts of a level are taken
    in one step.  ``symbols`` differ between segments.
    """
    none = np.empty(0, np.int64)
    if not len(first):
        return none, none, none
    n, sizes = len(symbols), end - first
    ext = Extensions(symbols, int(sizes.max()))
    segment = np.full(n + 1, -1, np.int64)
    segment[:n] = np.repeat(np.arange(len(first)), sizes)
    found = []
    half = 1
    while half < n:
        cut = np.arange(half, n, 2 * half)
        own = segment[cut]
        most = np.minimum(2 * half, sizes[own]) // least_periods
        cut, most = cut[most > 0], most[most > 0]
        if len(cut):
            step = max(1, (1 << 21) // int(most.max()))
            for lo in range(0, len(cut), step):  # bounded tables of cut and period
                c, m = cut[lo : lo + step], most[lo : lo + step]
                at = np.repeat(c, m)
                q = np.arange(1, len(at) + 1) - np.repeat(np.cumsum(m) - m, m)
                found += [_around(ext, symbols, at, q, least_words, least_periods), _around(ext, symbols, at - q, q, least_words, least_periods)]
        half *= 2
    if not found:
        return none, none, none
    start, length, period = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)  # of one stretch only the smallest period counts: the others are its multiples
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _around(ext: Extensions, symbols: np.ndarray, at: np.ndarray, q: np.ndarray, least_words: int, least_periods: int):
    """Stretches of period ``q`` around the places ``at``: those of enough words and periods."""
    n = len(symbols)
    inside = (at >= 0) & (at + q <= n)
    at, q = at[inside], q[inside]
    right = np.zeros(len(at), bool)
    ok = at + q < n
    right[ok] = symbols[at[ok]] == symbols[at[ok] + q[ok]]
    left = np.zeros(len(at), bool)
    ok = at > 0
    left[ok] = symbols[at[ok] - 1] == symbols[at[ok] + q[ok] - 1]
    some = right | left
    at, q = at[some], q[some]
    before, after = ext.backward(at, at + q), ext.forward(at, at + q)
    length = before + after + q
    keep = length >= np.maximum(least_words, least_periods * q)
    return (at - before)[keep], length[keep], q[keep]


def runs_of_documents(texts: list[list[bytes]], least_words: int, least_periods: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each list of words: (start, length, period) of its runs."""
    sizes = np.array([len(t) for t in texts], np.int64)
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
    doc, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    live = surviving(words, doc, gram_length(least_words, least_periods))
    at = np.flatnonzero(live)
    if not len(at):
        return [(at, at, at)] * len(texts)
    breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) > 0)) + 1
    first, end = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]])
    segment = np.repeat(np.arange(len(first)), end - first)
    symbols = segment * len(number) + words[at]  # no symbol in two segments, so no run spans them
    start, length, period = runs_of(symbols, first, end, least_words, least_periods)
    owner = doc[at[start]]
    start = at[start] - begin[owner]
    parts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(start[a:b], length[a:b], period[a:b]) for a, b in zip(parts[:-1], parts[1:])]


@common.tidy
def _search(batches, least_words: int, least_periods: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        body = names.index("pr_text")
        for first, texts in common.slices(batch, "pr_text", SLICE_BYTES):
            words = [(t or b"").split() for t in texts]
            found, counts, runs, collapsed = runs_of_documents(words, least_words, least_periods), [], [], []
            for w, (start, length, period) in zip(words, found):
                counts.append(len(w))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in zip(start.tolist(), length.tolist(), period.tolist())])
                if len(start):
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, start + period, 1)
                    np.add.at(edge, start + length, -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(w))
            rest = [batch.column(k).slice(first, len(texts)) for k in range(len(names)) if k != body]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            out = [pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*rest, *out], [*(c for c in names if c != "pr_text"), "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, text: str = "text", least_words: int = 6, least_periods: int = 4) -> DataFrame:
    """``docs`` without ``text``, plus n_words LONG, runs ARRAY of (start, length, period LONG) and collapsed STRING.

    Words are whatever stands between white space (space, \\t to \\r),
    numbered from 0.  A run is a stretch of words with smallest period q and
    at least ``least_words`` words and ``least_periods`` periods that no
    neighbouring word extends.  Runs come by start, then period; collapsed
    holds the words outside all runs and the first period of each, joined by
    one space, less those that another run covers beyond its first period.

    Every word of a run lies in a k-gram that its document has twice, where k
    is the smallest overlap of a run with itself one period on
    (:func:`gram_length`).  Only stretches of such words are searched, by
    Main-Lorentz, in n log(n) steps for each.  Each document is worked on
    alone, so nothing is shuffled, at any length and any number of copies.

    A null text has no words: n_words 0, no runs, collapsed ''.  Repeated rows
    each give a row, in any order.  An empty table stays empty.  Own columns
    called n_words, runs or collapsed are replaced; others come along.
    """
    rest = docs.drop("n_words", "runs", "collapsed")
    carried = [c for c in rest.columns if c != text]
    hidden = common.fresh(rest, *(f"pr_{k}" for k in range(len(carried))))
    read = rest.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(carried, hidden)], F.col(text).cast("binary").alias("pr_text"))
    kinds = [f"{h} {rest.schema[c].dataType.simpleString()}" for c, h in zip(carried, hidden)]
    found = read.mapInArrow(partial(_search, least_words=least_words, least_periods=least_periods), ", ".join([*kinds, "n_words long", f"runs {RUNS}", "collapsed string"]))
    return found.select(*[F.col(h).alias(c) for c, h in zip(carried, hidden)], "n_words", "runs", "collapsed")


def longest_run(runs: Column) -> Column:
    """The run of greatest length, of those the one of smallest start, then period; null without runs."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(key)


@F.pandas_udf(T.StringType())
def _repeated(text: pd.Series, seed: pd.Series) -> pd.Series:
    def change(t, h):
        if t is None or h is None or h != h:
            return None
        words, g = t.encode().split(), int(h) // 10  # bytes split at ASCII white space, as the words are defined
        n = len(words)
        if n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        return b" ".join(words).decode()

    return pd.Series([change(t, h) for t, h in zip(text, seed)], dtype=object)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), where every tenth document by crc32 of its id repeats its own words from some place on; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = h % 10 == 0
    planted = _repeated(F.when(changed, F.col("text")), F.when(changed, h))
    return docs.withColumn("text", F.when(changed, planted).otherwise(F.col("text")))


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, and SHA-256 of all runs and of the collapsed text.

    Without runs the four are null and runs_sha256 is that of the empty string.
    """
    found = find_runs(docs.select("doc_id", "text")).withColumn("top", longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") == 0, F.lit("")).otherwise(F.concat(F.concat_ws("\n", lines), F.lit("\n")))
    length, period = -F.col("top.less"), F.col("top.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
