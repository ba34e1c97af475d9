"""Language ID by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

GRAM = 4
HASHES = 2
#: Slots of the filter for each n-gram of the language that has the most.
SLOTS_EACH = 8
#: Rows of texts handled at once, in bytes: numpy holds a few dozen bytes for each.
SLICE = 1 << 19
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return common.kept("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def different(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, how often) of the different pairs."""
    grams, at = np.unique(h, return_inverse=True)
    pair, n = np.unique(doc * max(1, len(grams)) + at, return_counts=True)
    return pair // max(1, len(grams)), grams[pair % max(1, len(grams))], n


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram hash) of every n-gram of lower-cased letters, and the letters of each document.

    Runs of anything but letters are one space, also before and after a text.
    """
    parts = [f" {t.lower()} \0" for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    ends = np.cumsum([len(p) for p in parts]) - 1
    letter = letter_table()[codes]
    n_letters = np.bincount(doc[letter], minlength=len(texts))
    c = np.where(letter, codes, np.uint32(32))
    c[ends] = 0
    keep = c != 32
    keep[1:] |= c[:-1] != 32
    c, doc = c[keep].astype(np.uint64), doc[keep]
    if len(c) < GRAM:
        return doc[:0], c[:0], n_letters
    h, whole, n = np.zeros(len(c) - GRAM + 1, np.uint64), np.ones(len(c) - GRAM + 1, bool), len(c) - GRAM + 1
    for k in range(GRAM):
        h = (h * np.uint64(0x110001)) + c[k : k + n]
        whole &= c[k : k + n] != 0
    h = h[whole] * _ODD[0]
    return doc[:n][whole], h ^ (h >> np.uint64(29)), n_letters


def slots_of(h: np.ndarray, log2: int) -> list[np.ndarray]:
    return [((h * odd) >> np.uint64(64 - log2)).astype(np.int64) for odd in _ODD[:HASHES]]


@dataclass
class Model:
    """``table``: for each slot a bit for each language; ``false``: each language's rate of false positives."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray
    default: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        doc, h, letters = grams_of([t or "" for t in texts])
        at = slots_of(h, len(self.table).bit_length() - 1)
        total, n = np.bincount(doc, minlength=len(texts)), len(self.languages)
        hits = np.zeros((len(texts), n))
        for word in range(self.table.shape[1]):
            mask = self.table[at[0], word]
            for other in at[1:]:
                mask = mask & self.table[other, word]
            for bit in range(min(64, n - 64 * word)):
                has = (mask >> np.uint64(bit)) & np.uint64(1) == 1
                hits[:, 64 * word + bit] = np.bincount(doc[has], minlength=len(texts))
        hits = np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false)) if n else hits
        best = hits.argmax(axis=1) if n else np.zeros(len(texts), int)
        names, scores = [], []
        for i, b in enumerate(best.tolist()):
            if not letters[i] or not n:
                names.append("und")
                scores.append(0.0)
            else:
                s = float(hits[i].sum())
                names.append(self.languages[b if s else self.default])
                scores.append(float(hits[i, b]) / s if s else 0.0)
        unknown = (hits.sum(axis=1) == 0)[doc]
        return names, scores, np.bincount(different(doc[unknown], h[unknown])[0], minlength=len(texts)).tolist()


@common.tidy
def _count(batches) -> Iterator[pa.RecordBatch]:
    """(lang_no, gram, n): documents that hold an n-gram, added up in slices."""
    for batch in batches:
        languages = np.array(batch.column("lang_no").to_pylist(), np.int64)
        for first, texts in common.slices(batch, "text", SLICE):
            doc, h, _ = different(*grams_of(texts)[:2])  # a document counts once for an n-gram
            language, gram, n = different(languages[first + doc], h)
            yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], ["lang_no", "gram", "n"])


def fit(labelled: DataFrame, most_docs: int = 3000, least_share: float = 0.003, least_ratio: float = 0.3) -> Model:
    """A model from ``labelled`` (text, lang, and the hash LONG by which rows are sampled).

    About ``most_docs`` documents of each language are read, chosen by hash:
    the bound on the classifier's sample, the only one.  A language's filter
    takes the n-grams that ``least_share`` of its sampled documents hold, if
    they are at least ``least_ratio`` times as common in it as in any other
    language, so that words quoted in another language don't count as its own.
    Null texts and languages are not learned from.
    """
    spark = labelled.sparkSession
    known = labelled.where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts, key=lambda s: [ord(c) for c in s])
    rows = [(s, i, int(min(1.0, most_docs / counts[s]) * (1 << 30)), float(min(most_docs, counts[s]))) for i, s in enumerate(languages)]
    bounds = spark.createDataFrame(rows, "lang string, lang_no int, below long, docs double")
    sample = known.join(F.broadcast(bounds), "lang").where(F.pmod("hash", F.lit(1 << 30)) < F.col("below"))
    grams = sample.select("lang_no", "text").mapInArrow(_count, "lang_no int, gram long, n long").groupBy("lang_no", "gram").agg(F.sum("n").alias("n"))
    rated = grams.join(F.broadcast(bounds), "lang_no").groupBy("gram").agg(F.collect_list(F.struct("lang_no", (F.col("n") / F.col("docs")).alias("rate"))).alias("of"))
    own = F.filter("of", lambda x: (x["rate"] >= least_share) & (x["rate"] >= least_ratio * F.array_max(F.transform("of", lambda y: y["rate"]))))
    found = rated.select("gram", F.explode(own).alias("x")).select("gram", "x.lang_no").toArrow()  # of a sample of bounded size
    gram, of = found.column("gram").to_numpy().view(np.uint64), found.column("lang_no").to_numpy()
    log2 = max(12, int(SLOTS_EACH * np.bincount(of, minlength=1).max()).bit_length())
    table, bits = np.zeros((1 << log2, max(1, -(-len(languages) // 64))), np.uint64), []
    for i in range(len(languages)):
        for at in slots_of(gram[of == i], log2):
            table[at, i // 64] |= np.uint64(1 << (i % 64))
        bits.append(np.count_nonzero((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)))
    false = (np.array(bits) / (1 << log2)) ** HASHES
    default = max(range(len(languages)), key=lambda i: (counts[languages[i]], -i), default=0)
    return Model(languages, table, false, default)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is 2 modulo 4; also for null, which is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, n_grams: bool = False, **settings) -> DataFrame:
    """``docs`` plus held_out BOOLEAN, lang_pred STRING, score DOUBLE (columns of these names are replaced).

    A filter holds, in the bits of each slot, all languages that contain an
    n-gram of four letters or word borders; two slots and-ed give an n-gram's
    languages.  It has eight slots, to a power of two, for each n-gram of the
    language that has the most.  Counting bits over all n-grams of the whole
    text, less those expected by chance, gives hits for each language; the
    language of most hits wins (ties: first in code points) and its share of
    all hits is the score.  The filter is learned from doc_id-hashed rows that
    are not held out; see :func:`fit` for its bound.  With 100 000 n-grams it
    takes 8 MB for each 64 languages; it is sent to every executor once.  With ``n_grams`` a
    column n_grams LONG tells how many different n-grams a text without any hit has.

    ``und``, score 0: null text, no letter, or nothing to learn from.  Without
    any hit: the most frequent language, score 0.  Rows with null lang are
    predicted but not learned from; repeated rows are predicted alike; an
    empty table stays empty.
    """
    docs = docs.drop("held_out", "lang_pred", "score", *(["n_grams"] if n_grams else []))
    spark = docs.sparkSession
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.where("not held_out").select("text", "lang", F.xxhash64("doc_id", "text").alias("hash")), **settings)
    shared = spark.sparkContext.broadcast(model)

    @common.tidy
    def predict(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, looked = [], [], []
            for _, texts in common.slices(batch, "text", SLICE):
                got = shared.value.predict(texts)
                names += got[0]
                scores += got[1]
                looked += got[2]
            more = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())} | ({"n_grams": pa.array(looked, pa.int64())} if n_grams else {})
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("n_grams", T.LongType())] if n_grams else [])])
    return rows.mapInArrow(predict, schema)
