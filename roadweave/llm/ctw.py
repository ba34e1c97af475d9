"""Language-model scoring by context-tree weighting over byte contexts, beside a unigram base."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of context of the deepest nodes.  A gram packs them with the byte that follows in 8 * (DEPTH + 1) bits.
DEPTH = 5
#: Bytes of context below which one task builds the subtree, and about how many rows of subtrees a task holds at once.
HEAD, CHUNK = 3, 200_000
SLICE = 4 << 20
OTHER = 256
_LN10 = math.log(10)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.lower().split()


def grams_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The gram at every byte of the documents' streams, and each stream's length.

    A stream is the words, each with one byte after it: a space, or the end
    mark (line feed) after the last; without words it is the end mark alone.
    Words hold neither, so streams and token sequences are one to one.  Before
    a stream stand DEPTH end marks.
    """
    streams = [b" ".join(w) + b"\n" for w in words]
    n = np.array([len(s) for s in streams])
    a = np.frombuffer(b"".join(b"\n" * DEPTH + s for s in streams), np.uint8).astype(np.uint64)
    g = np.zeros(max(0, len(a) - DEPTH), np.uint64)
    for k in range(DEPTH + 1):
        g = (g << np.uint64(8)) | a[k : len(a) - DEPTH + k]
    inside = np.ones(len(g), bool)  # grams that end in the marks before the next stream are none
    for k, end in enumerate(np.cumsum(n + DEPTH)[:-1]):
        inside[end - DEPTH : end] = False
    return g[inside], n


@common.tidy
def _counts(batches) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 words of training documents by hash, 1 grams of all documents with their count in training."""
    held = {0: [], 1: []}

    def merged(kind: int) -> pa.RecordBatch:
        key, n = np.concatenate([x[0] for x in held[kind]]), np.concatenate([x[1] for x in held[kind]])
        keys, at = np.unique(key, return_inverse=True)
        held[kind] = [(keys, np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64))]
        return len(keys)

    def batch_of(kind: int) -> pa.RecordBatch:
        keys, n = held[kind][0]
        held[kind] = []
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    for batch in batches:
        trains = batch.column("trains").to_pylist()
        for first, texts in common.slices(batch, "text", SLICE):
            words = [words_of(t) for t in texts]
            learned = [w for w, t in zip(words, trains[first:]) if t]
            flat = [x for w in learned for x in w]
            held[0].append(np.unique(np.fromiter(map(common.word_hash(), flat), np.uint64, len(flat)), return_counts=True))
            for some, weight in ((learned, 1), ([w for w, t in zip(words, trains[first:]) if not t], 0)):
                if some:
                    g, n = np.unique(grams_of(some)[0], return_counts=True)
                    held[1].append((g, n * weight))
            for kind in (0, 1):
                if sum(len(x[0]) for x in held[kind]) > 1_500_000 and merged(kind) > 750_000:
                    yield batch_of(kind)
    for kind in (0, 1):
        if held[kind]:
            merged(kind)
            yield batch_of(kind)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series eight above x."""
    y, shift = x + 8, np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_HALVES, _WHOLES = log_gamma(np.arange(8192) + 0.5), log_gamma(np.arange(8192) + 1.0)


def _log_gamma_at(x: np.ndarray, known: np.ndarray, shift: float) -> np.ndarray:
    """log_gamma(x + shift) of whole numbers x, the small ones looked up in ``known``."""
    out, large = known[np.minimum(x, len(known) - 1).astype(np.int64)], x >= len(known)
    out[large] = log_gamma(x[large] + shift)
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov estimate of a sequence with so many zeros and ones."""
    return _log_gamma_at(zeros, _HALVES, 0.5) + _log_gamma_at(ones, _HALVES, 0.5) - _log_gamma_at(zeros + ones, _WHOLES, 1.0) - math.log(math.pi)


def tree_bits(path: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability of a one at each leaf of a context tree, weighted over all its depths; :func:`byte_model` does so in parts.

    ``path``: DEPTH fields of 9 bits, the most recent byte highest; OTHER in a
    field stands for all bytes without a node of their own, and ends the path.
    A node's weighted probability is half its own estimate plus half the
    product of its children's; going down, each node contributes its own
    prediction by its share of that sum, given what it has seen.
    """
    levels = []  # from the leaves up: (node of each item below, ended, zeros, ones, ln weighted)
    key, z, o, w = path, zeros.astype(float), ones.astype(float), kt(zeros.astype(float), ones.astype(float))
    for d in range(DEPTH, 0, -1):
        shift = np.uint64(9 * (DEPTH - d))
        up = key >> (shift + np.uint64(9)) << (shift + np.uint64(9))
        ended = np.zeros(len(key), bool)  # the path ended above this level: the item stands for itself
        for k in range(d - 1):
            ended |= ((key >> np.uint64(9 * (DEPTH - 1 - k))) & np.uint64(511)) == OTHER
        parents, at = np.unique(up, return_inverse=True)
        pz, po = np.bincount(at, z, len(parents)), np.bincount(at, o, len(parents))
        below = np.bincount(at, w, len(parents))
        alone = np.zeros(len(parents), bool)
        alone[at[ended]] = True
        own = kt(pz, po)
        mixed = np.logaddexp(own, below) - math.log(2)
        pw = np.where(alone, below, mixed)
        stop = np.where(alone, 0.0, np.exp(own - math.log(2) - mixed))
        levels.append((at, pz, po, stop))
        key, z, o, w = parents, pz, po, pw
    rest, found = np.ones(len(key)), np.zeros(len(key))
    for at, pz, po, stop in reversed(levels):
        found = found + rest * stop * (po + 0.5) / (pz + po + 1)
        rest = rest * (1 - stop)
        found, rest = found[at], rest[at]
    return found + rest * (ones + 0.5) / (zeros + ones + 1)


def _low(n_bytes: int) -> int:
    return (1 << (8 * n_bytes)) - 1


def _mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted, share of its own estimate) of nodes whose children's ln weighted add up to ``below``."""
    own = kt(zeros, ones) - math.log(2)
    mixed = np.logaddexp(own, below - math.log(2))
    return mixed, np.exp(own - mixed)


def _subtrees(gram: np.ndarray, n: np.ndarray, k: int) -> tuple:
    """The nodes of bit ``k`` from depth DEPTH up to HEAD: those of depth HEAD, and every level's from the deepest up.

    A node is its context's bytes, the most recent lowest, above the bits of
    the byte before bit k behind a leading one.
    """
    sym = gram & np.uint64(255)
    one = (sym >> np.uint64(7 - k)) & np.uint64(1) == 1
    node = (gram & ~np.uint64(255)) | ((np.uint64(256) | sym) >> np.uint64(8 - k))
    zeros, ones, weighted, levels = np.where(one, 0, n).astype(float), np.where(one, n, 0).astype(float), None, []
    for d in range(DEPTH, HEAD - 1, -1):
        node, at = np.unique(node & np.uint64(_low(d + 1)), return_inverse=True)
        zeros, ones = np.bincount(at, zeros, len(node)), np.bincount(at, ones, len(node))
        if d == DEPTH:
            weighted, stop = kt(zeros, ones), np.ones(len(node))
        else:
            weighted, stop = _mixed(zeros, ones, np.bincount(at, weighted, len(node)))
        levels.append((at, zeros, ones, stop))
    return node, zeros, ones, weighted, one, levels


def _heads(batches) -> Iterator[pa.RecordBatch]:
    """(node, zeros, ones, weighted) of the nodes of depth HEAD; rows come sorted by head."""
    for t in _whole_heads(batches):
        gram, n = t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy()
        for k in range(8):
            node, zeros, ones, weighted, _, _ = _subtrees(gram, n, k)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *map(pa.array, (zeros, ones, weighted))], ["node", "zeros", "ones", "weighted"])


def _upper(batches) -> Iterator[pa.RecordBatch]:
    """(node, zeros, ones, weighted, stop, guess) of nodes whose children's ln weighted have been added up."""
    for b in batches:
        zeros, ones, below = (b.column(c).to_numpy() for c in ("zeros", "ones", "below"))
        weighted, stop = _mixed(zeros, ones, below)
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("zeros"), b.column("ones"), *map(pa.array, (weighted, stop, (ones + 0.5) / (zeros + ones + 1)))], ["node", "zeros", "ones", "weighted", "stop", "guess"])


def _leaves(batches) -> Iterator[pa.RecordBatch]:
    """(gram, n, ln) of every gram, from rows sorted by head: grams, and heads (n null) with what lies above them."""
    for t in _whole_heads(batches):
        is_head = t.column("n").is_null().to_numpy()
        key, found, rest = t.column("gram").to_numpy().view(np.uint64), t.column("found").to_numpy()[is_head], t.column("rest").to_numpy()[is_head]
        order = np.argsort(key[is_head])
        heads, found, rest = key[is_head][order], found[order], rest[order]
        gram, n = key[~is_head], t.column("n").drop_null().to_numpy()
        ln = np.zeros(len(gram))
        for k in range(8):
            node, _, _, _, one, levels = _subtrees(gram, n, k)
            at = np.searchsorted(heads, node)
            p, left = found[at], rest[at]
            for at, zeros, ones, stop in reversed(levels):
                p = (p + left * stop * (ones + 0.5) / (zeros + ones + 1))[at]
                left = (left * (1 - stop))[at]
            ln += np.log(np.where(one, p, 1 - p))
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n), pa.array(ln)], ["gram", "n", "ln"])


def _whole_heads(batches) -> Iterator[pa.Table]:
    """Runs of rows sorted by head, none of which parts the rows of one head."""
    held, size, due = [], 0, CHUNK
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= due:
            t = pa.Table.from_batches(held)
            head = t.column("head").to_numpy()
            cut = int(np.searchsorted(head, head[-1]))
            if cut:
                yield t.slice(0, cut)
            held, size = t.slice(cut).to_batches(), len(t) - cut
            due = max(CHUNK, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


def byte_model(grams: DataFrame) -> DataFrame:
    """(gram LONG, n LONG, ln DOUBLE): the model's ln probability of each gram's last byte after the DEPTH before it.

    ``grams``: (key, n) of the whole corpus, n counted in training.  Each of
    the eight bits of a byte, given those before it, has its tree, and every
    context has its node, however rare and at any size; what training never
    held predicts one half.  The subtrees below the contexts of HEAD bytes are
    built one beside the other; their counts and weighted probabilities are
    added up level by level to the roots.  The shares of the nodes above then
    go down to the subtrees, which give the probabilities.  The rows of one
    head are held by one task, 256 ** (DEPTH - HEAD + 1) at most.
    """
    head = lambda gram: F.shiftright(gram, 8).bitwiseAND(F.lit(_low(HEAD)).cast("long"))
    up = lambda d: F.col("node").bitwiseAND(F.lit(_low(d + 1)).cast("long"))
    entries = grams.select(head(F.col("key")).alias("head"), F.col("key").alias("gram"), "n")
    level = common.stored(entries.repartition("head").sortWithinPartitions("head").mapInArrow(_heads, "node long, zeros double, ones double, weighted double"), "heads")
    heads, above = level, []
    for d in range(HEAD - 1, -1, -1):
        summed = level.groupBy(up(d).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        level = common.stored(summed.mapInArrow(_upper, "node long, zeros double, ones double, weighted double, stop double, guess double"), f"nodes-{d}")
        above.append(level.select(F.col("node").alias("of"), "stop", "guess"))
    down = heads.select("node", F.lit(0.0).alias("found"), F.lit(1.0).alias("rest"))
    for d, nodes in enumerate(reversed(above)):
        nodes = F.broadcast(nodes) if d < 2 else nodes  # 255 and 255 * 256 rows at most
        share = F.col("rest") * F.col("stop")
        down = down.join(nodes, up(d) == F.col("of")).select("node", (F.col("found") + share * F.col("guess")).alias("found"), (F.col("rest") - share).alias("rest"))
    rows = entries.select("head", "gram", "n", F.lit(None).cast("double").alias("found"), F.lit(None).cast("double").alias("rest"))
    rows = rows.union(down.select(head(F.col("node")), "node", F.lit(None).cast("long"), "found", "rest"))
    return rows.repartition("head").sortWithinPartitions("head").mapInArrow(_leaves, "gram long, n long, ln double")


@dataclass
class Table:
    """A hash table of numpy arrays: LONG keys, float values; a full slot's successor is tried next."""

    keys: np.ndarray
    values: np.ndarray
    full: np.ndarray
    longest: int

    @staticmethod
    def slot(keys: np.ndarray, mask: int) -> np.ndarray:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(mask)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        size = 1 << max(4, (2 * len(keys)).bit_length())
        out = cls(np.zeros(size, np.uint64), np.zeros(size, np.float64), np.zeros(size, bool), 0)
        left, at = np.arange(len(keys)), cls.slot(keys, size - 1)
        while len(left):
            out.longest += 1
            free = ~out.full[at]
            slots, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            out.keys[slots], out.values[slots], out.full[slots] = keys[left[placed]], values[left[placed]], True
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)
        return out

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether found)."""
        values, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
        left, at = np.arange(len(keys)), self.slot(keys, len(self.keys) - 1)
        for _ in range(self.longest):
            hit = self.full[at] & (self.keys[at] == keys)
            values[left[hit]], found[left[hit]] = self.values[at[hit]], True
            on = self.full[at] & ~hit
            left, at, keys = left[on], (at[on] + 1) & (len(self.keys) - 1), keys[on]
            if not len(left):
                break
        return values, found


def _count_of_most(counts: DataFrame, most: int) -> int:
    """The least count, 0 or a power of two, that no more than ``most`` rows of ``counts`` (n) reach."""
    by = counts.groupBy(F.when(F.col("n") > 0, F.floor(F.log2(F.col("n").cast("double")))).otherwise(-1).alias("p")).count()
    powers = {int(r[0]): r[1] for r in by.collect()}
    power = next(p for p in range(-1, 65) if sum(k for q, k in powers.items() if q >= p) <= most)
    return 1 << power if power >= 0 else 0


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is 2 modulo 7; also for null, which is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def score_documents(docs: DataFrame, most_entries: int = 2_000_000, most_words: int = 300_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    Learned from the rows that are not held out, whole.  Tokens: the words,
    A-Z lower-cased, and one end.  base_score: log10 probability by add-one
    unigram counts.  score: log10 probability of the token sequence by
    context-tree weighting, see :func:`byte_model` and :func:`grams_of`;
    bits_per_byte is its code length over the stream's bytes.

    One pass counts words and grams, combined in each task; counts meet in an
    aggregation.  The byte model has every context of the training rows.  Its
    ``most_entries`` most frequent grams and the ``most_words`` most frequent
    words are broadcast; a second pass scores with them, and the counts of the
    rarer words and the probabilities of the rarer grams come by a join, so the
    two bounds change no score.  Words are told apart by 64-bit hash.

    Null texts count as empty, one token.  Null doc_ids are held out.  Rows
    with equal doc_id and text are scored alike and returned once each.
    Without training rows, N and V are 0 and the byte model is uniform.  An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    counted = rows.select("text", (~F.col("held_out")).alias("trains")).mapInArrow(_counts, "kind int, key long, n long")
    counts = common.stored(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words, grams = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    ends = rows.where("not held_out").count()
    seen, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens, vocabulary = total + ends, seen + (ends > 0)

    word_cut = _count_of_most(words, most_words)
    frequent = words.where(F.col("n") >= word_cut).toArrow()
    by_word = Table.of(frequent.column(0).to_numpy().view(np.uint64), frequent.column(1).to_numpy().astype(float))
    model = common.stored(byte_model(grams), "byte-model")
    gram_cut = _count_of_most(model, most_entries)
    frequent = model.where(F.col("n") >= gram_cut).select("gram", "ln").toArrow()
    by_gram = Table.of(frequent.column(0).to_numpy().view(np.uint64), frequent.column(1).to_numpy())
    shared = spark.sparkContext.broadcast((by_word, by_gram))

    @common.tidy
    def score(batches) -> Iterator[pa.RecordBatch]:
        word_table, gram_table = shared.value
        names = ["doc_id", "mark", "kind", "key", "tokens", "known", "logs", "held_out", "ln", "bytes"]
        for batch in batches:
            ids, marks, held = batch.column("doc_id"), batch.column("mark"), batch.column("held_out")
            for first, texts in common.slices(batch, "text", SLICE // 4):
                split = [words_of(t) for t in texts]
                n = np.array([len(w) for w in split])
                of = np.repeat(np.arange(len(split)), n)
                hashes = np.fromiter(map(common.word_hash(), (x for w in split for x in w)), np.uint64, int(n.sum()))
                c, found = word_table.get(hashes)
                known, logs = np.bincount(of[found], minlength=len(split)), np.bincount(of[found], np.log10(c[found] + 1), len(split))
                g, size = grams_of(split)
                ln, in_table = gram_table.get(g)
                doc = np.repeat(np.arange(len(split)), size)[~in_table]
                ln = np.add.reduceat(ln, np.cumsum(size) - size)
                at, kind, key, times = [np.arange(len(split))], [np.zeros(len(split), np.int32)], [np.zeros(len(split), np.uint64)], [n]
                for what, d, k in ((1, of[~found], hashes[~found]), (2, doc, g[~in_table])):
                    rare, of_rare = np.unique(np.rec.fromarrays([d, k], names="d,k"), return_counts=True)
                    at, kind, key, times = [*at, rare["d"]], [*kind, np.full(len(rare), what, np.int32)], [*key, rare["k"]], [*times, of_rare]
                at, none = pa.array(np.concatenate(at) + first, pa.int64()), np.zeros(sum(map(len, at)) - len(split))
                columns = [np.concatenate(kind), np.concatenate(key).view(np.int64), np.concatenate(times).astype(np.int64), np.concatenate([known, none]).astype(np.int64), np.concatenate([logs, none])]
                tail = [np.concatenate([ln, none]), np.concatenate([size, none]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([ids.take(at), marks.take(at), *map(pa.array, columns), held.take(at), *map(pa.array, tail)], names)

    marked = rows.withColumn("mark", F.xxhash64("text"))
    parts = common.stored(marked.mapInArrow(score, "doc_id long, mark long, kind int, key long, tokens long, known long, logs double, held_out boolean, ln double, bytes long"), "lm-scores")
    shared.destroy()  # the scores are stored; workers give the tables back
    heads = parts.where("kind = 0").drop("kind", "key")
    values = words.where(F.col("n") < word_cut).select(F.lit(1).alias("kind"), "key", F.log10(F.col("n") + 1).alias("value"))
    values = values.union(model.where(F.col("n") < gram_cut).select(F.lit(2), "gram", "ln"))
    rare = parts.where("kind > 0").select("doc_id", "mark", "kind", "key", "tokens").join(values, ["kind", "key"])
    sum_of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    of_value = F.col("tokens") * F.col("value")
    rare = rare.groupBy("doc_id", "mark").agg(sum_of(1, F.col("tokens")).alias("more"), sum_of(1, of_value).alias("more_logs"), sum_of(2, of_value).alias("more_ln"))
    copies = heads.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    rare = rare.join(copies, (rare["doc_id"].eqNullSafe(copies["doc_id"])) & (rare["mark"] == copies["mark"])).select(rare["doc_id"].alias("rd"), rare["mark"].alias("rm"), (F.col("more") / F.col("copies")).cast("long").alias("more"), *[(F.col(c) / F.col("copies")).alias(c) for c in ("more_logs", "more_ln")])
    whole = heads.join(rare, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("mark") == F.col("rm")), "left").withColumn("ln", F.col("ln") + F.coalesce("more_ln", F.lit(0.0)))
    end_log, base = math.log10(ends + 1), math.log10(train_tokens + vocabulary + 1)
    n_tokens = F.col("tokens") + 1
    return whole.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + end_log - n_tokens * base).alias("base_score"), (F.col("ln") / _LN10).alias("score"),
        (-F.col("ln") / math.log(2) / F.col("bytes")).alias("bits_per_byte"),
    )
