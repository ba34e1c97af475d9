"""MinHash near-dedup: bottom-k sketches of one hash function, inverted lists, union-sketch filter, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: Lists of a set by which it first meets others.
FIRST_LISTS = 2
#: Sets that may hold a hash whose pairs are counted one by one.
SPARSE = 24
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words, A-Z lower-cased; of fewer words, of all of them; of none, nothing."""
    words = text.lower().split()  # of bytes: A-Z only, and the six white-space characters only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(common.word_hash(), words), np.uint64, len(words))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _ODD + w[i : len(w) - k + 1 + i]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


@lru_cache(maxsize=None)
def _quantile(union: int, k: int, percent: int, miss: float) -> int:
    """The most ``m`` such that the ``k`` smallest hashes of a union of that size hold fewer than ``m`` common ones with a chance of ``miss`` at most.

    The similarity is ``percent``; the draw is without replacement, so small unions need more.
    """
    common_ = -(-union * percent // 100)
    if union <= k:
        return common_
    logs = lambda n, x: lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1)
    all_, below = logs(union, k), 0.0
    for m in range(max(0, k - union + common_), k + 1):
        below += np.exp(logs(common_, m) + logs(union - common_, k - m) - all_)
        if below > miss:
            return m
    return k


def _rounded(union: int, k: int) -> int:
    """Large unions on a coarse grid, upwards, so that few quantiles are computed; the quantile falls slowly with the size."""
    step = max(1, union // (4 * k))
    return -(-union // step) * step


@lru_cache(maxsize=1 << 16)
def least_shared(size: int, k: int, percent: int, miss: float) -> int:
    """Hashes that the sketch of a set of ``size`` shares with that of any set linked with it, but for a chance of ``miss``."""
    most = size * 100 // percent
    tries = {size, most, *(size + (most - size) * i // 8 for i in range(1, 8))}
    return min(-(-size * percent // 100), *(_quantile(_rounded(u, k), k, percent, miss) for u in tries))


@common.tidy
def _sketches(batches, k: int, percent: int, miss: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column("doc_id")
        for first, texts in common.slices(batch, "text"):
            sets = [shingle_set(t) for t in texts]
            low = [s[:k] for s in sets]
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*low, np.empty(0, np.uint64)]).view(np.int64)))
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            tags = pa.array(map(tag_of, prints), pa.int64())
            yield pa.RecordBatch.from_arrays([docs.slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([least_shared(len(s), k, percent, miss) for s in sets], pa.int32()), pa.array(prints, pa.binary()), tags, lists], ["doc_id", "n_shingles", "least", "print", "tag", "sketch"])


def tag_of(digest: bytes) -> int:
    """What tells apart the sets of one doc_id."""
    return int.from_bytes(digest[:8], "big", signed=True)


@common.tidy
def _full_sets(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id")
        for first, texts in common.slices(batch, "text"):
            sets = [shingle_set(t) for t in texts]
            tags = pa.array([tag_of(xxhash.xxh3_128_digest(x.tobytes())) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), tags, pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["id", "tag", "full"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes every two of the sets share, as a square.

    Hashes in up to ``SPARSE`` sets count pair by pair, the others as columns
    of a product taken in blocks; so memory is bounded.
    """
    n = len(sets)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    row, times = np.repeat(np.arange(n), [len(s) for s in sets]), np.bincount(at)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    starts, out = np.cumsum(times) - times, np.zeros((n, n), np.float32)
    for k in range(2, min(SPARSE, n) + 1):
        first, (i, j) = starts[times == k], np.triu_indices(k, 1)
        for lo in range(0, len(first), 1 << 16):
            held = row[first[lo : lo + (1 << 16), None] + np.arange(k)]
            out += np.bincount((held[:, i] * n + held[:, j]).ravel(), minlength=n * n).reshape(n, n).astype(np.float32)
    out += out.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    many = times > SPARSE
    column = np.cumsum(many) - 1
    row, at = row[many[at]], column[at[many[at]]]
    width = max(64, (1 << 22) // n)
    for lo in range(0, int(many.sum()), width):
        i, j = np.searchsorted(at, (lo, lo + width))
        held = np.zeros((n, min(width, int(many.sum()) - lo)), np.float32)
        held[row[i:j], at[i:j] - lo] = 1
        product = held @ held.T
        np.fill_diagonal(product, 0)
        out += product
    return out


@lru_cache(maxsize=1 << 16)
def least_in_union(a: int, b: int, k: int, percent: int, miss: float) -> int:
    """Hashes in the union's sketch that are common to two linked sets of ``a`` and ``b``, but for a chance of ``miss``.

    The union holds the larger set, and at the least similarity that links as many as there are to share.
    """
    low, high = max(a, b), max(max(a, b), (a + b) * 100 // (100 + percent))
    return min(_quantile(_rounded(u, k), k, percent, miss) for u in {low, high, *(low + (high - low) * i // 4 for i in range(1, 4))})


def union_estimates(low: list[np.ndarray], i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sketches: the size of their union's sketch, the ``k`` smallest hashes of both together, and how many of these both hold."""
    size, both = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for lo in range(0, len(i), 4096):
        pairs = list(zip(i[lo : lo + 4096], j[lo : lo + 4096]))
        width = max(len(low[a]) + len(low[b]) for a, b in pairs)
        merged = np.full((len(pairs), width), np.iinfo(np.uint64).max, np.uint64)
        ends = np.empty(len(pairs), np.int64)
        for r, (a, b) in enumerate(pairs):
            n = len(low[a])
            ends[r] = n + len(low[b])
            merged[r, :n], merged[r, n : ends[r]] = low[a], low[b]
        merged.sort(axis=1)
        inside = np.arange(width)[None, :] < ends[:, None]
        again = np.zeros(merged.shape, bool)
        again[:, 1:] = (merged[:, 1:] == merged[:, :-1]) & inside[:, 1:]
        new = inside & ~again
        rank = np.cumsum(new, axis=1)
        size[lo : lo + 4096] = np.minimum(rank[:, -1], k)
        both[lo : lo + 4096] = (again & (rank <= k)).sum(axis=1)
    return size, both


def passing(sets: list[np.ndarray], least: np.ndarray, k: int, percent: int, miss: float) -> np.ndarray:
    """The sets that some other one may be linked with, by the union's sketch.

    Two sketches share at least what their union's sketch shares, so pairs that
    share fewer than ``least`` are out.  Of the rest each set asks those it
    shares most with first, one, then two, and so on up to 16 at once.  A set
    that none of these links and that has more to ask counts as passing: then the full comparison costs less.
    """
    low = [s[:k] for s in sets]
    shared = overlaps(low)
    shared[shared < np.maximum(least[:, None], least[None, :])] = 0
    np.fill_diagonal(shared, 0)
    found, open_ = np.zeros(len(sets), bool), np.flatnonzero(shared.any(axis=1))
    for ask in (1, 2, 4, 8, 16):
        ask = min(ask, len(sets))
        best = np.argpartition(-shared[open_], ask - 1, axis=1)[:, :ask]
        i, j = np.repeat(open_, ask), best.ravel()
        asked = shared[i, j] > 0
        i, j = i[asked], j[asked]
        _, both = union_estimates(low, i, j, k)
        ok = both >= np.array([least_in_union(*sorted((len(sets[a]), len(sets[b]))), k, percent, miss) for a, b in zip(i.tolist(), j.tolist())], np.int64)
        found[i[ok]] = found[j[ok]] = True
        shared[i, j] = shared[j, i] = 0
        open_ = np.flatnonzero(~found & shared.any(axis=1))
        if not len(open_):
            break
    found[open_] = True
    return np.flatnonzero(found)


def linked(sets: list[np.ndarray], least: np.ndarray, k: int, percent: int, miss: float = 1e-7) -> np.ndarray:
    """For each set the first one that it is connected with: sets that pass the estimate from their unions' sketches are compared in full."""
    root = np.arange(len(sets))
    some = passing(sets, least, k, percent, miss)
    if not len(some):
        return root
    size = np.array([len(sets[i]) for i in some], np.float64)
    shared = overlaps([sets[i] for i in some]).astype(np.float64)
    link = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
    label = np.arange(len(some))
    while True:
        near = np.where(link, label[None, :], len(some)).min(axis=1)
        near = np.minimum(label, near)
        near = near[near]
        if (near == label).all():
            break
        label = near
    root[some] = some[label]
    return root


@common.tidy
def _forests(batches, k: int, percent: int, miss: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of sets connected within a group; rows come sorted by (value, part, id), and a group holds a bounded number of sets."""
    held: dict = {"of": None, "id": [], "least": [], "set": []}

    def links() -> pa.RecordBatch | None:
        if len(held["id"]) < 2:
            return None
        ids = np.array(held["id"], np.int64)
        root = linked(held["set"], np.array(held["least"]), k, percent, miss)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[root[moved]]), pa.array(ids[moved])], ["a", "b"]) if len(moved) else None

    for batch in batches:
        value, part, ids, least = (batch.column(c).to_numpy() for c in ("value", "part", "id", "least"))
        full = batch.column("full")
        for i in range(batch.num_rows):
            if held["of"] != (value[i], part[i]):
                if (found := links()) is not None:
                    yield found
                held = {"of": (value[i], part[i]), "id": [], "least": [], "set": []}
            held["id"].append(ids[i])
            held["least"].append(least[i])
            held["set"].append(np.frombuffer(full[i].as_py(), "<u8"))
    if (found := links()) is not None:
        yield found


def _connected(rows: DataFrame, k: int, percent: int, miss: float, name: str) -> DataFrame:
    """Links (a, b) within the groups (value, part) of ``rows`` (with id, least, full)."""
    dealt = rows.select("value", "part", "id", "least", "full").repartition("value", "part").sortWithinPartitions("value", "part", "id")
    return common.stored(dealt.mapInArrow(partial(_forests, k=k, percent=percent, miss=miss), "a long, b long").distinct(), name)


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 128, miss: float = 1e-7, chunk: int = 1024, chunk_mb: int = 16) -> DataFrame:
    """A row for each document: doc_id LONG, n_shingles LONG, component_id LONG, kept BOOLEAN.

    Documents link when their sets of five-word shingles have a Jaccard
    similarity of ``percent`` or more; component_id is the smallest doc_id
    reachable by links, kept whether that is the document's own.

    * Each set is sketched by its ``k`` smallest hashes.  Equal sets (by
      128-bit fingerprint of the whole set) are one node from here on.
    * Linked sets share so many hashes of their sketches: of the ``k`` in
      the union's sketch, those common follow a hypergeometric law, 96 of 128
      on average at 0.75, and more than ``least_shared`` of the set's size but for
      a chance of ``miss``; sketches that hold the whole union need no chance.
      Hashes that occur once are dropped; sets with fewer than ``least`` left
      leave, which are nearly all that have no near-duplicate.
    * If a sketch's hashes are ordered from rare to frequent, all but the last
      ``least - 1`` suffice as inverted lists: common passages, being frequent,
      come last and lead few documents together.  Of lists of the same sets one stays.
    * A list is dealt into groups of ``chunk`` sets or ``chunk_mb`` at most.
      In a group, two sketches are merged into that of the union, whose common
      part estimates the similarity; sets with a partner that passes are
      compared on the full sets, all 64 bits of each hash.  What leaves a
      group is a forest of the connected sets, never pairs.
    * First every set meets others in the longest of its lists only, which
      connects most copies.  Then all lists follow in which there still are
      sets that are not connected; lists that have sets in common are taken
      as one, where that moves fewer bytes than each by itself.  Where there
      is more than one group, sets connected with most of the others of their
      list meet only those that are not.  So large groups
      of near copies cost a pass, while a list of n sets that are similar but
      not linked costs about (n / chunk) ** 2 groups; none is cut.

    Null and empty texts and texts without words: n_shingles 0, linked with
    nothing, component_id their own doc_id.  Rows without doc_id take the
    component of equal sets, if any has a doc_id.  Repeated rows link as copies do; rows that share a doc_id are one
    node.  Other columns are not read.  An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sk = texts.mapInArrow(partial(_sketches, k=k, percent=percent, miss=miss), "doc_id long, n_shingles long, least int, print binary, tag long, sketch array<long>")
    sk = common.stored(sk.withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = sk.where("n_shingles > 0")
    copies = common.stored(some.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("id")).where("n > 1").select("print", "id"), "copies")
    again = some.select("row", "print", "doc_id").join(common.broadcast_if_small(copies), "print")  # of each set of copies one row stays
    stay = again.where("doc_id = id").groupBy("print").agg(F.min("row").alias("row"))
    gone = common.stored(again.select("row").join(stay.select("row"), "row", "left_anti"), "gone")
    nodes = some.where("doc_id is not null").join(common.broadcast_if_small(gone), "row", "left_anti")
    node = ["id", "tag"]

    posted = nodes.select("row", F.explode("sketch").alias("value"))  # the widest step: two numbers a row
    shared = posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    values = posted.join(shared.select("value"), "value").groupBy("row").agg(F.collect_list("value").alias("values"))
    taking = values.join(some.select("row", F.col("doc_id").alias("id"), "tag", "least"), "row").where(F.size("values") >= F.col("least"))
    taking = common.stored(taking.drop("row"), "taking")
    posted = taking.select(*node, "least", F.explode("values").alias("value"))
    shared = posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    ordered = posted.join(shared, "value").groupBy(*node).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("values"), F.first("least").alias("least"))
    room = F.greatest(F.lit(0), F.size("values") - F.col("least") + 1)
    lists = ordered.select(*node, room.alias("room"), F.posexplode(F.slice("values", F.lit(1), room)).alias("at", "v"))
    lists = common.stored(lists.select(*node, F.col("v.value").alias("value"), (F.col("at") >= F.col("room") - FIRST_LISTS).alias("first")), "lists")

    sets = texts.withColumnRenamed("doc_id", "id").join(common.broadcast_if_small(taking.select("id").distinct()), "id", "left_semi").mapInArrow(_full_sets, "id long, tag long, full binary")
    sets = common.stored(sets.dropDuplicates(node).join(taking.select(*node, "least"), node), "taking-sets")
    sizes = sets.select(*node, F.octet_length("full").alias("bytes"))
    parts = lambda n, of: F.ceil(F.greatest(n / chunk, of / (chunk_mb << 20))).cast("int")

    def different(some: DataFrame) -> DataFrame:
        """(value, parts) of the lists in ``some``, one of those that hold the same sets, and into how many groups it is dealt."""
        seen = [F.bit_xor(F.xxhash64(F.lit(k), *node)).alias(c) for k, c in ((1, "x"), (2, "y"))]
        about = some.join(sizes, node).groupBy("value").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), *seen)
        about = about.where("n > 1").groupBy("n", "x", "y").agg(F.min("value").alias("value"), F.max("bytes").alias("bytes"))
        return about.select("value", parts(F.col("n"), F.col("bytes")).alias("parts"))

    first = lists.where("first")
    dealt = first.join(different(first), "value").withColumn("part", F.pmod(F.xxhash64("value", *node), F.col("parts")))
    links = _connected(dealt.join(sets, node), k, percent, miss, "links")
    groups = common.components(links, "groups")

    grouped = common.stored(lists.join(groups.withColumnRenamed("node", "id"), "id", "left").select("value", *node, F.coalesce("component", "id").alias("group")), "grouped-lists")
    open_ = grouped.groupBy("value").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("value")
    left = common.stored(grouped.join(open_, "value").join(sizes, node), "open-lists")
    stars = left.groupBy("value").agg(F.min("id").alias("a")).join(left.select("value", F.col("id").alias("b")), "value").select("a", "b").distinct()
    families = common.components(stars, "families").withColumnRenamed("node", "id").withColumnRenamed("component", "family")
    left = left.join(families, "id", "left").withColumn("family", F.coalesce("family", "id"))
    members = left.select("family", *node, "bytes", "group").distinct()
    cost = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("bytes").alias("once")).join(left.groupBy("family").agg(F.sum("bytes").alias("often")), "family")
    cost = common.stored(cost.select("family", (parts(F.col("n"), F.col("once")) * F.col("once") <= F.col("often")).alias("whole")), "family-costs")
    columns = [*node, "bytes", "group"]
    by_family = members.join(cost.where("whole"), "family").select(F.col("family").alias("value"), *columns)
    by_list = left.join(cost.where("not whole"), "family").select("value", *columns)
    by_list = by_list.join(different(by_list.drop("bytes")).select("value"), "value").select("value", *columns)
    left = common.stored(by_family.union(by_list), "left")
    open_ = common.stored(left.groupBy("value").agg(parts(F.count("*"), F.sum("bytes")).alias("parts")), "left-parts")
    left = left.join(open_, "value")
    short = left.where("parts = 1").select("value", *node, F.lit(0).cast("long").alias("part"))
    links = links.union(_connected(short.join(sets, node), k, percent, miss, "more-links"))
    if not open_.where("parts > 1").isEmpty():
        left = left.where("parts > 1")
        by_group = left.groupBy("value", "group").agg(F.count("*").alias("n"))
        main = by_group.groupBy("value").agg(F.max_by("group", F.struct("n", "group")).alias("main"))
        left = common.stored(left.join(main, "value").select("value", *node, "bytes", (F.col("group") == F.col("main")).alias("is_main")), "long-lists")
        counts = left.groupBy("value").agg(*[parts(F.count_if(c), F.sum(F.when(c, F.col("bytes")).otherwise(0))).alias(n) for n, c in (("mains", F.col("is_main")), ("others", ~F.col("is_main")))])
        left = left.join(counts, "value")
        own = F.pmod(F.xxhash64("value", *node), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
        to = F.when(F.col("is_main"), F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.lit(True).alias("m"), own.alias("i"), j.alias("j"))))
        pair = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.lit(False).alias("m"), F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
        both = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.struct(F.lit(True).alias("m"), i.alias("i"), own.alias("j")))
        dealt = left.select("value", *node, F.explode(F.coalesce(to, F.concat(both, pair))).alias("g")).withColumn("part", F.xxhash64("g.m", "g.i", "g.j"))
        links = links.union(_connected(dealt.join(sets, node), k, percent, miss, "long-links"))
    groups = common.components(links, "all-groups")

    out = sk.select("doc_id", "n_shingles", "print").join(copies, "print", "left").withColumn("node", F.when(F.col("n_shingles") > 0, F.coalesce("id", "doc_id")))
    out = out.join(groups, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose document stays, one for each group of linked documents: the one of smallest doc_id.

    A document is a doc_id with a text: rows that repeat both count once, and
    texts that only share a doc_id are not linked by it.  Rows without doc_id,
    which the groups cannot name, stay once for each text.
    """
    (own,) = common.fresh(docs, "mark")
    marked = docs.where("doc_id is not null").withColumn(own, F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull()))
    groups = near_duplicates(marked.select(F.col(own).alias("doc_id"), "text"), **settings).select(F.col("doc_id").alias(own), "component_id").distinct()
    first = marked.select(own, "doc_id").distinct().join(groups, own).groupBy("component_id").agg(F.min(F.struct("doc_id", own)).alias("first"))
    kept = common.stored(first.select(f"first.{own}"), "kept")
    named = marked.join(kept, own, "left_semi").dropDuplicates([own]).select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def near_duplicates_sql(percent: int) -> str:
    """The same over table documents in DuckDB SQL."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive w as materialized (select doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') as w from documents),
g as materialized (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i : i + {WORDS} - 1], ' ')) end)) as s from w),
z as materialized (select doc_id, count(*) as n from g group by doc_id),
p as materialized (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.s = y.s and x.doc_id <> y.doc_id group by all),
l as materialized (select a, b from p join z x on x.doc_id = a join z y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
r as (select doc_id as n, doc_id as m from documents union select r.n, l.b from r join l on r.m = l.a)
select d.doc_id, coalesce(z.n, 0) as n_shingles, k.component_id, d.doc_id = k.component_id as kept
from documents d left join z using (doc_id) join (select n, min(m) as component_id from r group by n) k on k.n = d.doc_id"""
