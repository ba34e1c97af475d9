"""Vector codes: a codebook for each part of the vectors, fitted by Lloyd's rounds that rescan only what their heaps let through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .topk import usable

#: Vectors that share their heaps: the rows of one stored block.
BLOCK = 4096
LONG = (1 << 63) - 1
#: Rounding errors of roots and sums of drifts stay far below this share of them.
MARGIN = 1e-9


class Codebooks:
    """Integer entries of every part of the vectors of one length, and how far each has drifted so far."""

    def __init__(self, entries: list[list[list[int]]], dim: int):
        self.entries, self.dim = entries, dim
        #: For each part and entry: bound on what a slack has lost since the first round.
        self.drift = [np.zeros(len(e)) for e in entries]

    def cuts(self) -> list[tuple[int, int]]:
        return part_cuts(self.dim, len(self.entries))

    def moved(self, entries: list[list[list[int]]]) -> Codebooks:
        """The next codebooks.  A slack of an entry's part shrinks at most by what this entry and the farthest moved other one have moved."""
        out = Codebooks(entries, self.dim)
        for b, (old, new) in enumerate(zip(self.entries, entries)):
            way = np.array([sum((x - y) ** 2 for x, y in zip(p, q)) ** 0.5 for p, q in zip(old, new)])
            top = np.argsort(-way, kind="stable")[:2]
            other = np.full(len(way), way[top[0]])
            other[top[0]] = way[top[1]] if len(way) > 1 else 0.0
            out.drift[b] = self.drift[b] + way + other
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for c in e for x in c).encode()).hexdigest()


def part_cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts begin and end; equal ones if ``dim`` is their multiple."""
    edges = [dim * k // parts for k in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:]))


def exact(points: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Points and entries in the fastest number type in which their squared distances are exact."""
    book = np.array(entries, object).reshape(len(entries), points.shape[1])
    own = max(int(points.max()), -int(points.min())) if points.size else 0
    top = max(own, max((abs(x) for e in entries for x in e), default=0))
    most = 4 * top * top * max(1, points.shape[1])
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    return points.astype(kind), book.astype(kind)


def distances(points: np.ndarray, entries: list[list[int]]) -> np.ndarray:
    """Squared distances of all points from all entries, exact."""
    x, c = exact(points, entries)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def scan(points: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point (ties to the lower index) and its slack: how much farther the second nearest is."""
    d = distances(points, entries)
    code = np.argmin(d, axis=1)
    at = np.arange(len(d))
    best = d[at, code].astype(np.float64)
    if d.shape[1] == 1:
        return code, np.full(len(d), np.inf)
    d = d.astype(np.float64)
    d[at, code] = np.inf
    return code, np.sqrt(d.min(axis=1)) - np.sqrt(best)


def sums_of(points: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """(2, k, 1 + components): for each entry the count and the sums of its points, as high parts and low 32 bits."""
    out = np.zeros((2, k, 1 + points.shape[1]), np.int64)
    np.add.at(out[1, :, 0], code, 1)
    np.add.at(out[0, :, 1:], code, points >> 32)
    np.add.at(out[1, :, 1:], code, points & 0xFFFFFFFF)
    return out


class Heaps:
    """The parts of a block at one position, in a heap for each entry, keyed by slack plus the entry's drift when it was measured."""

    def __init__(self, k: int, heaps: list[list[tuple[float, int]]] | None = None):
        self.heaps = heaps if heaps is not None else [[] for _ in range(k)]

    @classmethod
    def of(cls, code: np.ndarray, slack: np.ndarray, drift: np.ndarray) -> Heaps:
        """Heaps of all parts at once."""
        out = cls(len(drift))
        for e, key, row in zip(code.tolist(), (slack + drift[code]).tolist(), range(len(code))):
            out.heaps[e].append((key, row))
        for heap in out.heaps:
            heapify(heap)
        return out

    def pop_violated(self, drift: np.ndarray) -> np.ndarray:
        """Takes out the parts whose bounds no longer prove that their entry is the nearest."""
        popped = []
        for heap, d in zip(self.heaps, (drift * (1 + MARGIN)).tolist()):
            while heap and heap[0][0] * (1 - MARGIN) <= d:
                popped.append(heappop(heap)[1])
        return np.array(popped, np.int64)

    def push(self, rows: np.ndarray, code: np.ndarray, slack: np.ndarray, drift: np.ndarray) -> None:
        for e, key, row in zip(code.tolist(), (slack + drift[code]).tolist(), rows.tolist()):
            heappush(self.heaps[e], (key, row))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Keys, rows and sizes, heap after heap, each in its own order, which keeps it a heap."""
        every = [x for heap in self.heaps for x in heap]
        return np.array([x[0] for x in every], np.float64).tobytes(), np.array([x[1] for x in every], np.int32).tobytes(), np.array([len(h) for h in self.heaps], np.int32).tobytes()

    @classmethod
    def unpacked(cls, keys: bytes, rows: bytes, sizes: bytes) -> Heaps:
        every = iter(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(rows, np.int32).tolist()))
        counts = np.frombuffer(sizes, np.int32).tolist()
        return cls(len(counts), [[next(every) for _ in range(n)] for n in counts])


def assign(points: np.ndarray, entries: list[list[int]], drift: np.ndarray, code: np.ndarray | None, heaps: Heaps | None) -> tuple[np.ndarray, Heaps, np.ndarray, int]:
    """Codes, heaps, change of the sums and the number of parts scanned, for one position of a block.

    Without heaps every part is scanned; with them only those that they let through.
    """
    k = len(entries)
    if heaps is None:
        code, slack = scan(points, entries)
        return code, Heaps.of(code, slack, drift), sums_of(points, code, k), len(points)
    at, change = heaps.pop_violated(drift), np.zeros((2, k, 1 + points.shape[1]), np.int64)
    if len(at):
        new, slack = scan(points[at], entries)
        heaps.push(at, new, slack, drift)
        moved = new != code[at]
        change = sums_of(points[at[moved]], new[moved], k) - sums_of(points[at[moved]], code[at[moved]], k)
        code = code.copy()
        code[at] = new
    return code, heaps, change, len(at)


def _numbers(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // max(1, n * dim) or 8}").reshape(n, dim).astype(np.int64)


@common.tidy
def _blocks(batches, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of vectors gathered into blocks of one length each."""
    for batch in batches:
        dims = np.asarray(pc.list_value_length(batch.column("v")), np.int64)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            for lo in range(0, len(at), block):
                own = batch.take(pa.array(at[lo : lo + block]))
                v, one = np.asarray(own.column("v").flatten(), np.int64), pa.array([0, own.num_rows], pa.int32())
                kind = next((k for k in (np.int16, np.int32) if not v.size or (v.min() >= np.iinfo(k).min and v.max() <= np.iinfo(k).max)), np.int64)
                ids, labels = (pa.ListArray.from_arrays(one, own.column(c)) for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([own.num_rows], pa.int32()), ids, labels, pa.array([v.astype(kind).tobytes()], pa.binary())], ["dim", "n", "ids", "labels", "data"])


@common.tidy
def _round(batches, books: dict[int, Codebooks], last: bool) -> Iterator[pa.RecordBatch]:
    """One assignment of all blocks: their next state and the change of the sums; of the last round each vector's codes and error."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            value = {c: row.column(c)[0].as_py() for c in row.schema.names if c not in ("ids", "labels")}
            n, book = value["n"], books[value["dim"]]
            data = _numbers(value["data"], n, value["dim"])
            codes = np.frombuffer(value["code"], np.uint8).reshape(len(book.entries), n) if "code" in value else None
            kept, out, change, scanned, error = [], [], [], 0, np.zeros(n, np.float64)
            for b, (lo, hi) in enumerate(book.cuts()):
                heaps = Heaps.unpacked(value["keys"][b], value["rows"][b], value["sizes"][b]) if codes is not None else None
                code, heaps, delta, count = assign(data[:, lo:hi], book.entries[b], book.drift[b], None if codes is None else codes[b].astype(np.int64), heaps)
                out.append(code.astype(np.uint8))
                scanned += count
                if last:
                    x, c = exact(data[:, lo:hi], book.entries[b])
                    part = ((x - c[code]) ** 2).sum(axis=1)
                    error = error + part if error.dtype == part.dtype and (error + part).max(initial=0) < 1 << 53 else error.astype(object) + np.array([int(p) for p in part], object)
                else:
                    kept.append(heaps.packed())
                    change.append(delta)
            if last:
                digits = [bytes(c).hex() for c in np.stack(out, axis=1)]
                errors = pa.array([min(LONG, int(e)) for e in error], pa.int64())
                lists = [row.column(c).flatten() for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays([pa.array([value["dim"]] * n, pa.int32()), *lists, pa.array(digits, pa.string()), errors], ["dim", "vec_id", "label", "code", "error"])
            else:
                keys, rows, sizes = zip(*kept)
                hi, lo = (np.concatenate([d[s].ravel() for d in change]) for s in (0, 1))
                state = [pa.array([np.concatenate(out).tobytes()], pa.binary()), *(pa.array([list(x)], pa.list_(pa.binary())) for x in (keys, rows, sizes))]
                sums = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (hi, lo)]
                own = [row.column(c) for c in ("dim", "n", "ids", "labels", "data")]
                yield pa.RecordBatch.from_arrays([*own, *state, *sums, pa.array([scanned], pa.int64())], ["dim", "n", "ids", "labels", "data", "code", "keys", "rows", "sizes", "hi", "lo", "scanned"])


def _first_entries(vectors: DataFrame, parts: int, entries: int) -> dict[int, Codebooks]:
    """For each length the parts of its first vectors by (vec_id, numbers)."""
    out = {}
    for (dim,) in vectors.select(F.size("v")).distinct().collect():
        first = vectors.where(F.size("v") == dim).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
        out[dim] = Codebooks([[list(r["v"][lo:hi]) for r in first] for lo, hi in part_cuts(dim, parts)], dim)
    return out


def _totals(state: DataFrame) -> dict[int, dict[int, int]]:
    """The change of all counts and sums by length and place in its codebooks: as many numbers as these have."""
    each = state.select("dim", F.posexplode(F.arrays_zip("hi", "lo")).alias("at", "x")).groupBy("dim", "at").agg(F.sum("x.hi").alias("hi"), F.sum("x.lo").alias("lo"))
    out: dict[int, dict[int, int]] = {}
    for r in each.collect():
        out.setdefault(r["dim"], {})[r["at"]] = (r["hi"] << 32) + r["lo"]
    return out


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, block: int = BLOCK) -> tuple[DataFrame, dict[int, Codebooks]]:
    """A row for each usable row of ``vectors`` (vec_id, embedding, label): dim, vec_id, label, code, error; and the codebooks by vector length.

    A component x becomes floor(scale * x), held in the 64-bit range.  Vectors
    are cut into ``parts`` consecutive parts.  A part position's codebook
    begins as that part of the ``entries`` first vectors by vec_id.  Each round
    assigns every part to the nearest entry (squared distance, ties to the
    lower index) and puts each entry at the floor of its parts' mean; entries
    without parts stay.  A last assignment gives the codes and error, the sum
    of the squared distances (at most the largest LONG).

    Vectors are dealt into stored blocks of at most ``block``.  Each block
    keeps, for each position and entry, a heap of its parts keyed by how much
    farther the second nearest entry is than the nearest.  Entries that move
    lower that bound for all their parts alike, so their moves add up in one
    number for each heap; only parts whose key falls to that number are taken
    out and scanned again, exactly.  Counts and sums change by the parts that
    moved.  No vector is shuffled; the driver gets a codebook's worth of sums
    a round.  Every round is written to the shared folder.

    Rows whose vector is null or holds null or non-finite components take no
    part.  Vectors of other lengths have codebooks of their own; a length that
    is no multiple of ``parts`` is cut as evenly as whole numbers allow.  Null
    vec_ids come last in the order; repeated vec_ids are rows each on their
    own, ordered by their numbers.  With fewer vectors than ``entries`` there
    are as many entries as vectors.  An empty table stays empty, and has no
    codebooks.  Other columns are left out.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hex digits for each part")
    kind = vectors.schema["label"].dataType.simpleString()
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("v"))
    books = _first_entries(rows, parts, entries)
    held = f"dim int, n int, ids array<bigint>, labels array<{kind}>, data binary"
    state = common.stored(rows.mapInArrow(partial(_blocks, block=block), held), "vector-blocks")
    totals: dict[int, dict[int, int]] = {}
    for k in range(rounds):
        schema = held + ", code binary, keys array<binary>, rows array<binary>, sizes array<binary>, hi array<bigint>, lo array<bigint>, scanned long"
        state = common.stored(state.mapInArrow(partial(_round, books=books, last=False), schema), f"vector-codes-{k}")
        for dim, change in _totals(state).items():
            own = totals.setdefault(dim, {})
            for at, x in change.items():
                own[at] = own.get(at, 0) + x
        books = {dim: _moved(book, totals.get(dim, {})) for dim, book in books.items()}
        state = state.drop("hi", "lo", "scanned")
    coded = state.mapInArrow(partial(_round, books=books, last=True), f"dim int, vec_id long, label {kind}, code string, error long")
    return common.stored(coded, "vector-codes"), books


def _moved(book: Codebooks, totals: dict[int, int]) -> Codebooks:
    """The codebooks at the floor of the means."""
    at, new = 0, []
    for old in book.entries:
        part = []
        for entry in old:
            count, sums = totals.get(at, 0), [totals.get(at + 1 + j, 0) for j in range(len(entry))]
            part.append([s // count for s in sums] if count else entry)
            at += 1 + len(entry)
        new.append(part)
    return book.moved(new)


def code_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together) and codebooks_sha256, of the vector's length."""
    coded, books = encode(vectors.select("vec_id", "embedding", "label"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = common.broadcast_if_small(common.stored(by_label.select(F.col("label").alias("of_label"), "label_error"), "vector-labels"))
    digest = F.lit(None).cast("string")
    for dim, book in books.items():
        digest = F.when(F.col("dim") == dim, F.lit(book.digest())).otherwise(digest)
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def code_digest_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The same in DuckDB SQL, for vectors of one length that is a multiple of ``parts``."""
    sql = f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select vec_id, b, e[b * len(e) // {parts} + 1 : (b + 1) * len(e) // {parts}] as x from v, (select unnest(range(0, {parts})) as b)),
f as (select vec_id, row_number() over (order by vec_id) - 1 as k from v order by vec_id limit {entries}),
b0 as (select p.b, f.k, p.x as c from p join f using (vec_id))"""
    for r in range(rounds + 1):
        sql += f""",
a{r} as (select vec_id, b, k, d, x from (
           select p.vec_id, p.b, p.x, c.k, list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
           from p join b{r} c on p.b = c.b) qualify row_number() over (partition by vec_id, b order by d, k) = 1)"""
        if r < rounds:
            sql += f""",
s{r} as (select b, k, list(m order by j) as c from (
           select b, k, j, floor(sum(x[j]) / count(*))::bigint as m from a{r}, lateral (select unnest(range(1, len(x) + 1)) as j) group by b, k, j) group by b, k),
b{r + 1} as (select o.b, o.k, coalesce(s.c, o.c) as c from b{r} o left join s{r} s on o.b = s.b and o.k = s.k)"""
    return sql + f""",
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by b, k)) as codebooks_sha256 from b{rounds}),
r as (select vec_id, string_agg(lower(printf('%02x', k)), '' order by b) as code, sum(d)::bigint as error from a{rounds} group by vec_id)
select v.vec_id, r.code, r.error, (sum(r.error) over (partition by v.label))::bigint as label_error, h.codebooks_sha256 from v join r using (vec_id), h"""
