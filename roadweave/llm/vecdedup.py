"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .topk import usable

BLOCKS, CHUNK = 8, 2048
#: Added to the squared budget of a block, for coordinates sent as 32-bit floats.
SLACK = 1e-5
_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation, so that no block holds more than its share of the distances."""
    if dim not in _rotations:
        _rotations[dim] = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]
    return _rotations[dim]


def block_edges(dim: int) -> np.ndarray:
    return np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated, as 32-bit floats; made once for each vector, so that every comparison sees the same bits."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])).astype(np.float32)


def block_rows(turned: np.ndarray, cosine: float) -> dict[str, np.ndarray | list]:
    """Rows of the range join: each vector once as native of its cell, and as visitor of the cells in reach, for each block.

    Unit vectors with cosine c lie at squared distance 2 - 2c.  Cut into
    blocks, some block has at most its proportional part of that, so its first
    coordinates differ by at most the root.  Cells are twice as wide.
    """
    n, dim = turned.shape
    edges = block_edges(dim)
    out: dict[str, list] = {k: [] for k in ("at", "block", "cell", "native", "point")}
    for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        reach = np.sqrt(budget(cosine, lo, hi, dim))
        first = turned[:, lo].astype(np.float64)
        home, low, high = (np.floor(y / (2 * reach)).astype(np.int64) for y in (first, first - reach, first + reach))
        visits = high - low + 1
        at = np.concatenate([np.arange(n), np.repeat(np.arange(n), visits)])
        step = np.arange(visits.sum()) - np.repeat(np.cumsum(visits) - visits, visits)
        points = [p.tobytes() for p in np.ascontiguousarray(turned[:, lo:hi])]
        out["at"].append(at)
        out["block"].append(np.full(len(at), b))
        out["cell"].append(np.concatenate([home, np.repeat(low, visits) + step]))
        out["native"].append(np.arange(len(at)) < n)
        out["point"] += [points[i] for i in at]
    return {k: np.concatenate(v) if k != "point" else v for k, v in out.items()}


def budget(cosine: float, lo: int, hi: int, dim: int) -> float:
    """The squared distance that a block may hold of that of two vectors."""
    return (2 - 2 * cosine) * (hi - lo) / dim + SLACK


def _near(points: np.ndarray, a: np.ndarray, b: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of rows whose points are within a squared distance of about ``most``."""
    square = (points * points).sum(axis=1)
    return np.nonzero(square[a][:, None] + square[b][None, :] - 2 * points[a] @ points[b].T <= most + 1e-9)


def _taking_part(cosine: float):
    """Of a group the rows of vectors that some other one is near to in this block."""

    def taking(group: pa.Table) -> pa.Table:
        ids, native = group.column("id").to_numpy(), group.column("native").to_numpy(zero_copy_only=False)
        points = np.frombuffer(b"".join(group.column("point").to_pylist()), np.float32).reshape(len(ids), -1).astype(np.float64)
        edges = block_edges(group.column("dim")[0].as_py())
        k = group.column("block")[0].as_py()
        most = budget(cosine, edges[k], edges[k + 1], edges[-1])
        a, b, some = np.flatnonzero(~native), np.flatnonzero(native), np.zeros(len(ids), bool)
        for lo in range(0, len(b), CHUNK):
            bb = b[lo : lo + CHUNK]
            for la in range(0, len(a), CHUNK):
                aa = a[la : la + CHUNK]
                i, j = _near(points, aa, bb, most)
                other = ids[aa[i]] < ids[bb[j]]  # each pair from one side, none with itself
                some[aa[i[other]]] = some[bb[j[other]]] = True
        return group.filter(pa.array(some)).drop_columns(["point"])

    return taking


def _links(cosine: float):
    """Of a group: how many copies each vector is linked with, each pair counted in the first block that it qualifies in only, and a forest of the linked vectors."""

    def links(group: pa.Table) -> pa.Table:
        ids, native = group.column("id").to_numpy(), group.column("native").to_numpy(zero_copy_only=False)
        copies = group.column("copies").to_numpy()
        turned = np.frombuffer(b"".join(group.column("turned").to_pylist()), np.float32).reshape(len(ids), -1).astype(np.float64)
        whole = np.asarray(group.column("vector").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        norms = np.sqrt((whole * whole).sum(axis=1))
        edges, k = block_edges(turned.shape[1]), group.column("block")[0].as_py()
        most = [budget(cosine, lo, hi, edges[-1]) for lo, hi in zip(edges[:-1], edges[1:])]
        a, b = np.flatnonzero(~native), np.flatnonzero(native)
        degree: dict[int, int] = {}
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for lo in range(0, len(b), CHUNK // 4):
            bb = b[lo : lo + CHUNK // 4]
            for la in range(0, len(a), CHUNK // 4):
                aa = a[la : la + CHUNK // 4]
                i, j = _near(turned[:, edges[k] : edges[k + 1]], aa, bb, most[k])
                i, j = aa[i], bb[j]
                other = ids[i] < ids[j]
                i, j = i[other], j[other]
                for start in range(0, len(i), 1 << 14):
                    x, y = i[start : start + (1 << 14)], j[start : start + (1 << 14)]
                    ways = np.stack([((turned[x, p:q] - turned[y, p:q]) ** 2).sum(axis=1) for p, q in zip(edges[:-1], edges[1:])], axis=1)
                    mine = (ways[:, k] <= most[k] - 1e-9) & ~(ways[:, :k] <= np.array(most[:k]) - 1e-9).any(axis=1)
                    x, y = x[mine], y[mine]
                    linked = (whole[x] * whole[y]).sum(axis=1) / (norms[x] * norms[y]) >= cosine
                    x, y = x[linked], y[linked]
                    for u, v in ((x, y), (y, x)):
                        own, at = np.unique(ids[u], return_inverse=True)
                        for node, n in zip(own.tolist(), np.bincount(at, weights=copies[v]).astype(np.int64).tolist()):
                            degree[node] = degree.get(node, 0) + n
                    for u, v in zip(ids[x].tolist(), ids[y].tolist()):
                        u, v = top(u), top(v)
                        root[max(u, v)] = min(u, v)
        nodes = sorted(degree)
        return pa.table([pa.array(nodes, pa.int64()), pa.array([degree[x] for x in nodes], pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["id", "others", "root"])

    return links


def links_of(nodes: DataFrame, cosine: float) -> DataFrame:
    """(id, others, root) for the vectors that have links, a row for each group they have some in: how many copies of others, and the smallest one of the group that they are connected with.

    ``nodes``: id LONG, label, vector ARRAY, copies LONG; of equal label and length only those of a cosine of ``cosine`` or more link.
    """
    kind = nodes.schema["label"].dataType.simpleString()
    keep = ["id", "label", "dim", "block", "cell", "native", "point"]

    def turn(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            turned: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                for i, x in zip(at, rotated(np.array([vectors[i] for i in at], np.float64))):
                    turned[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("copies"), batch.column("vector"), pa.array(turned, pa.binary())], ["id", "label", "copies", "vector", "turned"])

    def spread(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) // 4 for x in batch.column("turned").to_pylist()]
            for dim in sorted(set(sizes)):
                at = np.flatnonzero(np.array(sizes) == dim)
                for lo in range(0, len(at), 500):
                    part = batch.take(pa.array(at[lo : lo + 500]))
                    rows = block_rows(np.frombuffer(b"".join(part.column("turned").to_pylist()), np.float32).reshape(part.num_rows, dim), cosine)
                    own = pa.array(rows["at"], pa.int64())
                    kinds = {"block": pa.int32(), "cell": pa.int64(), "native": pa.bool_(), "point": pa.binary()}
                    yield pa.RecordBatch.from_arrays([part.column("id").take(own), part.column("label").take(own), pa.array(np.full(len(own), dim), pa.int32()), *[pa.array(rows[c], t) for c, t in kinds.items()]], keep)

    whole = nodes.select("id", "label", "copies", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    whole = common.stored(whole.mapInArrow(turn, f"id long, label {kind}, copies long, vector array<double>, turned binary"), "turned-vectors")
    rows = common.stored(whole.select("id", "label", "turned").mapInArrow(spread, f"id long, label {kind}, dim int, block int, cell long, native boolean, point binary"), "pigeonholes")
    key = ["label", "dim", "block", "cell"]
    counts = rows.groupBy(*key).agg(F.count_if("native").alias("natives"), F.count_if(~F.col("native")).alias("visitors")).where("natives > 0 and visitors > 1")
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / CHUNK)).cast("int")
    dealt = rows.join(counts.select(*key, chunks("natives").alias("nn"), chunks("visitors").alias("nv")), key)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("native"), F.col("nn")).otherwise(F.col("nv"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("native"), F.col("nv")).otherwise(F.col("nn")) - 1))
    dealt = dealt.select(*keep, own.alias("own"), other.alias("other"))
    i, j = F.when(F.col("native"), F.col("own")).otherwise(F.col("other")), F.when(F.col("native"), F.col("other")).otherwise(F.col("own"))
    dealt = dealt.withColumns({"i": i, "j": j}).drop("own", "other")
    group = [*key, "i", "j"]
    taking = dealt.groupBy(*group).applyInArrow(_taking_part(cosine), f"id long, label {kind}, dim int, block int, cell long, native boolean, i int, j int")
    taking = common.stored(taking, "taking-vectors").join(whole.select("id", "copies", "vector", "turned"), "id")
    return taking.groupBy(*group).applyInArrow(_links(cosine), "id long, others long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """A row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows of equal label link when their cosine, in double precision, is at
    least ``cosine``.  Equal vectors of a label are one node first, so copies
    cost one comparison.  Nodes are rotated and cut into eight blocks; for
    each block a range join by cell of its first coordinate finds nodes that
    have others at a block distance within its part of the budget (hot cells
    are dealt in chunks of 2048).  Those meet once more with their full
    vectors, where each pair is verified in the first block that it qualifies
    in.  No pair that qualifies can miss every block.  A group gives each of
    its vectors a count of links and the smallest vector it is connected with,
    so that its output grows with its vectors, not with their pairs.

    Null labels, null, empty or zero vectors, vectors with null or non-finite
    components, and rows without vec_id link with nothing: n_links 0,
    component_id their own vec_id.  Vectors of other lengths never link.
    Repeated rows link with each other as copies do; rows that share a vec_id
    with another vector count links each for itself, and are one in the
    components.  An empty table stays empty.  Other columns are left out.
    """
    kind = vectors.schema["label"].dataType.simpleString()
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    fits = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    nodes = base.where(fits).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    nodes = common.stored(nodes, "vector-nodes")
    (mark,) = common.fresh(nodes, "node")
    nodes = common.stored(nodes.withColumn(mark, F.monotonically_increasing_id()), "marked-vectors")
    links = common.stored(links_of(nodes.select(F.col(mark).alias("id"), "label", F.col("embedding").alias("vector"), "copies"), cosine), "vector-links")
    degree = links.groupBy(F.col("id").alias(mark)).agg(F.sum("others").alias("others"))
    name = nodes.select(F.col(mark), "id")
    edges = links.select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()
    for end in "ab":
        edges = edges.join(name.select(F.col(mark).alias(end), F.col("id").alias(f"{end}_id")), end).drop(end).withColumnRenamed(f"{end}_id", end)
    parts = common.components(edges.select("a", "b"), "vector-parts").withColumnRenamed("node", "id")
    state = nodes.join(degree, mark, "left").join(parts, "id", "left").select(
        F.col("label").cast(kind).alias("label"), "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    out = base.where(fits).join(state, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~F.coalesce(fits, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def near_duplicates_sql(cosine: float) -> str:
    """The same over table embeddings in DuckDB SQL."""
    return f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e)
      where list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= {cosine}),
r as (select vec_id as n, vec_id as m from embeddings union select r.n, l.b from r join l on r.m = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, min(r.m) as component_id, e.vec_id = min(r.m) as kept
from embeddings e join r on r.n = e.vec_id group by e.vec_id"""
