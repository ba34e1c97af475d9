"""Exact top-k inner product search by the threshold algorithm over sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

VECTOR_BLOCK, QUERY_BLOCK, FIRST_DEPTH = 8192, 1024, 64


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds no null and no non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest number type in which inner products of rows of ``a`` and ``b`` are exact."""
    if not len(a) or not len(b):
        return np.int64
    most = int(max(abs(int(a.min())), abs(int(a.max())))) * int(max(abs(int(b.min())), abs(int(b.max())))) * max(1, a.shape[1])
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def threshold_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
    """(query id, id, score) of each query's k best by (score descending, id), its own id left out.

    A list for each dimension holds the rows by value.  A query reads its
    lists from the end its sign favours, all to the same depth, and scores the
    rows it meets.  What it has not met scores at most the inner product with
    the values at that depth; the search stops once that is below the k-th
    best score (at equality a smaller id might still come), else the depth doubles.
    """
    n, out = len(ids), []
    kind = exact_type(vectors, queries)
    order = np.argsort(vectors, axis=0, kind="stable")
    values = np.take_along_axis(vectors, order, axis=0)
    exact, asked = vectors.astype(kind), queries.astype(kind)
    for own, q, qk in zip(query_ids.tolist(), queries, asked):
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = ids == own
        scores, at = np.empty(0, kind), np.empty(0, np.int64)
        done, depth = 0, min(n, FIRST_DEPTH)
        while True:
            met = np.zeros(n, bool)
            met[order[n - depth : n - done, up].ravel()] = True
            met[order[done:depth, down].ravel()] = True
            if depth == n:
                met[:] = True  # also rows no list leads to: a query of zeros has none
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            scores, at = np.concatenate([scores, exact[new] @ qk]), np.concatenate([at, new])
            if len(at) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k] if kind is not object else sorted(scores)[-k]
                keep = scores >= kth
                scores, at = scores[keep], at[keep]
            if depth == n:
                break
            bound = sum(int(v) * int(x) for v, x in zip(values[n - depth, up], q[up])) + sum(int(v) * int(x) for v, x in zip(values[depth - 1, down], q[down]))
            if len(at) >= k and bound < int(min(scores)):
                break
            done, depth = depth, min(n, 2 * depth)
        best = sorted(((-int(s), int(ids[i])) for s, i in zip(scores, at)))[:k]
        out += [(own, i, -s) for s, i in best]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id LONG, rank INT, vec_id LONG, score LONG: for each query its k best rows of another id.

    ``vectors``, ``queries``: vec_id, embedding.  A component x becomes
    floor(1024 * x), x as double, held in the 64-bit range; the score is the
    exact integer inner product.  Rows whose vector is null, or holds null or
    non-finite components, or whose vec_id is null, take no part.  Vectors
    meet queries of their own length only.  A vec_id repeated among the queries asks once, with its smallest
    vector; repeated rows of vectors are results each on their own.  Without
    usable vectors or queries there are no rows.  Other columns are left out.

    Rows are dealt by hash into blocks of about 8192, queries into blocks of
    1024; each pair of blocks is one group, searched by the threshold
    algorithm, which returns k rows for each query.  So a group's size is
    bounded, and only k rows for each query and block meet in the last ranking.
    """
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")))
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    asked = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = rows.count(), asked.count()
    nb, mb = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    size = F.size("v").alias("dim")
    left = rows.select("vec_id", "v", size, F.pmod(F.xxhash64("vec_id"), F.lit(nb)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(mb - 1))).alias("q"))
    right = asked.select("vec_id", "v", size, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(mb)).cast("int").alias("q"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if a.num_rows and b.num_rows:
            matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
            found = threshold_search(a.column("vec_id").to_numpy(), matrix(a), b.column("vec_id").to_numpy(), matrix(b), k)
        held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([held(f[2]) for f in found], pa.int64())], ["query_id", "vec_id", "score"])

    key = ["dim", "b", "q"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k_sql(every: int, k: int) -> str:
    """The same over table embeddings in DuckDB SQL."""
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % {every} = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= {k}"""
