"""What the training-data operators share: scratch tables, words, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset, and on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: A setting by which Spark drops a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    The shuffle files of the write serve nothing else, and go at its end.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, most_rows: int = 1 << 21) -> DataFrame:
    """``df``, a stored table of a few numbers a row, marked for broadcast if it has ``most_rows`` at most; beyond that Spark shuffles it."""
    return F.broadcast(df) if df.count() <= most_rows else df


def n_words(text: Column) -> Column:
    """Words of a text as LONG; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that clash with no column of ``df`` in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


_kept: dict = {}


def kept(key, make: Callable):
    """What ``make`` gives, once for each Python worker; it outlives a task until another key is asked for, so that one cache at most stays."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


class _WordHashes(dict):
    """64-bit hashes of words; the most frequent words are met early, and stay."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 50_000 and len(word) < 64:
            self[word] = h
        return h


def word_hash() -> Callable[[bytes], int]:
    return kept("word hashes", _WordHashes).__getitem__


def tidy(task):
    """A task over Arrow batches that hands its memory back at its end: Python workers outlive their tasks."""

    @wraps(task)
    def run(batches, *args, **settings):
        try:
            yield from task(batches, *args, **settings)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def slices(batch, column: str, max_bytes: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """Runs of rows of an Arrow batch, each of at most about ``max_bytes`` of ``column``: (first row, values)."""
    values = batch.column(column)
    start = size = 0
    for i in range(len(values)):
        v = values[i]
        size += len(v.as_buffer()) if v.is_valid else 0
        if size >= max_bytes:
            yield start, values.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0
    if start < len(values):
        yield start, values.slice(start).to_pylist()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (a LONG, b LONG) as (node, component = smallest node reachable).

    Each round every node takes the smallest among itself and its neighbours
    as its parent, then the parent's parent until none changes (pointer
    jumping: chains shorten geometrically), and the edges are drawn between
    these roots; those within a tree go and equal ones become one, so that
    later rounds join only what is still apart.  A root that took no node in
    one round has a smaller neighbour in the next, so every two rounds at
    least halve the nodes that edges are left for, and it ends by itself.
    Minima combine before the shuffle, so a node with very many links costs
    no task more than its share; every round is written to the shared folder,
    so a lost executor costs one round.
    """
    link = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = stored(edges.where("a <> b").select(*link("a", "b")).distinct(), f"{name}-edges")
    trees = []
    while not trees or not left.isEmpty():
        k = len(trees)
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), f"{name}-{k}")
        while True:
            up = tree.select(F.col("node").alias("component"), F.col("component").alias("up"))
            step = stored(tree.join(up, "component").select("node", F.col("component").alias("old"), F.col("up").alias("component")), f"{name}-{k}-up")
            tree = step.select("node", "component")
            if step.where("component <> old").isEmpty():
                break
        trees.append(tree)
        roots = [tree.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab"]
        apart = left.join(roots[0], "a").join(roots[1], "b").where("of_a <> of_b")
        left = stored(apart.select(*link("of_a", "of_b")).distinct(), f"{name}-{k}-edges")
    labels = trees.pop()
    for k, tree in reversed([*enumerate(trees)]):
        last = labels.select(F.col("node").alias("component"), F.col("component").alias("last"))
        labels = stored(tree.join(last, "component", "left").select("node", F.coalesce("last", "component").alias("component")), f"{name}-{k}-last")
    return labels
