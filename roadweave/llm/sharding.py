"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Significant bits of a group's size: larger sizes are rounded up to as many, so that there are 8192 + 4096 classes for each doubling beyond.
SIZE_BITS = 13
#: Rows of a slot run: numbering sorts runs of about so many rows.
RUN_ROWS = 50_000


@dataclass
class _Node:
    key: tuple[int, int]
    level: int = 1
    left: _Node | None = None
    right: _Node | None = None


def _skew(t: _Node) -> _Node:
    if t.left is not None and t.left.level == t.level:
        low = t.left
        t.left, low.right = low.right, t
        return low
    return t


def _split(t: _Node) -> _Node:
    if t.right is not None and t.right.right is not None and t.right.right.level == t.level:
        high = t.right
        t.right, high.left = high.left, t
        high.level += 1
        return high
    return t


class Rooms:
    """Bins by (room left, number) in an AA tree: the tightest one with enough room is found, taken out and put back in logarithmic time."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        def into(t: _Node | None) -> _Node:
            if t is None:
                return _Node(key)
            if key < t.key:
                t.left = into(t.left)
            else:
                t.right = into(t.right)
            return _split(_skew(t))

        self.root = into(self.root)

    def tightest(self, room: int) -> tuple[int, int] | None:
        """The least (room, number) with that room at least."""
        t, best = self.root, None
        while t is not None:
            if t.key[0] >= room:
                best, t = t.key, t.left
            else:
                t = t.right
        return best

    def remove(self, key: tuple[int, int]) -> None:
        def out_of(t: _Node | None, key: tuple[int, int]) -> _Node | None:
            if t is None:
                return None
            if key < t.key:
                t.left = out_of(t.left, key)
            elif key > t.key:
                t.right = out_of(t.right, key)
            elif t.left is None and t.right is None:
                return None
            elif t.left is None:
                after = t.right
                while after.left is not None:
                    after = after.left
                t.key, t.right = after.key, out_of(t.right, after.key)
            else:
                before = t.left
                while before.right is not None:
                    before = before.right
                t.key, t.left = before.key, out_of(t.left, before.key)
            least = 1 + min(t.left.level if t.left else 0, t.right.level if t.right else 0)
            if least < t.level:
                t.level = least
                if t.right is not None:
                    t.right.level = min(least, t.right.level)
            t = _skew(t)
            if t.right is not None:
                t.right = _skew(t.right)
                if t.right.right is not None:
                    t.right.right = _skew(t.right.right)
            t = _split(t)
            if t.right is not None:
                t.right = _split(t.right)
            return t

        self.root = out_of(self.root, key)


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, bins: int) -> list[list[tuple[int, int]]] | None:
    """For each (size, count) the runs (bin, how many) of its items, largest size first; None if an item finds no room.

    Each item enters the tightest bin that has room for it.  That bin stays the
    tightest for the next item of the size, so a size's items are placed bin by
    bin, as one by one they would be.
    """
    rooms, out = Rooms(), [[] for _ in classes]
    for b in range(bins):
        rooms.add((capacity, b))
    for i in sorted(range(len(classes)), key=lambda i: -classes[i][0]):
        size, left = classes[i]
        while left:
            at = rooms.tightest(size)
            if at is None:
                return None
            n = min(left, at[0] // size)
            rooms.remove(at)
            rooms.add((at[0] - n * size, at[1]))
            out[i].append((at[1], n))
            left -= n
    return out


def pack_classes(classes: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """Runs by :func:`best_fit_decreasing` under the first capacity at which all fit: an even share, or 1/4096, 2/4096, 4/4096 .. more."""
    least = max([-(-sum(s * n for s, n in classes) // bins), *(s for s, _ in classes)])
    more = 0
    while (found := best_fit_decreasing(classes, least + least * more // 4096 + (more > 0), bins)) is None:
        more = max(1, 2 * more)
    return found


def size_class(size: Column) -> Column:
    """Sizes rounded up to :data:`SIZE_BITS` significant bits."""
    shift = F.greatest(F.lit(0), F.ceil(F.log2(size.cast("double") + 1)).cast("int") - SIZE_BITS)
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return (F.ceil(size / unit) * unit).cast("long")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every column of ``docs`` plus size LONG, text_crc32 LONG, shard INT: shards of near equal bytes.

    Law ``bytes``: a row weighs the UTF-8 bytes of its text (null: none) plus
    one.  Rows with equal texts (null equals null) are one indivisible group.
    The driver packs the histogram of group sizes by best fit, largest first:
    sizes of 8192 and more are rounded up by 1/4096 at most, so the histogram
    has a bounded number of classes (about 100 000 up to terabytes) whatever
    the input, and every group is packed by its size.  A class's groups are
    then numbered in runs of hash, and numbers are dealt to the bins as packed.
    A group larger than a shard's share stays whole and makes its shard larger.

    Columns named like the added ones are replaced, others kept.  Repeated
    rows are in one group.  An empty table stays empty.
    """
    spark = docs.sparkSession
    group, own, crc = common.fresh(docs, "sh_group", "sh_size", "sh_crc")
    added = {"size", "text_crc32", "shard", "slot"}
    keep = [c for c in docs.columns if c.lower() not in added]
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    check = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select(*keep, bytes_.alias(own), check.alias(crc), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias(group))
    sizes = rows.groupBy(F.col(group).alias("g")).agg(F.sum(own).alias("size"))
    groups = common.stored(sizes.select("g", size_class(F.col("size")).alias("class")), "shard-groups")
    classes = sorted((int(r[0]), int(r[1])) for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect())  # bounded by SIZE_BITS
    found = []
    for (size, n), runs in zip(classes, pack_classes(classes, shards) if classes else []):
        ends, total = [], 0
        for _, k in runs:
            total += k
            ends.append(total)
        found.append((size, -(-n // RUN_ROWS), ends, [b for b, _ in runs]))
    dealt = F.broadcast(spark.createDataFrame(found, "class long, runs long, ends array<long>, bins array<int>"))  # as many rows as classes
    run = groups.join(dealt, "class").withColumn("run", F.pmod(F.xxhash64(F.lit(5), "g"), F.col("runs")))
    number = F.row_number().over(Window.partitionBy("class", "run").orderBy("g")) - 1
    counts = run.groupBy("class", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = run.withColumn("number", number).join(counts.select("class", "run", before.alias("base")), ["class", "run"])
    at = F.size(F.filter("ends", lambda e: e <= F.col("number") + F.col("base")))
    placed = placed.select(F.col("g").alias(group), F.get("bins", at).alias("shard"))
    out = rows.join(placed, group)
    return out.select(*keep, F.col(own).alias("size"), F.col(crc).alias("text_crc32"), "shard")


def with_slots(placed: DataFrame, name: str = "slots") -> DataFrame:
    """``placed`` (with doc_id and shard) plus slot LONG, gapless from 0 in each shard."""
    run, base, n = common.fresh(placed, "run", "base", "n")
    counts = placed.groupBy("shard").count().collect()
    runs = max([1, *(-(-r["count"] // RUN_ROWS) for r in counts)])
    spread = placed.withColumn(run, F.pmod(F.xxhash64(F.lit(11), "doc_id", "text_crc32"), F.lit(runs)))
    sizes = spread.groupBy("shard", run).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    order = Window.partitionBy("shard", run).orderBy("doc_id", "text_crc32", "size")
    numbered = spread.withColumn("slot", F.row_number().over(order).cast("long") - 1)
    return numbered.join(bases, ["shard", run]).withColumn("slot", F.col("slot") + F.col(base)).drop(run, base)
