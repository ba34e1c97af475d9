"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A document's place in its source's permutation is a 60-bit key: the top bits name its block, deeper digits its place in it.
DIGIT_BITS, DIGITS = 10, 6
BLOCKS = 1 << DIGIT_BITS
#: Bits of mix_order by which a shard's rows are parted, so that no task has to hold a whole shard.
PART_BITS = 6
#: Sources up to which their table, of shards numbers each, is broadcast.
MOST_SOURCES = 20_000


def water_fill(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Share ``total`` by weight; no share exceeds ``most`` times its size, what is over is shared anew by weight."""
    left, open_, target = float(total), {s for s in sizes if sizes[s] > 0}, {s: 0.0 for s in sizes}
    while open_:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight > most * sizes[s]}
        if not full:
            target |= {s: left * weights[s] / weight for s in open_}
            break
        for s in full:
            target[s] = float(most * sizes[s])
        left = total - sum(target[s] for s in sizes if s not in open_ or s in full)
        open_ -= full
    return target


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard: a tree halves the shards and splits the quota vector hypergeometrically.

    Every level keeps the sums exact, so the rows add up to ``quotas`` and the
    shards' block counts differ by at most the rounding of the halving.
    """
    if shards == 1:
        return quotas.reshape(1, -1)
    left = shards // 2
    draw = int(round(int(quotas.sum()) * left / shards))
    taken = np.zeros_like(quotas)
    rest_draw, rest_all = draw, int(quotas.sum())
    for i, q in enumerate(quotas.tolist()):  # the multivariate law, one hypergeometric margin after another
        rest_all -= q
        taken[i] = rng.hypergeometric(q, rest_all, rest_draw) if 0 < rest_draw and q + rest_all else 0
        rest_draw -= int(taken[i])
    return np.vstack([split_quotas(taken, left, rng), split_quotas(quotas - taken, shards - left, rng)])


@dataclass
class Plan:
    """``source``: text or None; ``passes`` whole draws of every document; ``cut``: documents whose key is below it are drawn once more."""

    source: str | None
    size: int
    target: float
    passes: int
    cut: int


def _per_source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table by source; broadcast up to :data:`MOST_SOURCES` sources, beyond that Spark joins it by its size."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MOST_SOURCES else table


def _digit(key: Column, level: int) -> Column:
    shift = DIGIT_BITS * (DIGITS - 1 - level)
    return F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(BLOCKS - 1).cast("long"))


def _names(docs: DataFrame) -> dict[str, str]:
    """Names of the columns that mixing adds on its way, none of which ``docs`` has."""
    names = ("mix_size", "mix_key", "mix_draw", "mix_of", "mix_passes", "mix_cut", "mix_ends", "mix_place")
    return dict(zip(names, common.fresh(docs, *names)))


def _keyed(docs: DataFrame, seed: int, n: dict[str, str]) -> DataFrame:
    """Adds mix_size (words) and mix_key (60 bits of a hash of seed, doc_id and text)."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 4)
    return docs.withColumns({n["mix_size"]: common.n_words(F.col("text")), n["mix_key"]: key})


def plan_mix(keyed: DataFrame, share: float, most: float, cycle: tuple) -> list[Plan]:
    """Targets per source and the key below which the last, partial pass draws.

    ``keyed``: (source, mix_size, mix_key).  The cut is found digit by digit:
    a histogram of words over 1024 blocks, then over the 1024 parts of the
    block in which the target falls, and so on.  What comes to the driver is
    one row for each source and one histogram of 1024 numbers for each source
    and level, whatever the input; nothing is sorted.
    """
    spark = keyed.sparkSession
    sizes = {r[0]: int(r[1]) for r in keyed.groupBy("source").agg(F.sum("mix_size")).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    target = water_fill(sizes, {s: cycle[i % len(cycle)] for i, s in enumerate(order)}, share * sum(sizes.values()), most)
    plans, want = {}, {}
    for s in order:
        passes = min(int(target[s] // sizes[s]), math.ceil(most)) if sizes[s] else 0
        plans[s] = Plan(s, sizes[s], target[s], passes, 0)
        want[s] = target[s] - passes * sizes[s]
    want = {s: w for s, w in want.items() if w > 0}
    for level in range(DIGITS):
        if not want:
            break
        shift = DIGIT_BITS * (DIGITS - level)
        heads = _per_source(spark, [(s, plans[s].cut >> shift) for s in want], "of string, head long")
        inside = keyed.join(heads, F.col("source").eqNullSafe(F.col("of")) & (F.shiftrightunsigned("mix_key", shift) == F.col("head")))
        found = inside.groupBy("of", _digit(F.col("mix_key"), level).alias("digit")).agg(F.sum("mix_size").alias("words"), F.count("*").alias("n"), F.min("mix_key").alias("least"), F.max("mix_key").alias("most"))
        by: dict = {}
        for r in found.collect():
            by.setdefault(r[0], {})[r[1]] = r
        for s in list(want):
            step = 1 << (DIGIT_BITS * (DIGITS - 1 - level))
            for digit in range(BLOCKS):
                r = by.get(s, {}).get(digit)
                words = int(r["words"]) if r else 0
                if words > want[s]:
                    plans[s].cut += digit * step
                    if r["least"] == r["most"]:  # one document, or copies of it, which stay together: the nearer side
                        plans[s].cut += step if words - want[s] < want[s] else 0
                        del want[s]
                    break
                want[s] -= words
            else:
                plans[s].cut += BLOCKS * step
                del want[s]
    return [plans[s] for s in order]


def _dealt(keyed: DataFrame, plans: list[Plan], seed: int, shards: int, n: dict[str, str]) -> DataFrame:
    """A row for each draw that the splitting tree places: ``keyed`` with mix_draw, mix_shard and mix_order, in mixed order."""
    spark = keyed.sparkSession
    quotas = np.array([BLOCKS * p.passes + (p.cut + (1 << 50) - 1 >> 50) for p in plans], dtype=np.int64)
    per_shard = split_quotas(quotas, shards, np.random.default_rng(seed)) if len(plans) else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(per_shard, axis=0)
    rows = [(p.source, p.passes, p.cut, ends[:, i].tolist()) for i, p in enumerate(plans)]
    where = _per_source(spark, rows, f"{n['mix_of']} string, {n['mix_passes']} long, {n['mix_cut']} long, {n['mix_ends']} array<long>")
    joined = keyed.join(where, F.col("source").eqNullSafe(F.col(n["mix_of"])))
    draws = F.col(n["mix_passes"]) + (F.col(n["mix_key"]) < F.col(n["mix_cut"])).cast("long")
    drawn = joined.withColumn(n["mix_draw"], F.explode(F.when(draws > 0, F.sequence(F.lit(0).cast("long"), draws - 1)).otherwise(F.array().cast("array<long>"))))
    block = F.col(n["mix_draw"]) * BLOCKS + F.shiftrightunsigned(n["mix_key"], DIGIT_BITS * (DIGITS - 1))
    placed = drawn.withColumn("mix_shard", F.size(F.filter(n["mix_ends"], lambda e: e <= block))).where(F.col("mix_shard") < shards)
    placed = placed.withColumn("mix_order", F.xxhash64(F.lit(seed + 1), n["mix_key"], n["mix_draw"]))
    placed = placed.drop(*[n[c] for c in ("mix_of", "mix_passes", "mix_cut", "mix_ends")])
    return placed.repartition("mix_shard", F.shiftright("mix_order", 64 - PART_BITS)).sortWithinPartitions("mix_shard", "mix_order")


def mix_digest(docs: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple = (3, 1, 2), seed: int = 17, shards: int = 64) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, draws, counted from the draws as dealt; see :func:`mix_sources`.

    Null and empty texts have size 0 and take nothing.  Rows that repeat a
    doc_id with its text are drawn alike, each with the same numbers; a null
    doc_id or source is a value like others.  An empty table gives no rows;
    other columns are left out.
    """
    docs = docs.select("doc_id", "text", "source")
    keyed = common.stored(_keyed(docs, seed, n := _names(docs)).drop("text"), "mix-keys")
    plans = plan_mix(keyed.select("source", "mix_size", "mix_key"), share, most, cycle)
    dealt = common.stored(_dealt(keyed, plans, seed, shards, n).select("doc_id", "source", "mix_key", "mix_draw", "mix_shard", "mix_order"), "mix-dealt")
    # Rows with equal doc_id and text share their draws: each draw counts once for each of them.
    drawn = dealt.groupBy(F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_from"), F.col("mix_key").alias("mix_at")).agg(F.count_distinct("mix_draw").alias("found"))
    rows = keyed.join(drawn, (F.col("mix_key") == F.col("mix_at")) & F.col("doc_id").eqNullSafe(F.col("mix_doc")) & F.col("source").eqNullSafe(F.col("mix_from")), "left")
    of = _per_source(docs.sparkSession, [(p.source, p.size, p.target) for p in plans], "mix_source string, source_size long, target double")
    rows = rows.withColumn("draws", F.coalesce("found", F.lit(0)).cast("long")).join(of, F.col("source").eqNullSafe(F.col("mix_source")), "left")
    return rows.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("draws")).alias("taken"), "draws")


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple = (3, 1, 2), seed: int = 17, shards: int = 64) -> DataFrame:
    """The mix itself: a row for each draw of a document, all columns of ``docs`` plus mix_shard INT and mix_order LONG.

    Sources in code-point order (null last) weigh ``cycle`` in turn and share
    ``share`` times all words; targets stop at ``most`` times their source.  A
    source's documents fall by a hash of doc_id and text into 1024 blocks, a
    random permutation.  It is drawn whole as often as the target holds it;
    the last pass draws blocks in order until the target is reached, the last
    of them in part, so words taken miss the target by half a document at
    most.  A splitting tree shares every source's block draws among
    the output shards exactly; each shard takes the next blocks of the
    permutation, so draws are disjoint, and mix_order shuffles inside a shard.
    The rows are moved to that place: partitions hold ranges of mix_order of
    shards, sorted by mix_shard and mix_order.

    Null or empty texts have size 0, and are drawn with their block.  Rows with
    equal doc_id and text share a key: they are drawn alike.  A null source is
    a source of its own.  An empty table gives an empty mix.  Own columns are
    kept, but for ones named mix_shard or mix_order, which are replaced.
    """
    docs = docs.drop("mix_shard", "mix_order")
    keyed = _keyed(docs, seed, n := _names(docs))
    plans = plan_mix(common.stored(keyed.select("source", F.col(n["mix_size"]).alias("mix_size"), F.col(n["mix_key"]).alias("mix_key")), "mix-keys"), share, most, cycle)
    return _dealt(keyed, plans, seed, shards, n).select(*docs.columns, "mix_shard", "mix_order")
