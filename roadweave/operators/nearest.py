"""The nearest points of clustered data, through a quadtree whose cells each hold a bounded number of sources."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import cut

#: Sources in a cell, targets searched together, and cells the driver and the tasks hold at most, about.
CAP, CHUNK, MOST_CELLS = 512, 4096, 1 << 18
#: Halvings of the box along each axis at most.
BITS = 26
#: Up to so many sources are sent to all tasks, and nothing is shuffled.
FEW = 4096


def _spread(v: np.ndarray) -> np.ndarray:
    """Each bit of a number at every second place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | v << shift) & mask
    return v


def _gather(v: np.ndarray) -> np.ndarray:
    """The bits at every second place as a number."""
    v = v & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | v >> shift) & mask
    return v


@dataclass
class Square:
    """The box of all points, as a square."""

    x: float
    y: float
    side: float

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places along the curve that visits cell after cell, finer and finer: the cells of a level are ranges of it."""
        at = lambda v, low: np.clip(np.floor((v - low) / self.side * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64)
        return _spread(at(x, self.x)) | _spread(at(y, self.y)) << 1


@dataclass
class Tree:
    """The cells of a quadtree, those without sources too, in the order of the curve: they cover the square without overlap."""

    square: Square
    start: np.ndarray
    level: np.ndarray
    count: np.ndarray

    def __post_init__(self):
        size = 2.0 ** (BITS - self.level)
        unit = self.square.side / (1 << BITS)
        x, y = _gather(self.start).astype(float), _gather(self.start >> 1).astype(float)
        self.x0, self.y0 = self.square.x + x * unit, self.square.y + y * unit
        self.x1, self.y1 = self.x0 + size * unit, self.y0 + size * unit

    def cell_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, self.square.codes(x, y), "right") - 1

    def visits(self, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``x``, cell) of all cells that may hold one of the ``k`` nearest sources of the points, which lie near each other.

        A point's k nearest lie within the radius at which cells that hold k
        sources end; cells that begin beyond it can't hold any of them.
        """
        slack = 1e-9 * self.square.side
        bx0, bx1, by0, by1 = x.min(), x.max(), y.min(), y.max()
        held = np.flatnonzero(self.count > 0)
        far = np.hypot(np.maximum(bx1 - self.x0[held], self.x1[held] - bx0), np.maximum(by1 - self.y0[held], self.y1[held] - by0))
        order = np.argsort(far, kind="stable")
        enough = min(np.searchsorted(np.cumsum(self.count[held[order]]), k), len(order) - 1)
        reach = far[order[enough]] + slack
        near = np.hypot(np.maximum(0, np.maximum(self.x0[held] - bx1, bx0 - self.x1[held])), np.maximum(0, np.maximum(self.y0[held] - by1, by0 - self.y1[held])))
        some = held[near <= reach]
        points, cells = [], []
        step = max(1, (1 << 22) // max(1, len(some)))
        for lo in range(0, len(x), step):
            px, py = x[lo : lo + step, None], y[lo : lo + step, None]
            out = np.hypot(np.maximum(px - self.x0[some], self.x1[some] - px), np.maximum(py - self.y0[some], self.y1[some] - py))
            order = np.argsort(out, axis=1, kind="stable")
            total = np.cumsum(self.count[some][order], axis=1)
            at = np.minimum((total < k).sum(axis=1), len(some) - 1)
            own = np.take_along_axis(out, np.take_along_axis(order, at[:, None], axis=1), axis=1) + slack
            gap = np.hypot(np.maximum(0, np.maximum(self.x0[some] - px, px - self.x1[some])), np.maximum(0, np.maximum(self.y0[some] - py, py - self.y1[some])))
            i, j = np.nonzero(gap <= own)
            points.append(i + lo)
            cells.append(some[j])
        return np.concatenate(points), np.concatenate(cells)


def grow(levels: list[tuple[np.ndarray, np.ndarray, int, int]], square: Square, cap: int) -> tuple[Tree, np.ndarray, int]:
    """The tree of histograms (cells, counts, level above, their level), each of the crowded cells of the one before; and what it leaves crowded at which level."""
    start, level, count = [], [], []
    crowded, last = np.zeros(1, np.int64), 0
    for cells, counts, above, below in levels:
        for depth in range(above + 1, below + 1):
            up = 2 * (below - depth)
            own, at = np.unique(cells >> up, return_inverse=True)
            n = np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)
            children = np.sort((crowded[:, None] << 2 | np.arange(4)).ravel())
            here = np.zeros(len(children), np.int64)
            held = np.searchsorted(own, children)
            ok = (held < len(own)) & (own[np.minimum(held, len(own) - 1)] == children) if len(own) else np.zeros(len(children), bool)
            here[ok] = n[held[ok]]
            split = (here > cap) & (depth < BITS)
            start.append(children[~split] << 2 * (BITS - depth))
            level.append(np.full((~split).sum(), depth))
            count.append(here[~split])
            crowded, last = children[split], depth
            if not len(crowded):
                break
        if not len(crowded):
            break
    order = np.argsort(np.concatenate(start), kind="stable")
    return Tree(square, *(np.concatenate(v)[order] for v in (start, level, count))), crowded, last


def quadtree(points: DataFrame, square: Square, n: int, cap: int) -> Tree:
    """The tree over ``points`` (x, y), from counts of ever finer cells; after the first, only crowded cells are counted."""
    step = max(1, min(8, int(math.log(max(4.0, MOST_CELLS * 4 / max(1.0, n / cap)), 4))))
    levels, crowded, above = [], None, 0
    code = F.pandas_udf(lambda x, y: pd.Series(square.codes(x.to_numpy(float), y.to_numpy(float))), T.LongType())
    coded = points.select(code("x", "y").alias("code"))
    while True:
        below = min(BITS, above + step)
        rows = coded.select(F.shiftright("code", 2 * (BITS - below)).alias("cell"))
        if crowded is not None:
            few = points.sparkSession.createDataFrame(pd.DataFrame({"up": crowded}), "up long")
            rows = rows.withColumn("up", F.shiftright("cell", 2 * (below - above))).join(F.broadcast(few), "up", "left_semi")
        got = rows.groupBy("cell").agg(F.count("*").alias("n")).toPandas()  # of at most 4 ** step cells for each crowded one
        levels.append((got["cell"].to_numpy(np.int64), got["n"].to_numpy(np.int64), above, below))
        tree, crowded, above = grow(levels, square, cap)
        if not len(crowded):
            return tree


def closest(tid: np.ndarray, tx: np.ndarray, ty: np.ndarray, sid: np.ndarray, sx: np.ndarray, sy: np.ndarray, k: int, others: bool) -> pd.DataFrame:
    """target, source, distance: the k best sources of each target by (distance, source)."""
    out = []
    for lo in range(0, len(tid), step := max(1, (1 << 21) // max(1, len(sid)))):
        x, y, own = tx[lo : lo + step, None], ty[lo : lo + step, None], tid[lo : lo + step]
        d = np.sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y))
        if others:
            d[own[:, None] == sid] = np.inf
        kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(sid) > k else np.full((len(own), 1), np.inf)
        i, j = np.nonzero((d <= kth) & (d < np.inf))
        order = np.lexsort((sid[j], d[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, i, "left")
        keep = np.arange(len(i)) - first < k
        i, j = i[keep], j[keep]
        out.append(pd.DataFrame({"target": own[i], "source": sid[j], "distance": d[i, j]}))
    return pd.concat(out) if out else pd.DataFrame({"target": np.empty(0, np.int64), "source": np.empty(0, np.int64), "distance": np.empty(0)})


FOUND = "target long, source long, distance double"


def _with_few(batches, sources: tuple, k: int, others: bool) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield closest(b["id"].to_numpy(np.int64), b["x"].to_numpy(float), b["y"].to_numpy(float), *sources, k, others)


def _visits(batches, tree: Tree, k: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        x, y = b["x"].to_numpy(float), b["y"].to_numpy(float)
        home = tree.cell_of(x, y)
        order = np.argsort(home, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            i, cells = tree.visits(x[at], y[at], k)
            yield pd.DataFrame({"cell": cells, "id": b["id"].to_numpy(np.int64)[at[i]], "x": x[at[i]], "y": y[at[i]]})


def _search(k: int, others: bool):
    def search(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return closest(t["id"].to_numpy(np.int64), t["x"].to_numpy(float), t["y"].to_numpy(float), s["id"].to_numpy(np.int64), s["x"].to_numpy(float), s["y"].to_numpy(float), k, others)

    return search


def nearest_points(targets: DataFrame, sources: DataFrame, k: int, others: bool = False, cap: int = CAP, few: int = FEW) -> DataFrame:
    """(target, source, distance, rank): the ``k`` nearest sources of each target, by (distance, id); fewer if there are fewer.

    Both are (id, x, y); rows without a place take no part.  With ``others`` a
    target's own id, which one source has at most, is no source of it.

    Sources are counted in ever finer cells, and cells split in four until
    each holds at most ``cap`` (more at very many sources, so that there are
    about ``MOST_CELLS`` at most).  From the counts alone each target knows a
    radius that holds k sources, and visits the cells that begin within it:
    a few, however sources cluster.  Targets and sources of a cell meet in
    groups of bounded size: cells with many visitors are dealt by these, and
    cells that can't be split, of many sources at one place, by sources.
    Up to ``few`` sources go to all tasks instead.
    """
    place = lambda df: df.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xy"]).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    targets, sources = place(targets), place(sources)
    ends = [F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]]
    box = sources.agg(*ends).first()
    schema, n = f"{FOUND}, rank int", box["n"]
    if not n:
        return targets.sparkSession.createDataFrame([], schema)
    if n <= few:
        rows = sources.toPandas()
        arrays = rows["id"].to_numpy(np.int64), rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        found = targets.mapInPandas(partial(_with_few, sources=arrays, k=k, others=others), FOUND)
    else:
        area = targets.agg(*ends).first()
        if not area["n"]:
            return targets.sparkSession.createDataFrame([], schema)
        low = {c: min(box[f"lo_{c}"], area[f"lo_{c}"]) for c in "xy"}
        side = max(max(box[f"hi_{c}"], area[f"hi_{c}"]) - low[c] for c in "xy")
        found = _through_tree(targets, sources, Square(low["x"], low["y"], side or 1.0), n, k, others, max(cap, 4 * n // MOST_CELLS))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("distance", "source"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _through_tree(targets: DataFrame, sources: DataFrame, square: Square, n: int, k: int, others: bool, cap: int) -> DataFrame:
    tree = quadtree(sources, square, n, cap)
    cell = F.pandas_udf(lambda x, y: pd.Series(tree.cell_of(x.to_numpy(float), y.to_numpy(float))), T.LongType())
    near = targets.withColumn("home", cell("x", "y")).repartition("home", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("home").drop("home")
    visits = cut(near.mapInPandas(partial(_visits, tree=tree, k=k + others), "cell long, id long, x double, y double"))
    held = sources.withColumn("cell", cell("x", "y"))
    full = np.flatnonzero(tree.count > cap)
    parts = targets.sparkSession.createDataFrame(pd.DataFrame({"cell": full, "parts": -(-tree.count[full] // cap)}), "cell long, parts int")  # cells of the smallest size
    in_parts = lambda df, no: df.join(F.broadcast(parts), "cell", "left").withColumn("part", no(F.coalesce("parts", F.lit(1)))).drop("parts")
    held = in_parts(held, lambda m: F.pmod(F.xxhash64("id", "x", "y"), m).cast("int"))
    visits = in_parts(visits, lambda m: F.explode(F.sequence(F.lit(0), m - 1)))
    crowds = visits.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    dealt = lambda df, no: df.join(crowds, "cell", "left").withColumn("chunk", no(F.coalesce("chunks", F.lit(1)))).drop("chunks")
    visits = dealt(visits, lambda m: F.pmod(F.xxhash64("id"), m).cast("int"))
    held = dealt(held, lambda m: F.explode(F.sequence(F.lit(0), m - 1)))
    key = ["cell", "part", "chunk"]
    return visits.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(_search(k, others), FOUND)
