"""Nearest points of clustered data against all distances."""

import numpy as np
import pandas as pd
import pytest

from roadweave.operators import nearest


def cloud(kind, n, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "even":
        return rng.random((n, 2))
    if kind == "clustered":  # nine tenths in a hundredth of the box, and one far away
        dense = np.concatenate([rng.random((9 * n // 10, 2)) * 0.1 + 0.3, rng.random((n - 9 * n // 10 - 1, 2))])
        return np.concatenate([dense, [[4e4, 5e4]]])
    if kind == "equal":  # a third at one place
        p = rng.random((n, 2))
        p[: n // 3] = 0.5
        return p
    return np.column_stack([rng.integers(0, 9, n), np.zeros(n)]).astype(float)  # ties on a line


def expected(t, s, k, others):
    out = []
    for i, (x, y) in enumerate(t):
        d = np.sqrt((s[:, 0] - x) * (s[:, 0] - x) + (s[:, 1] - y) * (s[:, 1] - y))
        order = [j for j in np.lexsort((np.arange(len(s)), d)) if not (others and j == i)][:k]
        out += [(i, int(j), float(d[j]), r) for r, j in enumerate(order, 1)]
    return sorted(out)


def points(spark, xy):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))


@pytest.mark.parametrize("kind", ["even", "clustered", "equal", "ties"])
@pytest.mark.parametrize("few, others, k", [(4096, True, 5), (0, True, 5), (0, False, 3)])
def test_nearest_points(spark, kind, few, others, k):
    s = cloud(kind, 900)
    t = s if others else cloud(kind, 300, seed=4)
    got = nearest.nearest_points(points(spark, t), points(spark, s), k, others=others, cap=16, few=few)
    assert sorted(map(tuple, got.collect())) == expected(t, s, k, others)


def test_fewer_sources_than_asked_and_missing_places(spark):
    t, s = points(spark, cloud("even", 5)), points(spark, cloud("even", 3, seed=9))
    for few in (100, 0):
        assert nearest.nearest_points(t, s, 7, few=few, cap=1).count() == 15
    gap = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0)], "id long, x double, y double")
    assert nearest.nearest_points(gap, s, 1).count() == 0 and nearest.nearest_points(t, gap, 1).count() == 0
    assert nearest.nearest_points(t.limit(0), s, 1, few=0).count() == 0


def test_visits_grow_with_targets_not_with_clusters():
    """Of points of which nine tenths share a hundredth of the box, with one far away, each visits cells of a bounded number of sources."""
    xy = cloud("clustered", 40_000)
    square = nearest.Square(0.0, 0.0, 5e4)
    codes, levels, cap = square.codes(xy[:, 0], xy[:, 1]), [], 64
    crowded, above = None, 0
    while crowded is None or len(crowded):
        below = min(nearest.BITS, above + 6)
        cells = codes >> 2 * (nearest.BITS - below)
        if crowded is not None:
            cells = cells[np.isin(cells >> 2 * (below - above), crowded)]
        levels.append((*np.unique(cells, return_counts=True), above, below))
        tree, crowded, above = nearest.grow(levels, square, cap)
    assert tree.count.max() <= cap and tree.count.sum() == len(xy)
    home = tree.cell_of(xy[:, 0], xy[:, 1])
    assert (np.bincount(home, minlength=len(tree.count)) == tree.count).all()
    pairs = 0
    for c in np.unique(home)[::40]:
        own = np.flatnonzero(home == c)
        i, cells = tree.visits(xy[own, 0], xy[own, 1], 5)
        pairs = max(pairs, tree.count[cells].sum() / len(own))
    assert pairs <= 16 * cap
