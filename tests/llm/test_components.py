"""Connected components: any order of nodes, and rows joined in proportion to the edges."""

import random

import pytest

from roadweave.llm import common


def by_hand(edges):
    """The smallest node that each one reaches."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def shuffled(n, seed=3):
    nodes = list(range(-n, n, 2))
    random.Random(seed).shuffle(nodes)
    return nodes


def joined_rows(spark, run):
    """What ``run`` gives, and how many rows all of its joins made."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before, out = int(store.executionsCount()), run()
    bus.waitUntilEmpty()
    runs, rows = store.executionsList(before, 1 << 20), 0
    for i in range(runs.size()):
        metrics, nodes = store.executionMetrics(runs.apply(i).executionId()), store.planGraph(runs.apply(i).executionId()).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and metrics.contains(m.accumulatorId()):
                    rows += int(metrics.apply(m.accumulatorId()).replace(",", ""))
    return out, rows


def found(spark, edges):
    return {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}


@pytest.mark.parametrize("edges", [
    [],
    [(4, 4), (7, 7)],
    [(4, 4), (9, 4), (4, 9), (9, 4)],
    [(50, i) for i in range(50)],
    [(i, i + 1) for i in range(300)],
    list(zip(shuffled(300), shuffled(300)[1:])),  # a long chain whose nodes come in no order
    [(random.Random(i).randrange(200), random.Random(-i - 1).randrange(200)) for i in range(110)],
], ids=["none", "loops", "repeated", "star", "chain", "shuffled chain", "forest"])
def test_components_equal_those_by_hand(spark, edges):
    assert found(spark, edges) == by_hand(edges)


def test_joins_make_rows_in_proportion_to_the_edges(spark):
    """A group in which each of n nodes is linked with 40 others: a round joins only edges that lead from one tree to another."""
    made = {}
    for n in (200, 400):
        nodes = shuffled(n)
        edges = [(nodes[i], nodes[(i + j) % n]) for i in range(n) for j in range(1, 21)]
        got, made[n] = joined_rows(spark, lambda edges=edges: found(spark, edges))
        assert got == by_hand(edges)
        assert made[n] < 4 * len(edges)
    assert made[400] < 3 * made[200]
