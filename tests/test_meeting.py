"""Lines that meet tile by tile, against all pairs; and that the work does not grow with the square of the lines where it need not."""

import math
import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from roadweave.operators import meeting, spatial

SCHEMA = "id {}, line array<struct<x:double,y:double>>"


def scattered(n, seed=5, size=6.0, reach=1.0):
    """Lines of 2 to 5 vertices, some far longer than others."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, far = rng.uniform(0, size), rng.uniform(0, size), reach * (5 if i % 17 == 0 else 1)
        out.append((i, [(x + rng.uniform(-far, far), y + rng.uniform(-far, far)) for _ in range(rng.randint(2, 5))]))
    return out


def gap(p, a, b):
    d = ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) or 1.0
    t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d))
    return math.hypot(a[0] + t * (b[0] - a[0]) - p[0], a[1] + t * (b[1] - a[1]) - p[1])


def apart(m, o):
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    least = math.inf
    for a, b in zip(m, m[1:]):
        for c, d in zip(o, o[1:]):
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return 0.0
            least = min(least, gap(a, c, d), gap(b, c, d), gap(c, a, b), gap(d, a, b))
    return least


def frame(spark, lines, kind="long"):
    return spark.createDataFrame([(str(i) if kind == "string" else i, [{"x": x, "y": y} for x, y in p]) for i, p in lines], SCHEMA.format(kind))


@pytest.mark.parametrize("least, kind", [(1 << 15, "string"), (16, "long")])
def test_pairs_equal_all_pairs(spark, monkeypatch, least, kind):
    monkeypatch.setattr(meeting, "LEAST", least)
    lines = scattered(60)
    df = frame(spark, lines, kind)
    got = {(int(r["l"]), int(r["r"])): r["distance"] for r in spatial.pairs_within(df, df, 0.1, others=True).collect()}
    want = {(i, j): d for i, m in lines for j, o in lines if i != j and (d := apart(m, o)) <= 0.1}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_odd_rows(spark):
    """Lines without a place or with one vertex meet nothing; vertices without one break a line; rows of one id are one line; a null id is not another one."""
    nan, none = float("nan"), None
    rows = [(1, [(0.0, 0.0), (1.0, 0.0)]), (1, [(5.0, 0.0), (6.0, 0.0)]), (2, [(0.0, 0.05), (nan, 0.0), (5.5, 0.05), (5.6, 0.05)]), (3, [(0.0, 0.0)]), (4, []), (5, none), (6, [(none, 1.0), (0.0, 0.0)]), (none, [(0.0, 0.0), (1.0, 0.0)])]
    df = spark.createDataFrame([(i, None if p is None else [{"x": x, "y": y} for x, y in p]) for i, p in rows], SCHEMA.format("long"))
    assert sorted((r["l"], r["r"], round(r["distance"], 9)) for r in spatial.pairs_within(df, df, 0.1, others=True).collect()) == [(1, 2, 0.05), (2, 1, 0.05)]
    assert sum(r["l"] is None for r in spatial.pairs_within(df, df, 0.1).collect()) == 2
    nothing = df.where("id = 4")
    assert spatial.pairs_within(nothing, df, 0.1).count() == 0 and spatial.clip_pieces(df, nothing, 0.1).count() == 0


@pytest.mark.parametrize("least", [1 << 15, 16])
def test_nearest_equal_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(meeting, "LEAST", least)
    lines = [*scattered(40, 7, 30.0, 0.5), (99, [(400.0, 400.0), (401.0, 400.0)])]
    df = frame(spark, lines)
    got = {r["target"]: (r["donor"], r["distance"]) for r in spatial.nearest_lines(df, df, 1.0, others=True).collect()}
    for i, m in lines:
        d, j = min((round(apart(m, o), 9), j) for j, o in lines if j != i)
        assert got[i][0] == j and abs(got[i][1] - d) < 1e-6


def steps(kind, lines, **settings):
    """What the work of one tile returns, and how many pairs of edges it compared."""
    table = lambda name: pa.table({name: [i for i, _ in lines], **{c: [[p[k] for p in line] for _, line in lines] for k, c in enumerate("xy")}, "n": [[len(line)] for _, line in lines], "x0": [0] * len(lines), "y0": [0] * len(lines)})
    compared = []
    own = meeting.distances
    meeting.distances = lambda *a: (compared.append(len(a[0])), own(*a))[1]
    try:
        at = kind((0, 0), meeting.Lines(table("l"), "l"), cell=None, others=True, **settings)
        rows = [b for source in (at.add(meeting.Lines(table("r"), "r")), at.end()) for b in source]
    finally:
        meeting.distances = own
    return sum(b.num_rows for b in rows), sum(compared)


def crossing(n):
    """Lines of ten edges through one another, nearly all with all."""
    rng = np.random.default_rng(3)
    return [(i, [(k / 10, rng.uniform(0, 1)) for k in range(11)]) for i in range(n)]


def test_nearest_of_crossing_lines_grows_with_the_lines(monkeypatch):
    monkeypatch.setattr(meeting, "FIRST", 64)
    few, many = (steps(meeting.Nearest, crossing(n), radius=0.4) for n in (200, 800))
    assert many[0] == 800 and many[1] < 6 * few[1] and many[1] < 800 * 800 * 10 / 20


def test_pieces_are_merged_where_they_are_found(monkeypatch):
    monkeypatch.setattr(meeting, "FIRST", 64)
    few, many = (steps(meeting.Pieces, crossing(n), radius=0.02) for n in (200, 800))
    assert many[0] <= 1.5 * 10 * 800 and many[1] < 8 * few[1]


def test_pairs_are_not_shuffled(spark):
    """Of lines that all meet, only lines go through a shuffle."""
    df = frame(spark, crossing(20))
    plan = spatial.matched_segments(spatial_traces(df), df, 0.5, others=True)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert not any(k in above for k in ("Join", "Aggregate", "Repartition", "Sort"))


def spatial_traces(df):
    from pyspark.sql import functions as F

    return df.withColumns({"a": F.try_element_at("line", F.lit(1)), "b": F.try_element_at("line", F.lit(-1))})


def test_filters_equal_all_pairs(spark):
    """Direction and ends of all pairs, by hand."""
    lines = scattered(40, 11)
    df = frame(spark, lines)
    lengths = lambda p: [math.dist(a, b) for a, b in zip(p, p[1:])]
    turn = lambda a, b: math.degrees(math.atan2(b[1] - a[1], b[0] - a[0])) % 180

    def fits(m, o, angle, reach):
        c = [sum(s * (a[k] + b[k]) / 2 for s, a, b in zip(lengths(o), o, o[1:])) / sum(lengths(o)) for k in (0, 1)]
        k = min(range(len(m) - 1), key=lambda k: (gap(c, m[k], m[k + 1]), k))
        t = abs(turn(o[0], o[-1]) - turn(m[k], m[k + 1])) % 180
        off = reach is None or math.dist(m[0], m[-1]) < 2 * reach or (math.dist(c, m[0]) >= reach and math.dist(c, m[-1]) >= reach)
        return (angle is None or min(t, 180 - t) <= angle) and off

    for angle, reach in ((45.0, None), (None, 0.7), (45.0, 0.7)):
        got = spatial.matched_segments(spatial_traces(df), df, 0.1, angle, reach, others=True)
        assert {(r["trace_id"], r["segment_id"]) for r in got.collect()} == {(i, j) for i, m in lines for j, o in lines if i != j and apart(m, o) <= 0.1 and fits(m, o, angle, reach)}
