"""Plane geometry as column expressions over lines: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

LINE = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def axis(line: Column, name: str) -> Column:
    """One coordinate of all vertices."""
    return F.transform(line, lambda p: p[name].cast("double"))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it; keeps expression trees small."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def span(p: Column, q: Column) -> Column:
    """Distance of two points."""
    return F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))


def edges(line: Column) -> Column:
    """array<struct<a, b>> of consecutive vertices."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def has_parts(df: DataFrame, column: str = "line") -> bool:
    """Whether a column holds lines of many parts, ARRAY of lines, rather than lines."""
    return isinstance(df.schema[column].dataType.elementType, ArrayType)


def all_edges(line: Column, parts: bool = False) -> Column:
    """The edges of a line, or of all parts of one of many, part after part; none leads from one part to the next."""
    return F.flatten(F.transform(line, edges)) if parts else edges(line)


def longest(parts: Column) -> Column:
    """The longest part of a line of many, the first of equals."""
    best = F.array_max(F.transform(parts, lambda p, i: F.struct(length(p).alias("l"), (-i).alias("i"), p.alias("p"))))
    return best["p"]


def length(line: Column, parts: bool = False) -> Column:
    """Length of a line; 0 of null and of lines under two vertices."""
    return F.coalesce(F.aggregate(F.transform(all_edges(line, parts), lambda e: span(e["a"], e["b"])), F.lit(0.0), lambda s, d: s + d), F.lit(0.0))


def centroid(line: Column, parts: bool = False) -> Column:
    """Length-weighted mean of the edges' middles; the first vertex of a line without length."""
    first = F.try_element_at(F.flatten(line) if parts else line, F.lit(1))

    def mean(axis: str) -> Column:
        moment = F.aggregate(F.transform(all_edges(line, parts), lambda e: span(e["a"], e["b"]) * (e["a"][axis] + e["b"][axis]) / 2), F.lit(0.0), lambda s, d: s + d)
        return F.when(length(line, parts) > 0, moment / length(line, parts)).otherwise(first[axis])

    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def direction(a: Column, b: Column) -> Column:
    """Angle of the way from ``a`` to ``b`` in degrees, modulo 180."""
    return F.pmod(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])), F.lit(180.0))


def line_angle(line: Column, parts: bool = False) -> Column:
    """Angle end to end, modulo 180; of a line of many parts that of the longest."""
    if parts:
        return let(longest(line), lambda p: line_angle(p))
    return direction(F.try_element_at(line, F.lit(1)), F.try_element_at(line, F.lit(-1)))


def angle_between(a: Column, b: Column) -> Column:
    """Folded difference of two directions, 0 to 90."""
    return let(F.pmod(F.abs(a - b), F.lit(180.0)), lambda d: F.least(d, 180.0 - d))


def point_edge(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from an edge."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    place = let(dx * dx + dy * dy, lambda square: F.when(square > 0, ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / square).otherwise(0.0))

    def gap(t: Column) -> Column:
        x, y = a["x"] + t * dx - p["x"], a["y"] + t * dy - p["y"]
        return F.sqrt(x * x + y * y)

    return let(F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)), gap)


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def edge_edge(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Distance of two edges: 0 if they cross, else the least of end to edge."""
    cross = (_turn(a, b, c) * _turn(a, b, d) < 0) & (_turn(c, d, a) * _turn(c, d, b) < 0)
    return F.when(cross, 0.0).otherwise(F.least(point_edge(a, c, d), point_edge(b, c, d), point_edge(c, a, b), point_edge(d, a, b)))


def box(line: Column) -> Column:
    """STRUCT<xmin, ymin, xmax, ymax>."""
    x, y = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def edge_meets_box(a: Column, b: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Whether an edge meets a box: the parameters at which it is inside both slabs leave an interval."""
    low, high, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for axis, lo, hi in (("x", xmin, xmax), ("y", ymin, ymax)):
        d = b[axis] - a[axis]
        t, u = F.try_divide(F.lit(float(lo)) - a[axis], d), F.try_divide(F.lit(float(hi)) - a[axis], d)
        low, high = F.greatest(low, F.least(t, u)), F.least(high, F.greatest(t, u))
        inside = inside & ((d != 0) | a[axis].between(float(lo), float(hi)))
    return inside & (low <= high)
