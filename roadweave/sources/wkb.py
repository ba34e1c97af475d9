"""Geometries in WKB, and lines and rings as columns."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

from ..functions.geometry import edges, longest, point_edge  # noqa: F401  longest is part of this module's interface

PARTS = ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)


def parts(data: bytes) -> list[list[tuple[float, float]]]:
    """The points of every part of a geometry: points, lines, or rings one after another; heights and measures are left out."""

    def read(at: int) -> tuple[list, int]:
        order = "<" if data[at] == 1 else ">"
        code = struct.unpack_from(f"{order}I", data, at + 1)[0]
        at += 9 if code & 0x20000000 else 5  # an identifier of the reference system may follow
        kind, more = code & 0xFF if code >= 1 << 28 else code % 1000, (code >> 31 & 1) + (code >> 30 & 1) if code >= 1 << 28 else {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        width = 2 + more

        def points(n: int, at: int) -> tuple[list, int]:
            flat = struct.unpack_from(f"{order}{width * n}d", data, at)
            return list(zip(flat[::width], flat[1::width])), at + 8 * width * n

        if kind == POINT:
            return (lambda p: ([p[0]], p[1]))(points(1, at))
        n = struct.unpack_from(f"{order}I", data, at)[0]
        at += 4
        if kind == LINE:
            got, at = points(n, at)
            return [got], at
        out = []
        if kind == POLYGON:
            for _ in range(n):
                got, at = points(struct.unpack_from(f"{order}I", data, at)[0], at + 4)
                out.append(got)
            return out, at
        if kind in (MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION):
            for _ in range(n):
                got, at = read(at)
                out += got
            return out, at
        raise ValueError(f"geometry kind {kind} is not known")

    return read(0)[0]


def envelope(data: bytes) -> tuple[float, float, float, float] | None:
    """(xmin, ymin, xmax, ymax) of a geometry; none if it is empty."""
    every = [p for part in parts(data) for p in part if p[0] == p[0]]
    if not every:
        return None
    x, y = zip(*every)
    return min(x), min(y), max(x), max(y)


def line(points: list[tuple[float, float]]) -> bytes:
    return struct.pack("<BII", 1, LINE, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


def polygon(rings: list[list[tuple[float, float]]]) -> bytes:
    """Rings are closed as the format asks."""
    closed = [r if not r or r[0] == r[-1] else [*r, r[0]] for r in rings]
    return struct.pack("<BII", 1, POLYGON, len(closed)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in closed)


def multi_line(lines: list[list[tuple[float, float]]]) -> bytes:
    return struct.pack("<BII", 1, MULTILINE, len(lines)) + b"".join(map(line, lines))


def _pairs(points) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in points]


@F.pandas_udf(BinaryType())
def to_wkb(lines: pd.Series) -> pd.Series:
    """WKB of ARRAY<STRUCT<x, y>> lines."""
    return lines.map(lambda x: None if x is None else line(_pairs(x)))


@F.pandas_udf(BinaryType())
def polygon_to_wkb(polygons: pd.Series) -> pd.Series:
    """WKB of polygons, ARRAY of rings."""
    return polygons.map(lambda x: None if x is None else polygon([_pairs(r) for r in x]))


@F.pandas_udf(BinaryType())
def lines_to_wkb(lines: pd.Series) -> pd.Series:
    """WKB of lines of many parts."""
    return lines.map(lambda x: None if x is None else multi_line([_pairs(r) for r in x]))


@F.pandas_udf(PARTS)
def parts_of(wkb: pd.Series) -> pd.Series:
    """ARRAY<ARRAY<STRUCT<x, y>>>: the parts of WKB lines, or the rings of polygons."""
    return wkb.map(lambda b: None if b is None else [[{"x": x, "y": y} for x, y in part] for part in parts(bytes(b))])


def nearest_part(lines: Column, point: Column) -> Column:
    """The part of a multi-line nearest to ``point``, the first of equals."""
    gap = lambda p: F.array_min(F.transform(edges(p), lambda e: point_edge(point, e["a"], e["b"])))
    best = F.array_min(F.transform(lines, lambda p, i: F.struct(gap(p).alias("d"), i.alias("i"), p.alias("p"))))
    return best["p"]
