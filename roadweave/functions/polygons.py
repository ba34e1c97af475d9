"""Polygons as column expressions: ARRAY of rings, the outer one first, then holes; a ring is an ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>.

Rings may repeat their first vertex at the end, as file formats do, or not; results don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import let, point

POLYGON = "array<array<struct<x:double,y:double>>>"
#: The sides of a box: axis, whether what is larger stays, and the place of its bound in (xmin, ymin, xmax, ymax).
_SIDES = (("x", True, 0), ("x", False, 2), ("y", True, 1), ("y", False, 3))


def opened(ring: Column) -> Column:
    """A ring without the repeated first vertex."""
    closed = (F.size(ring) > 1) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)))
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def _around(ring: Column) -> Column:
    """array<struct<a, b>>: the edges of an opened ring, the one that ends at its first vertex first."""
    last = F.slice(ring, F.greatest(F.size(ring), F.lit(1)), F.lit(1))
    before = F.concat(last, F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))
    return F.zip_with(before, ring, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(ring: Column) -> Column:
    """Area of a ring, positive when it runs counter-clockwise; measured from its first vertex, so that far places lose no digits."""
    first = F.try_element_at(ring, F.lit(1))

    def term(e: Column) -> Column:
        return (e["a"]["x"] - first["x"]) * (e["b"]["y"] - first["y"]) - (e["b"]["x"] - first["x"]) * (e["a"]["y"] - first["y"])

    return F.coalesce(F.aggregate(F.transform(_around(ring), term), F.lit(0.0), lambda s, t: s + t), F.lit(0.0)) / 2


def area(polygon: Column) -> Column:
    """Area of the outer ring less that of the holes, however they run; 0 of null and empty ones."""
    sizes = F.transform(polygon, lambda ring, i: F.when(i == 0, F.abs(signed_area(ring))).otherwise(-F.abs(signed_area(ring))))
    return F.coalesce(F.aggregate(sizes, F.lit(0.0), lambda s, a: s + a), F.lit(0.0))


def oriented(polygon: Column) -> Column:
    """Opened rings, the outer one counter-clockwise and holes clockwise, each still beginning at its own first vertex."""

    def turned(ring: Column, i: Column) -> Column:
        keep = (signed_area(ring) >= 0) == (i == 0)
        back = F.concat(F.slice(ring, F.lit(1), F.lit(1)), F.reverse(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))))
        return F.when(keep, ring).otherwise(back)

    return F.transform(F.transform(polygon, opened), turned)


def _half(axis: str, above: bool, bound: Column):
    """A function of an opened ring that gives its part on one side of a line: each edge gives its crossing, if it has one, and its end, if that stays."""
    other = "y" if axis == "x" else "x"
    stays = lambda p: p[axis] >= bound if above else p[axis] <= bound

    def kept(e: Column) -> Column:
        a, b = e["a"], e["b"]
        share = (bound - a[axis]) / (b[axis] - a[axis])
        met = {axis: bound.cast("double"), other: a[other] + share * (b[other] - a[other])}
        cross = F.array(point(met["x"], met["y"]))
        end = F.array(point(b["x"], b["y"]))
        return F.when(stays(a), F.when(stays(b), end).otherwise(cross)).otherwise(F.when(stays(b), F.concat(cross, end)).otherwise(F.slice(end, F.lit(1), F.lit(0))))

    return lambda ring: F.flatten(F.transform(_around(ring), kept))


def with_clipped(df: DataFrame, polygon: str, out: str, box: tuple) -> DataFrame:
    """``df`` with ``polygon`` cut to a box (xmin, ymin, xmax, ymax: numbers or columns) as ``out``; null where nothing is left.

    Every ring is cut by the four sides one after another (Sutherland and
    Hodgman), each step a column of its own, so that no step computes the ones
    before it again.  Parts that fall apart stay joined along the box's sides.
    Holes that vanish go; with the outer ring's last three vertices the polygon goes.
    """
    step, dropped = polygon, []
    for k, (axis, above, place) in enumerate(_SIDES):
        name = f"_side{k}"
        bound = box[place] if isinstance(box[place], Column) else F.lit(float(box[place]))
        source = F.transform(F.col(step), opened) if k == 0 else F.col(step)
        df = df.withColumn(name, F.transform(source, _half(axis, above, bound)))
        step = name
        dropped.append(name)
    rings = F.filter(F.col(step), lambda ring: F.size(ring) >= 3)
    whole = F.size(F.try_element_at(F.col(step), F.lit(1))) >= 3
    return df.withColumn(out, F.when(whole, rings)).drop(*(c for c in dropped if c != out))


def meets_box(polygon: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Whether the boxes of the polygon and of a window overlap: the cheap test before clipping."""

    def reach(ring: Column) -> Column:
        x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
        return (F.array_max(x) >= xmin) & (F.array_min(x) <= xmax) & (F.array_max(y) >= ymin) & (F.array_min(y) <= ymax)

    return F.coalesce(let(F.try_element_at(polygon, F.lit(1)), reach), F.lit(False))


def contains(polygon: Column, p: Column) -> Column:
    """Whether a point lies inside: a ray from it meets the rings' edges an odd number of times.  Points on an edge belong to one of its sides."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        return F.when(spans, (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0)

    count = F.aggregate(F.flatten(F.transform(polygon, lambda ring: F.transform(_around(opened(ring)), crossed))), F.lit(0), lambda s, n: s + n)
    return F.coalesce(count % 2 == 1, F.lit(False))


def clip_to_window(polygons: DataFrame, window: tuple[float, float, float, float], column: str = "polygon") -> DataFrame:
    """``polygons`` cut to a window: rows whose box misses it never reach the cut, and rows of which nothing is left go."""
    near = polygons.where(meets_box(F.col(column), *window))
    return with_clipped(near, column, column, window).where(F.col(column).isNotNull())


def split_by_name(layer: DataFrame, name: str, column: str = "name") -> tuple[DataFrame, DataFrame]:
    """The rows of one name, and all others, those without a name among them."""
    own = F.col(column).eqNullSafe(F.lit(name))
    return layer.where(own), layer.where(~own)
