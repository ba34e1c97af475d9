"""Polygon queries: each vector gives a star-shaped polygon around a place of its own, with a square hole.

Corner k of 32 lies at the angle of k 32ths of a turn and at a distance of 1 + number 2k + number 2k + 1 (a fifth at least).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo, polygons
from ..functions.rounding import half_even
from .registry import query, table

CORNERS = 32
HOLE = 0.1
WINDOW = (3.05, 4.05, 11.45, 12.35)
_COS = [round(math.cos(2 * math.pi * k / CORNERS), 12) for k in range(CORNERS)]
_SIN = [round(math.sin(2 * math.pi * k / CORNERS), 12) for k in range(CORNERS)]


def _polygons(spark: SparkSession, sf: str) -> DataFrame:
    """id, label and the polygon, its rings closed as in files."""
    at = lambda i: F.get("embedding", i).cast("double")
    x0, y0 = (F.col("vec_id") * 37 % 101) * 0.2, (F.col("vec_id") * 61 % 97) * 0.2
    turn = lambda table_, k: F.element_at(F.array(*[F.lit(v) for v in table_]), k + 1)

    def corner(k):
        return geo.let(F.greatest(F.lit(0.2), 1.0 + at(2 * k) + at(2 * k + 1)), lambda r: geo.point(x0 + r * turn(_COS, k), y0 + r * turn(_SIN, k)))

    outer = F.transform(F.sequence(F.lit(0), F.lit(CORNERS)), lambda k: corner(k % CORNERS))
    square = [(-HOLE, -HOLE), (HOLE, -HOLE), (HOLE, HOLE), (-HOLE, HOLE), (-HOLE, -HOLE)]
    hole = F.array(*[geo.point(x0 + dx, y0 + dy) for dx, dy in square])
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.array(outer, hole).alias("polygon"))


def _rings_sql() -> str:
    """rings: id, label, no, ring (list of x and y), without the repeated vertex."""
    x0, y0 = "(vec_id * 37 % 101) * 0.2::double", "(vec_id * 61 % 97) * 0.2::double"
    r = "greatest(0.2::double, 1.0::double + embedding[2 * k + 1]::double + embedding[2 * k + 2]::double)"
    listed = lambda values: "[" + ", ".join(f"{v!r}::double" for v in values) + "]"
    hole = ", ".join(f"{{'x': {x0} + ({dx}), 'y': {y0} + ({dy})}}" for dx, dy in ((-HOLE, -HOLE), (HOLE, -HOLE), (HOLE, HOLE), (-HOLE, HOLE)))
    outer = f"list_transform(range(0, {CORNERS}), lambda k: {{'x': {x0} + {r} * {listed(_COS)}[k + 1], 'y': {y0} + {r} * {listed(_SIN)}[k + 1]}})"
    return f"rings as (select vec_id as id, label, 0 as no, {outer} as ring from embeddings union all select vec_id, label, 1, [{hole}] from embeddings)"


def _half_sql(source: str, name: str, axis: str, above: bool, bound: float) -> str:
    other, op = ("y" if axis == "x" else "x"), (">=" if above else "<=")
    a, b = "ring[case when i = 1 then len(ring) else i - 1 end]", "ring[i]"
    share = f"(({bound!r}::double - {a}.{axis}) / ({b}.{axis} - {a}.{axis}))"
    met = {axis: f"{bound!r}::double", other: f"{a}.{other} + {share} * ({b}.{other} - {a}.{other})"}
    cross = f"[{{'x': {met['x']}, 'y': {met['y']}}}]"
    kept = f"case when {a}.{axis} {op} {bound!r} then case when {b}.{axis} {op} {bound!r} then [{b}] else {cross} end when {b}.{axis} {op} {bound!r} then list_concat({cross}, [{b}]) else [] end"
    return f"{name} as (select id, label, no, flatten(list_transform(range(1, len(ring) + 1), lambda i: {kept})) as ring from {source} where len(ring) >= 1)"


def _area_sql(ring: str = "ring") -> str:
    b = f"{ring}[case when i = len({ring}) then 1 else i + 1 end]"
    term = f"(({ring}[i].x - {ring}[1].x) * ({b}.y - {ring}[1].y) - ({b}.x - {ring}[1].x) * ({ring}[i].y - {ring}[1].y))"
    return f"(list_sum(list_transform(range(1, len({ring}) + 1), lambda i: {term})) / 2)"


_CLIPPED = ", ".join([_rings_sql(), *(_half_sql("rings" if k == 0 else f"h{k - 1}", f"h{k}", axis, above, WINDOW[place]) for k, (axis, above, place) in enumerate(polygons._SIDES))])
_SUMS = f"s as (select id, min(label) as label, sum(case when no = 0 then abs({_area_sql()}) else -abs({_area_sql()}) end) as area, sum(len(ring))::bigint as vertices, count(*) as rings, count(*) filter (where no = 0) as outer_rings from {{}} where len(ring) >= 3 group by id)"


@query(f"with {_rings_sql()}, {_SUMS.format('rings')} select id, round_even(area * 1e6, 0) / 1e6 as area, vertices, (select {_area_sql()} > 0 from rings r where r.id = s.id and no = 0) as counter_clockwise from s")
def polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    """Area, vertices and direction of the polygons as they are."""
    p = _polygons(spark, sf).withColumn("polygon", F.transform("polygon", polygons.opened))
    vertices = F.aggregate(F.transform("polygon", F.size), F.lit(0).cast("long"), lambda s, n: s + n)
    return p.select("id", half_even(polygons.area(F.col("polygon")), 6).alias("area"), vertices.alias("vertices"), (polygons.signed_area(F.get("polygon", F.lit(0))) > 0).alias("counter_clockwise"))


@query(f"with {_CLIPPED}, {_SUMS.format('h3')} select id, round_even(area * 1e6, 0) / 1e6 as area, vertices, rings from s where outer_rings = 1")
def polygon_clip(spark: SparkSession, sf: str) -> DataFrame:
    """What a window leaves of every polygon."""
    left = polygons.clip_to_window(_polygons(spark, sf), WINDOW)
    vertices = F.aggregate(F.transform("polygon", F.size), F.lit(0).cast("long"), lambda s, n: s + n)
    return left.select("id", half_even(polygons.area(F.col("polygon")), 6).alias("area"), vertices.alias("vertices"), F.size("polygon").cast("long").alias("rings"))


@query(f"with {_CLIPPED}, {_SUMS.format('h3')} select case when label = 3 then 'own' else 'others' end as part, count(*) as n, round_even(sum(area) * 1e4, 0) / 1e4 as area from s where outer_rings = 1 group by 1")
def basemap_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The clipped polygons of one name beside those of all others."""
    own, others = polygons.split_by_name(_polygons(spark, sf).withColumn("name", F.col("label").cast("string")), "3")
    out = None
    for part, layer in (("own", own), ("others", others)):
        left = polygons.clip_to_window(layer, WINDOW).select(F.lit(part).alias("part"), polygons.area(F.col("polygon")).alias("area"))
        out = left if out is None else out.unionByName(left)
    return out.groupBy("part").agg(F.count("*").alias("n"), half_even(F.sum("area"), 4).alias("area"))
