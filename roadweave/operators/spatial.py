"""Spatial joins by tile and grid cell, nearest features, the filter chain of measured segments, and clipping.

Lines are (id, line) with line ARRAY<STRUCT<x, y>>, or ARRAY of such for
lines of many parts, whose edges are numbered part after part and never lead
from one part to the next; points are (id, x, y).  No
operator compares all with all: lines meet tile by tile (see meeting), edges
by the cells of a grid, and exact predicates refine.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from . import meeting
from .nearest import nearest_points  # noqa: F401  part of this module's interface
from .scratch import cut

DISTANCE_M, ANGLE_DEG, NODES_M, CLIP_M, SEARCH_M = 400.0, 45.0, 3000.0, 2000.0, 1500.0


def _own(lines: DataFrame, id_: str, others: bool, more: tuple = ()) -> DataFrame:
    rows = lines.select(F.col(id_).alias("id"), "line", *more)
    return rows.where("id is not null") if others else rows  # a null id is not another one


def _whole(lines: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """A row for each id: its rows as one line of many parts, and ``more``."""
    parts = F.when(F.flatten("line").isNotNull(), F.col("line")) if geo.has_parts(lines) else F.when(F.col("line").isNotNull(), F.array("line"))
    return lines.groupBy("id").agg(F.flatten(F.collect_list(parts)).alias("line"), *[v.alias(k) for k, v in (more or {}).items()])


def _vertices(df: DataFrame, column: str) -> dict[str, Column]:
    """Columns of a line's vertices as arrays of numbers."""
    parts = geo.has_parts(df, column)
    p = F.flatten(column) if parts else F.col(column)
    axes = {f"{column}_{c}": F.coalesce(geo.axis(p, c), F.array().cast("array<double>")) for c in "xy"}
    return axes | {f"{column}_n": F.when(p.isNull(), F.array().cast("array<int>")).otherwise(F.transform(column, F.size) if parts else F.array(F.size(column)))}


def pairs_within(left: DataFrame, right: DataFrame, radius: float, left_id: str = "id", right_id: str = "id", cell: float | None = None, others: bool = False, keep: tuple = (), angle: float | None = None, reach: float | None = None) -> DataFrame:
    """(l, r, distance, the columns ``keep`` of the right rows) of all pairs of lines at most ``radius`` apart; rows of one id count as one line.

    With ``others`` lines don't meet their own id.

    ``angle``: only pairs whose right line runs along the left one where that
    is nearest to the right one's centroid.  A right line's direction is end to
    end; the left one's that of its edge nearest to the centroid, the first of
    equals.  ``left`` may have ``course``, the line whose edges count for that.

    ``reach``: only pairs whose right centroid keeps off both ends, ``a`` and
    ``b`` of ``left``; all, if these are less than twice the reach apart.
    """
    course = "course" if "course" in left.columns else "line"
    more_l = {"course": F.any_value(course, True)} if angle is not None else {}
    more_l |= {k: F.any_value(k, True) for k in "ab"} if reach is not None else {}
    lines = _whole(_own(left, left_id, others, tuple({course, *"ab"[: 2 * (reach is not None)]} - {"line"})), more_l)
    segments = _whole(_own(right, right_id, others, keep), {"kept": F.collect_list(F.struct(*keep))} if keep else {})
    more_l, more_r = _vertices(lines, "course") if angle is not None else {}, {}
    if reach is not None:
        more_l |= {k + c: F.col(f"{k}.{c}") for k in "ab" for c in "xy"}
    if angle is not None or reach is not None:
        c = geo.centroid(F.col("line"), True)
        more_r = {"px": c["x"], "py": c["y"], "own": geo.line_angle(F.col("line"), True)}
    more_r |= {"kept": F.col("kept")} if keep else {}
    schema = T.StructType([T.StructField("l", lines.schema["id"].dataType), T.StructField("r", segments.schema["id"].dataType), T.StructField("distance", T.DoubleType()), *([segments.schema["kept"]] if keep else [])])
    work = partial(meeting.Pairs, radius=radius, cell=cell, others=others, keep=("kept",) * bool(keep), angle=angle, reach=reach)
    found = meeting.meet(lines, segments, radius, work, schema, more_l, more_r)
    return found.select("l", "r", "distance", F.inline("kept")) if keep else found


def nearest_lines(targets: DataFrame, sources: DataFrame, radius: float, target_id: str = "id", source_id: str = "id", rounds: int = 40, cell: float | None = None, others: bool = False) -> DataFrame:
    """(target, donor, distance): the source line nearest to each target, the smallest id of equals.

    Searches within ``radius``, then, for targets that found none, within twice that, and so on; without sources no rows.
    A target that touches a source is done with the first it touches, by id.
    """
    left, sources = _own(targets, target_id, others), _own(sources, source_id, others)
    out, empty = None, sources.isEmpty()
    schema = T.StructType([T.StructField("l", left.schema["id"].dataType), T.StructField("r", sources.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    for _ in range(rounds):
        found = meeting.meet(left, sources, radius, partial(meeting.Nearest, radius=radius, cell=cell, others=others), schema)
        found = found.groupBy(F.col("l").alias("target")).agg(F.min(F.struct("distance", F.col("r").alias("donor"))).alias("best"))
        found = cut(found.select("target", "best.donor", "best.distance"))
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(found, left["id"] == found["target"], "left_anti"))
        if empty or left.where(F.size("line") > 1).isEmpty():
            return out
        radius *= 2
    raise RuntimeError("targets lie farther from any source than the last radius")


def matched_segments(traces: DataFrame, segments: DataFrame, distance: float = DISTANCE_M, angle: float | None = ANGLE_DEG, reach: float | None = NODES_M, cell: float | None = None, others: bool = False, keep: tuple = ()) -> DataFrame:
    """(trace_id, segment_id, distance, ``keep``) of the segments that pass the filters by distance, by direction and by the trace's ends; see :func:`pairs_within`.

    ``traces``: id, line, a, b (the ends' points), course; ``segments``: id, line.  Without an angle or a reach that filter passes all.
    """
    near = pairs_within(traces, segments, distance, cell=cell, others=others, keep=keep, angle=angle, reach=reach)
    return near.withColumnsRenamed({"l": "trace_id", "r": "segment_id"})


def clip_pieces(traces: DataFrame, roads: DataFrame, radius: float = CLIP_M, cell: float | None = None, others: bool = False) -> DataFrame:
    """(id, edge_no, t0, t1, length): the maximal parts of each trace edge within ``radius`` of any road.

    Overlapping intervals merge by gaps and islands, first where they are
    found, then over (trace, edge), so neither a buffer nor a union is ever
    built, and what is shuffled grows with the edges, not with the pairs.
    """
    left, right = _own(traces, "id", others), _own(roads, "id", others)
    schema = T.StructType([T.StructField("l", left.schema["id"].dataType), T.StructField("l_no", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("span", "t0", "t1")]])
    rows = meeting.meet(left, right, radius, partial(meeting.Pieces, radius=radius, cell=cell, others=others), schema)
    edge = Window.partitionBy("l", "l_no").orderBy("t0", "t1")
    reach = F.max("t1").over(edge.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("island", (reach.isNull() | (F.col("t0") > reach)).cast("int")).withColumn("island", F.sum("island").over(edge))
    found = rows.groupBy("l", "l_no", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("span").alias("span"))
    return found.select(F.col("l").alias("id"), F.col("l_no").alias("edge_no"), "t0", "t1", ((F.col("t1") - F.col("t0")) * F.col("span")).alias("length"))


def clipped_lengths(traces: DataFrame, roads: DataFrame, radius: float = CLIP_M, cell: float | None = None, others: bool = False) -> DataFrame:
    """(id, length, inside): every trace's length and its length within ``radius`` of the roads, 0 where none is near."""
    inside = clip_pieces(traces, roads, radius, cell, others).groupBy("id").agg(F.sum("length").alias("inside"))
    own = traces.select("id", geo.length(F.col("line"), geo.has_parts(traces)).alias("length"))
    return own.join(inside, "id", "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))


def total_bounds(lines: DataFrame, margin: float = 0.0) -> DataFrame:
    """One row: the box of all lines, grown by a share of its larger side."""
    points = F.flatten("line") if geo.has_parts(lines) else F.col("line")
    b = lines.select(geo.box(points).alias("b")).agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))
    grow = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) * margin
    return b.select((F.col("xmin") - grow).alias("xmin"), (F.col("ymin") - grow).alias("ymin"), (F.col("xmax") + grow).alias("xmax"), (F.col("ymax") + grow).alias("ymax"))


def point_box(points: DataFrame, margin: float, least: float) -> DataFrame:
    """One row: the box of all points (x, y), grown by a share of its larger side, by ``least`` at least."""
    b = points.agg(*[f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    grow = F.greatest(F.lit(least), margin * F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))
    return b.select(*[(F.col(c) + (grow if c.endswith("max") else -grow)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def in_window(line: Column, xmin: float, ymin: float, xmax: float, ymax: float, parts: bool = False) -> Column:
    """Whether a line meets a box."""
    return F.coalesce(F.exists(geo.all_edges(line, parts), lambda e: geo.edge_meets_box(e["a"], e["b"], xmin, ymin, xmax, ymax)), F.lit(False))
