"""Spatial queries: embeddings give stations (their first two numbers) and lines.

A line has all 64 numbers as 32 vertices, drawn out eastward from a place of its own: vertex k lies at
(0.1 k + number 2k, number 2k + 1) from there.  Every line meets every other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.crs import Lambert
from ..functions.rounding import half_even
from ..operators import impute, methods, spatial
from .registry import query, table

VERTICES, STEP = 32, 0.1
_VERTICES_SQL = f"{VERTICES}::bigint"
RADIUS, CELL, REACH = 0.02, 0.1, 0.5


def _r(expr: str, digits: int = 6) -> str:
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits}"


def _line() -> Column:
    at = lambda i: F.get("embedding", i).cast("double")
    x0, y0 = (F.col("vec_id") * 37 % 101) * 0.2, (F.col("vec_id") * 61 % 97) * 0.2
    return F.transform(F.sequence(F.lit(0), F.lit(VERTICES - 1)), lambda k: geo.point(x0 + k * STEP + at(2 * k), y0 + at(2 * k + 1)))


def _lines(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    return table(spark, sf, "embeddings").where(where).select(F.col("vec_id").alias("id"), _line().alias("line"))


def _x(no: str) -> str:
    return f"((vec_id * 37 % 101) * 0.2::double + ({no}) * {STEP}::double + embedding[2 * ({no}) + 1]::double)"


def _y(no: str) -> str:
    return f"((vec_id * 61 % 97) * 0.2::double + embedding[2 * ({no}) + 2]::double)"


# SQL forms of the plane geometry, over scalar coordinates.
def _span(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"


def _point_edge(p: str, a: str, b: str) -> str:
    """Distance of point (p||x, p||y) from edge ab."""
    dx, dy = f"({b}x - {a}x)", f"({b}y - {a}y)"
    t = f"greatest(0, least(1, coalesce((({p}x - {a}x) * {dx} + ({p}y - {a}y) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0)))"
    x, y = f"({a}x + {t} * {dx} - {p}x)", f"({a}y + {t} * {dy} - {p}y)"
    return f"sqrt({x} * {x} + {y} * {y})"


def _edge_edge(a: str, b: str, c: str, d: str) -> str:
    turn = lambda p, q, r: f"sign(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
    cross = f"{turn(a, b, c)} * {turn(a, b, d)} < 0 and {turn(c, d, a)} * {turn(c, d, b)} < 0"
    return f"case when {cross} then 0 else least({_point_edge(a, c, d)}, {_point_edge(b, c, d)}, {_point_edge(c, a, b)}, {_point_edge(d, a, b)}) end"


def _edges_sql(name: str, p: str, q: str) -> str:
    """A table of edges: id, no, and the coordinates of their ends named p and q."""
    return f"{name} as materialized (select vec_id as {p}id, no as {p}no, {_x('no')} as {p}x, {_y('no')} as {p}y, {_x('no + 1')} as {q}x, {_y('no + 1')} as {q}y from embeddings, (select unnest(range(0, {VERTICES - 1})) as no))"


@query(f"with {_edges_sql('e', 'a', 'q')} select aid as id, {_r('sum(' + _span('ax', 'ay', 'qx', 'qy') + ')')} as length from e group by aid")
def line_length(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("id", half_even(geo.length(F.col("line")), 6).alias("length"))


_S = _span("ax", "ay", "qx", "qy")


@query(f"with {_edges_sql('e', 'a', 'q')} select aid as id, {_r(f'sum({_S} * (ax + qx) / 2) / sum({_S})')} as x, {_r(f'sum({_S} * (ay + qy) / 2) / sum({_S})')} as y from e group by aid")
def line_centroid(spark: SparkSession, sf: str) -> DataFrame:
    c = _lines(spark, sf).select("id", geo.centroid(F.col("line")).alias("c"))
    return c.select("id", half_even(F.col("c.x"), 6).alias("x"), half_even(F.col("c.y"), 6).alias("y"))


def _angle(dx: str, dy: str) -> str:
    a = f"degrees(atan2({dy}, {dx}))"
    return f"(case when {a} < 0 then {a} + 180 when {a} >= 180 then {a} - 180 else {a} end)"


_LAST = str(VERTICES - 1)
_ENDS = f"{_x(_LAST)} - {_x('0')}", f"{_y(_LAST)} - {_y('0')}"


@query(f"select vec_id as id, {_r(_angle(*_ENDS))} as angle from embeddings")
def line_angle(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("id", half_even(geo.line_angle(F.col("line")), 6).alias("angle"))


_D = f"abs({_angle(*_ENDS)} - (vec_id * 7 % 180))"


@query(f"select vec_id as id, {_r(f'least({_D}, 180 - {_D})')} as diff from embeddings")
def angle_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("id", half_even(geo.angle_between(geo.line_angle(F.col("line")), (F.col("id") * 7 % 180).cast("double")), 6).alias("diff"))


# Lines whose boxes are near enough, then their edges.  Nearest ones: no farther than the nearest first vertex is.
_BOXES = "x as materialized (select aid as id, min(least(ax, qx)) as x0, max(greatest(ax, qx)) as x1, min(least(ay, qy)) as y0, max(greatest(ay, qy)) as y1, max(ax) filter (where ano = 0) as fx, max(ay) filter (where ano = 0) as fy from l group by aid)"
_GAP = "sqrt(pow(greatest(0, m.x0 - o.x1, o.x0 - m.x1), 2) + pow(greatest(0, m.y0 - o.y1, o.y0 - m.y1), 2))"
_FOUND = f"near as materialized (select l.aid as l, r.cid as r, min({_edge_edge('a', 'q', 'c', 'd')}) as distance from pairs join l on l.aid = pairs.m join r on r.cid = pairs.o group by l.aid, r.cid)"
_BOTH = f"{_edges_sql('l', 'a', 'q')}, {_edges_sql('r', 'c', 'd')}, {_BOXES}"
_PAIRS = f"{_BOTH}, pairs as materialized (select m.id as m, o.id as o from x m join x o on m.id <> o.id and {_GAP} <= {RADIUS}), {_FOUND}"


def _nearest_sql(m: str, o: str) -> str:
    """near: for each line that is ``m`` the distances of the ``o`` that may be nearest."""
    return f"""{_BOTH}, f as materialized (select m.id, min({_span('m.fx', 'm.fy', 'o.fx', 'o.fy')}) as most from x m join x o on m.id <> o.id join embeddings em on em.vec_id = m.id join embeddings eo on eo.vec_id = o.id where {m} and {o} group by m.id),
pairs as materialized (select m.id as m, o.id as o from x m join f on f.id = m.id join x o on m.id <> o.id and {_GAP} <= f.most join embeddings eo on eo.vec_id = o.id where {o}), {_FOUND}"""


@query(f"with {_PAIRS} select l, r, {_r('distance')} as distance from near where distance <= {RADIUS}")
def filter_distance(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    return spatial.pairs_within(lines, lines, RADIUS, cell=CELL, others=True).withColumn("distance", half_even(F.col("distance"), 6))


@query(f"with {_nearest_sql('true', 'true')} select l as target, r as donor, {_r('distance')} as distance from (select *, row_number() over (partition by l order by distance, r) as k from near) where k = 1")
def line_distance(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest other line of every line."""
    lines = _lines(spark, sf)
    found = spatial.nearest_lines(lines, lines, 4 * CELL, others=True)
    return found.withColumn("distance", half_even(F.col("distance"), 6))


_VALUE = "case when {}embedding[60] >= 0 then {}embedding[60]::double end"


@query(f"with {_nearest_sql('em.embedding[60] < 0', 'eo.embedding[60] >= 0')}, n as (select *, row_number() over (partition by l order by distance, r) as k from near) select e.vec_id as ID_ARC, {_r('coalesce(' + _VALUE.format('f.', 'f.') + ', ' + _VALUE.format('e.', 'e.') + ')')} as value, n.r as donor, n.l is not null as borrowed from embeddings e left join n on n.l = e.vec_id and k = 1 left join embeddings f on f.vec_id = n.r")
def borrow_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without a value take that of the nearest line that has one."""
    value = F.get("embedding", F.lit(59)).cast("double")
    arcs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ID_ARC"), F.when(value >= 0, value).alias("djma_m1"))
    nearest = spatial.nearest_lines(_lines(spark, sf, "embedding[59] < 0"), _lines(spark, sf, "embedding[59] >= 0"), 4 * CELL)
    out = methods.borrow(arcs, nearest.withColumnRenamed("target", "ID_ARC"))
    return out.select("ID_ARC", half_even(F.col("djma_m1"), 6).alias("value"), F.col("djma_arc_source").alias("donor"), F.col("djma_complete").alias("borrowed"))


# A segment's direction is end to end; the trace's is that of its edge nearest to the segment's centroid, the first of equals.
_LENGTH, _END = _span("cx", "cy", "dx", "dy"), VERTICES - 2
_CHAIN_TAIL = f"""
c as materialized (select cid, sum({_LENGTH} * (cx + dx) / 2) / sum({_LENGTH}) as px, sum({_LENGTH} * (cy + dy) / 2) / sum({_LENGTH}) as py,
    {_angle(f'max(dx) filter (where cno = {_END}) - max(cx) filter (where cno = 0)', f'max(dy) filter (where cno = {_END}) - max(cy) filter (where cno = 0)')} as own from r group by cid),
o as (select aid, max(ax) filter (where ano = 0) as sx, max(ay) filter (where ano = 0) as sy, max(qx) filter (where ano = {_END}) as tx, max(qy) filter (where ano = {_END}) as ty from l group by aid),
d as (select near.l, near.r, near.distance, own, px, py, {_angle('qx - ax', 'qy - ay')} as along, row_number() over (partition by near.l, near.r order by {_point_edge('p', 'a', 'q')}, ano) as k
    from near join c on c.cid = near.r join l on l.aid = near.l where distance <= {RADIUS}),
f as (select d.*, least(abs(own - along), 180 - abs(own - along)) <= 45 as aligned, {_span('sx', 'sy', 'tx', 'ty')} < {2 * REACH} or not ({_span('px', 'py', 'sx', 'sy')} < {REACH} or {_span('px', 'py', 'tx', 'ty')} < {REACH}) as off from d join o on o.aid = d.l where k = 1)"""
_CHAIN = f"{_PAIRS},{_CHAIN_TAIL}"


def _traces(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"a": F.try_element_at("line", F.lit(1)), "b": F.try_element_at("line", F.lit(-1))})


@query(f"with {_CHAIN} select l, r from f where aligned")
def filter_direction(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    return spatial.pairs_within(lines, lines, RADIUS, cell=CELL, others=True, angle=45.0).select("l", "r")


@query(f"with {_CHAIN} select l, r from f where off")
def filter_proximity(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    return spatial.pairs_within(_traces(lines), lines, RADIUS, cell=CELL, others=True, reach=REACH).select("l", "r")


@query(f"with {_CHAIN} select l as trace_id, r as segment_id, {_r('distance')} as distance from f where aligned and off")
def filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    found = spatial.matched_segments(_traces(lines), lines, RADIUS, 45.0, REACH, cell=CELL, others=True)
    return found.withColumn("distance", half_even(F.col("distance"), 6))


def _within_sql(value: str, slope: str, lo: str, hi: str, edge: str) -> str:
    f, end = ("least", "-1e300") if edge == "lo" else ("greatest", "1e300")
    return f"case when {slope} <> 0 then {f}(({lo} - {value}) / {slope}, ({hi} - {value}) / {slope}) when {value} between {lo} and {hi} then {end}::double end"


def _disc_sql(half: str, rest: str, sign: str) -> str:
    return f"case when dd > 0 and {half} * {half} - dd * {rest} >= 0 then (-{half} {sign} sqrt({half} * {half} - dd * {rest})) / dd end"


# Of every edge the parts within the radius of an edge of another line (a disc at either end of that, and a slab between), merged, as lengths.
_CLIP_TAIL = f"""
e as materialized (select l.aid as id, l.ano as no, qx - ax as ex, qy - ay as ey, dx - cx as ux, dy - cy as uy, ax - cx as wx, ay - cy as wy, ax - dx as zx, ay - dy as zy from pairs join l on l.aid = pairs.m join r on r.cid = pairs.o
    and greatest(ax, qx) + {RADIUS} >= least(cx, dx) and greatest(cx, dx) + {RADIUS} >= least(ax, qx) and greatest(ay, qy) + {RADIUS} >= least(cy, dy) and greatest(cy, dy) + {RADIUS} >= least(ay, qy)),
t as (select id, no, ex * ex + ey * ey as dd, ux * ux + uy * uy as uu, wx * ex + wy * ey as wd, zx * ex + zy * ey as zd, wx * wx + wy * wy - {RADIUS * RADIUS!r}::double as ww, zx * zx + zy * zy - {RADIUS * RADIUS!r}::double as zz,
    wx * ux + wy * uy as al, ex * ux + ey * uy as ab, ux * wy - uy * wx as ac, ux * ey - uy * ex as bc, {RADIUS} * sqrt(ux * ux + uy * uy) as h from e),
k as (select id, no, dd, {_disc_sql('wd', 'ww', '-')} as w0, {_disc_sql('wd', 'ww', '+')} as w1, {_disc_sql('zd', 'zz', '-')} as z0, {_disc_sql('zd', 'zz', '+')} as z1,
    {_within_sql('al', 'ab', '0', 'uu', 'lo')} as a0, {_within_sql('al', 'ab', '0', 'uu', 'hi')} as a1, {_within_sql('ac', 'bc', '-h', 'h', 'lo')} as c0, {_within_sql('ac', 'bc', '-h', 'h', 'hi')} as c1 from t),
s as (select *, case when a0 is not null and c0 is not null and greatest(a0, c0) <= least(a1, c1) then greatest(a0, c0) end as s0, case when a0 is not null and c0 is not null and greatest(a0, c0) <= least(a1, c1) then least(a1, c1) end as s1 from k),
i as (select distinct id, no, dd, greatest(0, least(coalesce(w0, 1e300), coalesce(z0, 1e300), coalesce(s0, 1e300))) as t0, least(1, greatest(coalesce(w1, -1e300), coalesce(z1, -1e300), coalesce(s1, -1e300))) as t1 from s),
g as (select *, case when t0 <= max(t1) over (partition by id, no order by t0, t1 rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from i where t0 < t1),
n as (select *, sum(new) over (partition by id, no order by t0, t1 rows unbounded preceding) as island from g),
p as (select id, no, (max(t1) - min(t0)) * sqrt(min(dd)) as length from n group by id, no, island)"""
_CLIP = f"{_BOTH}, pairs as materialized (select m.id as m, o.id as o from x m join x o on m.id <> o.id and {_GAP} <= {RADIUS}),{_CLIP_TAIL}"


@query(f"with {_CLIP} select y.id, {_r('y.length')} as length, {_r('coalesce(z.inside, 0)')} as inside from (select aid as id, sum({_span('ax', 'ay', 'qx', 'qy')}) as length from l group by aid) y left join (select id, sum(length) as inside from p group by id) z on z.id = y.id")
def clip_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of lines and of their parts near other lines."""
    lines = _lines(spark, sf)
    got = spatial.clipped_lengths(lines, lines, RADIUS, cell=CELL, others=True)
    return got.select("id", half_even(F.col("length"), 6).alias("length"), half_even(F.col("inside"), 6).alias("inside"))


_XY = f"(select {_x('no')} as x, {_y('no')} as y from embeddings, (select unnest(range(0, {VERTICES})) as no))"


@query(f"with b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from {_XY}) select {', '.join(_r(e) + ' as ' + n for n, e in (('xmin', 'x0 - greatest(x1 - x0, y1 - y0) * 0.05'), ('ymin', 'y0 - greatest(x1 - x0, y1 - y0) * 0.05'), ('xmax', 'x1 + greatest(x1 - x0, y1 - y0) * 0.05'), ('ymax', 'y1 + greatest(x1 - x0, y1 - y0) * 0.05')))} from b")
def bbox_total(spark: SparkSession, sf: str) -> DataFrame:
    b = spatial.total_bounds(_lines(spark, sf), 0.05)
    return b.select(*[half_even(F.col(c), 6).alias(c) for c in b.columns])


_WINDOW = (4.0, 6.0, 8.0, 10.5)


def _meets_sql() -> str:
    """Whether edge aq meets the window: clipped by both slabs something is left."""
    x0, y0, x1, y1 = _WINDOW
    lo, hi = [], []
    for v, a, b in (("x", x0, x1), ("y", y0, y1)):
        d = f"nullif(q{v} - a{v}, 0)"
        lo.append(f"coalesce(least(({a} - a{v}) / {d}, ({b} - a{v}) / {d}), case when a{v} between {a} and {b} then 0 else 2 end)")
        hi.append(f"coalesce(greatest(({a} - a{v}) / {d}, ({b} - a{v}) / {d}), 1)")
    return f"greatest(0, {', '.join(lo)}) <= least(1, {', '.join(hi)})"


@query(f"with {_edges_sql('e', 'a', 'q')} select distinct aid as id from e where {_meets_sql()}")
def window_intersects(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).where(spatial.in_window(F.col("line"), *_WINDOW)).select("id")


def _lambert_sql(lon: str, lat: str) -> str:
    crs = Lambert()
    n, af, r0 = crs.constants()
    phi = f"radians({lat})"
    t = f"tan(pi() / 4 - {phi} / 2) / pow((1 - {crs.e!r} * sin({phi})) / (1 + {crs.e!r} * sin({phi})), {crs.e / 2!r})"
    r, angle = f"(pow({t}, {n!r}) * {af!r})", f"((radians({lon}) - radians({crs.lon0!r})) * {n!r})"
    return f"{_r(f'{r} * sin({angle})', 3)} as x, {_r(f'{r0!r} - {r} * cos({angle})', 3)} as y"


@query("select vec_id as id, " + _lambert_sql("-71 + 10 * embedding[1]::double", "47 + 10 * embedding[2]::double").replace("e+", "e") + " from embeddings")
def reproject_lcc(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), Lambert().forward(-71 + 10 * at(0), 47 + 10 * at(1)).alias("p"))
    return p.select("id", half_even(F.col("p.x"), 3).alias("x"), half_even(F.col("p.y"), 3).alias("y"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Stations; those of a negative third number lack counts."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    counts = {"djma": F.when(at(2) >= 0, at(2) * 10000), "cam": F.when((at(2) >= 0) & (F.col("label") != 3), F.abs(at(3)) * 100)}
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (at(0) * 1000).alias("x"), (at(1) * 1000).alias("y"), F.when(F.col("label") != 9, F.col("label")).alias("kind"), *[v.alias(k) for k, v in counts.items()])


_P = """p as (select vec_id as id, embedding[1]::double * 1000 as x, embedding[2]::double * 1000 as y, case when label <> 9 then label end as kind, case when embedding[3] >= 0 then embedding[3]::double * 10000 end as djma, case when embedding[3] >= 0 and label <> 3 then abs(embedding[4]::double) * 100 end as cam from embeddings)"""
_N = f"""{_P}, d as (select t.id as target, s.id as source, sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) as distance from p t join p s on t.id <> s.id),
n as (select *, row_number() over (partition by target order by distance, source) as rank from d)"""
_G = f"""{_P}, d as (select t.id as target, s.id as source, s.djma, s.cam, sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) as distance, s.kind is not distinct from t.kind as own from p t join p s on t.djma is null and s.djma is not null),
n as (select *, row_number() over (partition by target order by distance, source) as rank from d),
w as (select *, row_number() over (partition by target order by own desc, rank) as choice from n where rank <= 20),
c as (select *, case when distance = 0 then 1.0::double else 1 / (distance * distance) end as raw from w where choice <= 5),
v as (select *, raw / sum(raw) over (partition by target) as weight from c),
g as (select target, sum(weight * djma) as djma, case when count(cam) = count(*) then sum(weight * cam) end as cam from v group by target)"""


@query(f"with {_G} select target as id, round_even(djma, 0) as djma, {_r('cam', 1)} as cam from g")
def knn_idw(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all stations that lack them, from their neighbours."""
    p = _points(spark, sf)
    return impute.idw(p.where("djma is null"), p.where("djma is not null"), {"djma": 0, "cam": 1}).withColumnRenamed("target", "id")


@query(f"with {_G} select target, source, choice::int as choice, {_r('distance')} as distance, {_r('weight')} as weight, {_r('v.djma')} as djma from v where target = (select min(target) from v)")
def knn_example(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbours of one station, the first that lacks counts, and their weights."""
    p = _points(spark, sf)
    first = p.where("djma is null").orderBy("id").limit(1)
    w = impute.weighted_neighbours(first, p.where("djma is not null")).join(p.select(F.col("id").alias("source"), "djma"), "source")
    return w.select("target", "source", "choice", *[half_even(F.col(c), 6).alias(c) for c in ("distance", "weight", "djma")])


@query(f"with {_G}, q as (select x, y from p join v on p.id = v.source where v.target = (select min(target) from v) union all select x, y from p where id = (select min(target) from v)), b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, greatest(400.0::double, 0.18::double * greatest(max(x) - min(x), max(y) - min(y))) as m from q) select {_r('x0 - m')} as xmin, {_r('y0 - m')} as ymin, {_r('x1 + m')} as xmax, {_r('y1 + m')} as ymax from b")
def knn_example_box(spark: SparkSession, sf: str) -> DataFrame:
    """The box around one station and its neighbours, with a margin of 18 % of its larger side, 400 at least."""
    p = _points(spark, sf)
    first = p.where("djma is null").orderBy("id").limit(1)
    w = impute.weighted_neighbours(first, p.where("djma is not null"))
    some = p.join(w.select(F.col("source").alias("id")), "id", "left_semi").select("x", "y").union(first.select("x", "y"))
    b = spatial.point_box(some, 0.18, 400.0)
    return b.select(*[half_even(F.col(c), 6).alias(c) for c in b.columns])


@query(f"with {_N} select target, source, rank::int as rank, {_r('distance')} as distance from n where rank <= 20")
def k_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest others of every station."""
    p = _points(spark, sf).select("id", "x", "y")
    return spatial.nearest_points(p, p, 20, others=True).withColumn("distance", half_even(F.col("distance"), 6))


@query(f"with {_N} select target, source, {_r('distance')} as distance from n where rank = 1")
def nearest_one(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf).select("id", "x", "y")
    found = spatial.nearest_points(p, p, 1, others=True)
    return found.select("target", "source", half_even(F.col("distance"), 6).alias("distance"))


@query(f"with {_G} select p.id, case when p.djma is null then round_even(g.djma, 0) else {_r('p.djma', 4)} end as djma, case when p.djma is null then {_r('g.cam', 1)} else {_r('p.cam', 4)} end as cam, case when p.djma is null then 'geo_knn' else 'complet' end as methode_djma from p left join g on g.target = p.id")
def neighbours_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without counts take counts and shares of their neighbours; the others stay as they are."""
    label = F.when(F.col("djma").isNull(), "geo_knn").otherwise("complet")
    rows = _points(spark, sf).withColumns({"methode_djma": label, "methode_cam": label})
    done = impute.complete_by_neighbours(rows, {"djma": 0, "cam": 1})
    return done.select("id", half_even(F.col("djma"), 4).alias("djma"), half_even(F.col("cam"), 4).alias("cam"), "methode_djma")


# Lines of two parts, of 16 vertices each: no edge leads from vertex 15 to 16.
BREAK = 15


def _two_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array(F.slice("line", 1, BREAK + 1), F.slice("line", BREAK + 2, VERTICES))
    return _lines(spark, sf).select("id", parts.alias("line"))


def _parted(sql: str) -> str:
    """A query over lines as one over lines of two parts."""
    return sql.replace("as no))", f"as no) where no <> {BREAK})")


_HALVES = f"e2 as (select aid, ano > {BREAK} as second, sum({_S}) as s, min(ano) as first, max(ano) as last from e group by all), h as (select *, row_number() over (partition by aid order by s desc, second) as k from e2)"


@query(_parted(f"with {_edges_sql('e', 'a', 'q')}, {_HALVES} select h.aid as id, {_r('(select sum(s) from e2 where e2.aid = h.aid)')} as length, {_r(_angle('z.qx - y.ax', 'z.qy - y.ay'))} as angle from h join e y on y.aid = h.aid and y.ano = h.first join e z on z.aid = h.aid and z.ano = h.last where k = 1"))
def parts_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Length of lines of two parts, and the angle of the longer part."""
    lines = _two_parts(spark, sf)
    return lines.select("id", half_even(geo.length(F.col("line"), True), 6).alias("length"), half_even(geo.line_angle(F.col("line"), True), 6).alias("angle"))


@query(_parted(f"with {_PAIRS} select l, r, {_r('distance')} as distance from near where distance <= {RADIUS}"))
def parts_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of lines of two parts that come near each other."""
    lines = _two_parts(spark, sf)
    return spatial.pairs_within(lines, lines, RADIUS, cell=CELL, others=True).withColumn("distance", half_even(F.col("distance"), 6))


@query(_parted(f"with {_CLIP} select y.id, {_r('y.length')} as length, {_r('coalesce(z.inside, 0)')} as inside from (select aid as id, sum({_span('ax', 'ay', 'qx', 'qy')}) as length from l group by aid) y left join (select id, sum(length) as inside from p group by id) z on y.id = z.id"))
def parts_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of lines of two parts and of what lies near other ones."""
    lines = _two_parts(spark, sf)
    got = spatial.clipped_lengths(lines, lines, RADIUS, cell=CELL, others=True)
    return got.select("id", half_even(F.col("length"), 6).alias("length"), half_even(F.col("inside"), 6).alias("inside"))
