"""The routing stage as queries: every vector gives an arc whose route runs beside its own line and drifts away from it, a road, and a counted segment.

Routes of label 5 have no answer of use, those of label 6 none at all, and arcs of label 9 lack a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.rounding import half_even
from . import pipelines
from .registry import query, table
from .spatial_queries import _BOXES, _CHAIN_TAIL, _CLIP_TAIL, _GAP, CELL, RADIUS, REACH, VERTICES, _edge_edge, _edges_sql, _line, _r, _span, _x, _y

DRIFT, SEARCH = 0.0015, 0.03
FAR_NODE = 10**9
CLASSES = ["Autoroute", "Nationale", "Autre"]


def _routed(spark: SparkSession, sf: str) -> pipelines.Routed:
    e = table(spark, sf, "embeddings").select("vec_id", "label", _line().alias("line"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"n{k}") for k in (2, 3)])
    trace = F.transform("line", lambda p, k: geo.point(p["x"] + k * DRIFT, p["y"]))
    t = e.select(F.col("vec_id").alias("ID_ARC"), "label", trace.alias("t"))
    arcs = t.select("ID_ARC", F.col("ID_ARC").alias("ID_A"), F.when(F.col("label").eqNullSafe(9), -1).otherwise(F.col("ID_ARC") + FAR_NODE).alias("ID_B"))
    nodes = None
    for far, at in ((0, 1), (FAR_NODE, -1)):
        one = t.select((F.col("ID_ARC") + far).alias("ID"), F.element_at("t", at).alias("p")).select("ID", "p.x", "p.y")
        nodes = one if nodes is None else nodes.unionByName(one)
    route = F.array(F.struct(F.lit(1.0).alias("distance"), F.struct(F.transform("t", lambda p: F.array(p["x"], p["y"])).alias("coordinates")).alias("geometry")))
    answer = F.to_json(F.struct(F.when(F.col("label").eqNullSafe(5), "NoRoute").otherwise("Ok").alias("code"), route.alias("routes")))
    routes = t.select("ID_ARC", F.when(~F.col("label").eqNullSafe(6), answer).alias("response"))
    kind = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("vec_id") % 3 + 1).cast("int"))
    roads = e.select(F.concat(F.lit("R"), "vec_id").alias("num_rts"), F.when(F.col("label") != 4, kind).alias("des_clasf_"), "line", geo.length(F.col("line")).alias("seg_long_m"))
    year = 2015 + F.col("label")
    counts = e.select(F.col("vec_id").alias("ide_sectn_trafc"), "line", F.when(F.col("n2") >= 0, F.col("n2") * 1e5).alias("djma_val"), year.alias("djma_annee"), F.when(F.col("n3") >= 0, F.col("n3") * 100).alias("cam_val"), year.alias("cam_annee"))
    reach = pipelines.Reach(RADIUS, 45.0, REACH, RADIUS, SEARCH, CELL)
    return pipelines.route_arcs(arcs, nodes, routes, roads, counts, reach, degrees=False)


_T = f"l as materialized (select vec_id as aid, no as ano, {_x('no')} + no * {DRIFT}::double as ax, {_y('no')} as ay, {_x('no + 1')} + (no + 1) * {DRIFT}::double as qx, {_y('no + 1')} as qy from embeddings, (select unnest(range(0, {VERTICES - 1})) as no) where label is null or label not in (5, 6, 9))"
# xr: the boxes of roads; pairs: traces and roads whose boxes are near enough.
_ROUTES = f"""{_T}, {_edges_sql('r', 'c', 'd')}, {_BOXES},
xr as materialized (select cid as id, min(least(cx, dx)) as x0, max(greatest(cx, dx)) as x1, min(least(cy, dy)) as y0, max(greatest(cy, dy)) as y1 from r group by cid),
pairs as materialized (select m.id as m, o.id as o from x m join xr o on {_GAP} <= {SEARCH}),{_CLIP_TAIL},
q as materialized (select n.id, n.no, min(t0) as t0, max(t1) as t1 from n group by n.id, n.no, island),
u as materialized (select q.id, ax + t0 * (qx - ax) as sx, ay + t0 * (qy - ay) as sy, ax + t1 * (qx - ax) as tx, ay + t1 * (qy - ay) as ty from q join l on l.aid = q.id and l.ano = q.no),
g2 as materialized (select u.id as l, r.cid as r, min({_edge_edge('s', 't', 'c', 'd')}) as distance from pairs join u on u.id = pairs.m join r on r.cid = pairs.o group by u.id, r.cid),
near as materialized (select * from g2 where distance <= {RADIUS}),{_CHAIN_TAIL.replace('where distance <= ' + str(RADIUS), '')},
lengths as (select cid, sum({_span('cx', 'cy', 'dx', 'dy')}) as m from r group by cid),
c2 as (select vec_id, label, case when embedding[3] >= 0 then embedding[3]::double * 1e5 end as djma_val, case when embedding[4] >= 0 then embedding[4]::double * 100 end as cam_val, 2015 + label as annee from embeddings),
seg as materialized (select f.l as ID_ARC, c2.*, lengths.m from f join c2 on c2.vec_id = f.r join lengths on lengths.cid = f.r where aligned and off)"""


def _at_year(value: str) -> str:
    return f"coalesce(trunc({value})::bigint || '@' || coalesce(annee::varchar, '?'), 'NA')"


def _listed(expr: str, order: str) -> str:
    return f"string_agg({expr}, '|' order by {order})"


@query(f"""with {_ROUTES},
ro as (select l as ID_ARC, {_listed("'R' || r", "'R' || r")} as ids_segs_rtss_id, {_listed("(round_even(m * 10, 0) / 10)::varchar", "'R' || r")} as ids_segs_rtss_dist,
    {_listed("coalesce(case when label <> 4 then ['" + "', '".join(CLASSES) + "'][r % 3 + 1] end, 'None')", "'R' || r")} as ids_segs_rtss_type from g2 join lengths on cid = r join embeddings on vec_id = r where distance <= {SEARCH} group by l),
so as (select ID_ARC, {_listed('vec_id::varchar', 'vec_id')} as ids_segs_djma_id, {_listed(_at_year('djma_val'), 'vec_id')} as ids_segs_djma_val, {_listed(_at_year('cam_val'), 'vec_id')} as ids_segs_djma_val_cam, count(*)::int as n, round_even(1000.0 * count(djma_val) / count(*), 0) / 10 as pct from seg group by ID_ARC),
io as (select id, sum(length) as inside from p group by id),
lo as (select aid, sum({_span('ax', 'ay', 'qx', 'qy')}) as m from l group by aid)
select vec_id as ID_ARC, case when label = 9 then 'noeud_manquant' when label = 5 then 'echec_osrm' when label = 6 then 'erreur_api' when inside is null then 'hors_quebec' when n is null then 'aucun_djma' else 'ok' end as statut,
    case when inside is not null then round_even(lo.m / 10, 0) / 100 end as longueur_trace_km, case when inside is not null then round_even(inside / 10, 0) / 100 end as longueur_qc_km, coalesce(n, 0) as n_segs_djma, pct as statut_djma_pct, 'v4' as methode,
    ids_segs_rtss_id, ids_segs_rtss_dist, ids_segs_rtss_type, ids_segs_djma_id, ids_segs_djma_val, ids_segs_djma_val_cam
from embeddings left join ro on ro.ID_ARC = vec_id left join so on so.ID_ARC = vec_id left join io on io.id = vec_id left join lo on lo.aid = vec_id""")
def routed_arcs(spark: SparkSession, sf: str) -> DataFrame:
    """Arcs with status, lengths, and the lists of their roads and segments."""
    arcs = _routed(spark, sf).arcs
    return arcs.select("ID_ARC", "statut", "longueur_trace_km", "longueur_qc_km", "n_segs_djma", "statut_djma_pct", "methode", *[f"ids_segs_{c}" for c in ("rtss_id", "rtss_dist", "rtss_type", "djma_id", "djma_val", "djma_val_cam")])


@query(f"with {_ROUTES} select ID_ARC, vec_id as ide_sectn_trafc, {_r('djma_val', 3)} as djma_val, annee as djma_annee, {_r('cam_val', 3)} as cam_val, annee as cam_annee, {_r('m')} as longueur_m, {VERTICES}::bigint as vertices from seg")
def routed_segments(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each segment that an arc's trace takes along."""
    s = _routed(spark, sf).segments
    return s.select("ID_ARC", "ide_sectn_trafc", half_even(F.col("djma_val"), 3).alias("djma_val"), "djma_annee", half_even(F.col("cam_val"), 3).alias("cam_val"), "cam_annee", half_even(F.col("longueur_m"), 6).alias("longueur_m"), F.size("geometry").cast("long").alias("vertices"))


@query(f"with {_T} select aid as ID_ARC, round_even(sum({_span('ax', 'ay', 'qx', 'qy')}) / 10, 0) / 100 as longueur_trace_km, {_r('max(qx)')} as east, {VERTICES}::bigint as vertices from l group by aid")
def routed_traces(spark: SparkSession, sf: str) -> DataFrame:
    """The traces of all arcs that have one."""
    t = _routed(spark, sf).traces
    east = F.array_max(F.transform(F.slice("geometry", 2, VERTICES), lambda p: p["x"]))
    return t.select("ID_ARC", "longueur_trace_km", half_even(east, 6).alias("east"), F.size("geometry").cast("long").alias("vertices"))
