"""The stages end to end: completion, routing and matching, aggregation, sensitivity."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, geometry as geo
from ..functions.rounding import half_even
from ..operators import compare, impute, methods, series, spatial
from ..operators.scratch import cut
from ..sources import layers

SLOTS = 10


def complete_series(counts: DataFrame, features: list[str] | None = None, watched: list | None = None, **forest) -> DataFrame:
    """Counts (id, x, y, kind, wide val_djma_annee_K and val_cam_annee_K, text annee_en_cours, annee2 ..) completed.

    Series first, then truck shares by forests where ``features`` are given,
    then rows without counts by neighbours, then the yearly texts.

    ``watched``: a list that takes (stage, Observation) of four checkpoints,
    mesures, series, forets and voisins: the percentages ``djma`` and ``cam``
    of rows whose slots are all known.  They are counted on the way, by the
    actions that the stages run anyhow, the last by whatever runs the result.
    """
    djma, cam = ([f"val_{m}_annee_{k}" for k in range(1, SLOTS + 1)] for m in ("djma", "cam"))
    rows = counts.withColumns({"djma": series.from_wide("val_djma_annee_", SLOTS), "cam": series.from_wide("val_cam_annee_", SLOTS)})

    def seen(df: DataFrame, stage: str, full: dict) -> DataFrame:
        if watched is None:
            return df
        watched.append((stage, Observation(f"{stage}-{uuid.uuid4().hex}")))
        return df.observe(watched[-1][1], *[F.avg(F.when(c, 100.0).otherwise(0.0)).alias(k) for k, c in full.items()])

    whole = {"djma": ~compare.any_null(djma), "cam": ~compare.any_null(cam)}
    rows = seen(rows, "mesures", {m: series.known(F.col(m)) == SLOTS for m in ("djma", "cam")})
    rows = series.complete_counts(rows)
    rows = rows.withColumns(series.wide(F.col("djma"), "val_djma_annee_", SLOTS) | series.wide(F.col("cam"), "val_cam_annee_", SLOTS)).drop("djma", "cam")
    rows = cut(seen(rows, "series", whole))
    if features:
        imputed = F.col("methode_cam") == "mice"
        fit = imputed | (F.col("methode_djma").isin("complet", "interpolation", "extrapolation") & F.col("methode_cam").isin("complet", "interpolation", "extrapolation"))
        rows = rows.where(~fit).unionByName(impute.chained_forests(rows.where(fit), djma + features, cam, **forest))
        rows = cut(seen(rows, "forets", whole))
    else:
        rows = seen(rows, "forets", whole)
    rows = seen(impute.complete_by_neighbours(rows, dict.fromkeys(djma, 0) | dict.fromkeys(cam, 1)), "voisins", whole)
    texts = {c: codec.year_record(F.col(c), F.col(djma[i]), F.col(cam[i]), i == 0) for i, c in enumerate(["annee_en_cours", *[f"annee{k}" for k in range(2, SLOTS + 1)]]) if c in rows.columns}
    return rows.withColumns(texts)


@dataclass(frozen=True)
class Reach:
    """Distances of the matching: of segments from the trace, of their centroids from its ends, of roads that clip it and of those it lists; the angle; the grid's cell."""

    distance: float = spatial.DISTANCE_M
    angle: float = spatial.ANGLE_DEG
    nodes: float = spatial.NODES_M
    clip: float = spatial.CLIP_M
    search: float = spatial.SEARCH_M
    cell: float | None = None


def route_arcs(arcs: DataFrame, nodes: DataFrame, routes: DataFrame, roads: DataFrame, counts: DataFrame, reach: Reach = Reach(), degrees: bool = True) -> Routed:
    """Arcs (ID_ARC, ID_A, ID_B, ..) with their traces, road lists and matched segments.

    ``nodes``: ID, lon, lat, x, y; ``routes``: ID_ARC, response; ``roads``:
    num_rts, des_clasf_, line, seg_long_m; ``counts``: ide_sectn_trafc, line,
    djma_val, djma_annee, cam_val, cam_annee.  Status, the first that holds:
    noeud_manquant, the route's own failure, hors_quebec (no road near),
    aucun_djma (no segment passes), ok.  ``degrees``: whether traces come in
    degrees, to be projected.
    """
    end = lambda x: nodes.select(F.col("ID").alias(f"ID_{x}"), F.struct("x", "y").alias(f"_{x}"))
    routed = layers.routes(routes).select("ID_ARC", F.col("statut").alias("_route"), F.col("line").alias("_deg"), "distance_m")
    rows = arcs.drop("fid").join(end("A"), "ID_A", "left").join(end("B"), "ID_B", "left").join(routed, "ID_ARC", "left")
    rows = rows.withColumn("_status", F.when(F.col("_A").isNull() | F.col("_B").isNull(), "noeud_manquant").otherwise(F.coalesce("_route", F.lit("erreur_api"))))
    rows = rows.withColumn("trace", F.when(F.col("_status") == "ok", layers.project(F.col("_deg")) if degrees else F.col("_deg"))).drop("_deg", "_route")
    return Routed(rows, roads, counts, reach)


class Routed:
    """The three layers of the routing stage; each is worked out when it is asked for, from what it needs alone.

    Traces, their parts near roads, the lists of each arc, and the ids of arcs
    with their segments are stored.  Nothing else is of pairs of arcs and roads
    or segments, which may grow with the square: a segment's line is joined to
    its id where the layer is read.
    """

    def __init__(self, rows: DataFrame, roads: DataFrame, counts: DataFrame, reach: Reach):
        self._routes, self._roads, self._counts, self._reach = rows, roads, counts, reach

    @cached_property
    def _rows(self) -> DataFrame:
        return _dealt(self._routes)

    @cached_property
    def _parts(self) -> DataFrame:
        """id, line (the parts near roads), course (the whole trace), a, b, inside; a row for each trace that has such parts."""
        traces = self._rows.where("trace is not null").select(F.col("ID_ARC").alias("id"), F.col("trace").alias("line"), F.col("_A").alias("a"), F.col("_B").alias("b"))
        pieces = spatial.clip_pieces(traces, self._roads.select(F.col("num_rts").alias("id"), "line"), self._reach.clip, self._reach.cell)
        pieces = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("edge_no", "t0", "t1"))).alias("p"), F.sum("length").alias("inside"))

        def part(p: Column) -> Column:
            edge = F.get("e", p["edge_no"])
            at = lambda t: geo.point(edge["a"]["x"] + (edge["b"]["x"] - edge["a"]["x"]) * t, edge["a"]["y"] + (edge["b"]["y"] - edge["a"]["y"]) * t)
            return F.array(at(p["t0"]), at(p["t1"]))

        rows = pieces.join(traces.withColumn("e", geo.edges(F.col("line"))), "id")
        return cut(rows.select("id", F.transform("p", part).alias("line"), F.col("line").alias("course"), "a", "b", "inside"))

    def _matched(self, segments: DataFrame, *keep: str) -> DataFrame:
        """trace_id, segment_id, and columns of the segments."""
        found = spatial.matched_segments(self._parts.drop("inside"), segments.withColumnRenamed("ide_sectn_trafc", "id"), self._reach.distance, self._reach.angle, self._reach.nodes, self._reach.cell, keep=keep)
        return found.select("trace_id", "segment_id", *keep)

    @cached_property
    def segments(self) -> DataFrame:
        pairs = cut(self._matched(self._counts.select("ide_sectn_trafc", "line")))
        own = self._counts.select("ide_sectn_trafc", "djma_val", "djma_annee", "cam_val", "cam_annee", geo.length(F.col("line")).alias("longueur_m"), F.col("line").alias("geometry"))
        return pairs.withColumnsRenamed({"trace_id": "ID_ARC", "segment_id": "ide_sectn_trafc"}).join(own, "ide_sectn_trafc").select("ID_ARC", *own.columns)

    @cached_property
    def traces(self) -> DataFrame:
        return self._routes.where("trace is not null").select("ID_ARC", half_even(geo.length(F.col("trace")) / 1000, 2).alias("longueur_trace_km"), F.col("trace").alias("geometry"))

    @cached_property
    def arcs(self) -> DataFrame:
        roads = self._roads.select(F.col("num_rts").alias("id"), "line", half_even(F.col("seg_long_m"), 1).alias("m"), F.col("des_clasf_").alias("c"))
        near_roads = spatial.pairs_within(self._parts, roads, self._reach.search, cell=self._reach.cell, keep=("m", "c"))
        lists = cut(near_roads.groupBy(F.col("l").alias("ID_ARC")).agg(F.sort_array(F.collect_list(F.struct("r", "m", "c"))).alias("_r")))
        text = F.struct(F.col("segment_id").alias("i"), codec.encode_value_year(F.col("djma_val"), F.col("djma_annee")).alias("v"), codec.encode_value_year(F.col("cam_val"), F.col("cam_annee")).alias("t"))
        counts = self._counts.select("ide_sectn_trafc", "line", "djma_val", "djma_annee", "cam_val", "cam_annee")
        found = self._matched(counts, *counts.columns[2:]).groupBy(F.col("trace_id").alias("ID_ARC")).agg(F.sort_array(F.collect_list(text)).alias("_s"), F.count("*").cast("int").alias("n_segs_djma"), half_even(F.try_divide(100.0 * F.count("djma_val"), F.count("*").cast("double")), 1).alias("statut_djma_pct"))
        found = cut(found)
        inside = self._parts.select(F.col("id").alias("ID_ARC"), "inside")
        out = self._rows.join(inside, "ID_ARC", "left").join(lists, "ID_ARC", "left").join(found, "ID_ARC", "left")
        status = F.when(F.col("_status") != "ok", F.col("_status")).when(F.col("inside").isNull(), "hors_quebec").when(F.col("n_segs_djma").isNull(), "aucun_djma").otherwise("ok")
        pick = lambda a, f: codec.encode_list(F.transform(a, lambda x: x[f]))
        reached = F.col("statut").isin("aucun_djma", "ok")
        out = out.withColumn("statut", status)
        new = {"ids_segs_rtss_id": pick("_r", "r"), "ids_segs_rtss_dist": pick("_r", "m"), "ids_segs_rtss_type": pick("_r", "c"), "ids_segs_djma_id": pick("_s", "i"), "ids_segs_djma_val": pick("_s", "v"), "ids_segs_djma_val_cam": pick("_s", "t")}
        new |= {"longueur_trace_km": F.when(reached, half_even(geo.length(F.col("trace")) / 1000, 2)), "longueur_qc_km": F.when(reached, half_even(F.col("inside") / 1000, 2)), "n_segs_djma": F.coalesce("n_segs_djma", F.lit(0)), "methode": F.lit("v4")}
        out = out.withColumns(new)
        return out.drop("_A", "_B", "_status", "_r", "_s", "inside", "trace", "distance_m")


def _dealt(df: DataFrame, key: str = "ID_ARC") -> DataFrame:
    """``df`` stored by ``key``: what groups or joins by it afterwards reads it where it lies."""
    return cut(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key))


def aggregate_arcs(arcs: DataFrame, segments: DataFrame, line: str = "line", radius: float = 1000.0) -> DataFrame:
    """Routed arcs with m1, m3 and m4 from their lists, m2 from the segments, and borrowed values for aucun_djma.

    ``line``: the straight link, by which the nearest ok arc is found.
    """
    rows = methods.list_methods(arcs)
    m2 = methods.aggregate_methods(segments.withColumns({"des_clasf": F.lit(None).cast("string"), "ord": F.col("ide_sectn_trafc")}), which=(2,))
    rows = rows.join(m2, "ID_ARC", "left").withColumn("n_segs_m2", F.coalesce("n_segs_m2", F.lit(0)))
    points = lambda s: rows.where(F.col("statut") == s).select(F.col("ID_ARC").alias("id"), F.col(line).alias("line"))
    nearest = spatial.nearest_lines(points("aucun_djma"), points("ok"), radius)
    return methods.borrow(rows, nearest.withColumnRenamed("target", "ID_ARC"))


def cascade_of(watched: list, spark: SparkSession) -> DataFrame:
    """(stage, djma, cam): the checkpoints that :func:`complete_series` has watched, once its result has been run."""
    got = [(stage, *(None if (v := seen.get[k]) is None else round(v, 1) for k in ("djma", "cam"))) for stage, seen in watched]
    return spark.createDataFrame(got, "stage string, djma double, cam double")


def cascade(stages: dict[str, DataFrame], families: dict[str, list[str]]) -> DataFrame:
    """(stage, one percentage for each family): rows whose family is wholly known after each stage."""
    out = None
    for name, df in stages.items():
        full = {f: ~compare.any_null(cols) for f, cols in families.items()}
        row = df.agg(*[half_even(F.avg(F.when(c, 100.0).otherwise(0.0)), 1).alias(f) for f, c in full.items()]).select(F.lit(name).alias("stage"), *full)
        out = row if out is None else out.unionByName(row)
    return out


def first_of(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
