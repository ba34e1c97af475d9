"""Stages watched on the way, validation with folds, trees, and what is stored once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions import geometry as geo
from roadweave.operators import compare, impute, trees
from roadweave.plans import pipelines


def test_cross_validation_finds_what_is_there(spark):
    """A planted signal is found out of fold, noise is not; every row gets one guess for each target that it has."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 4))
    rows = [(i, *map(float, v), "ab"[i % 2], float(3 * v[0] + v[1]), float(n) if i % 10 else None) for i, (v, n) in enumerate(zip(x, rng.normal(size=240)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, kind string, signal double, noise double")
    got = impute.cut(impute.cross_validated(df, "id", list("abcd"), ["signal", "noise"], trees=20, carry=["kind"]))
    assert got.columns == ["id", "kind", "target", "truth", "guess"]
    assert got.groupBy("id", "target").count().where("count <> 1").count() == 0
    assert {r["target"]: r["count"] for r in got.groupBy("target").count().collect()} == {"signal": 240, "noise": 216}
    r2 = {r["target"]: r["r2"] for r in compare.scores(got, "truth", "guess", "target").collect()}
    assert r2["signal"] > 0.5 and r2["noise"] < 0.15
    assert {r["kind"] for r in compare.scores(got.where("target = 'signal'"), "truth", "guess", "kind").where("r2 > 0.5").collect()} == {"a", "b"}
    assert impute.cross_validated(df.limit(0), "id", ["a"], ["signal"]).count() == 0


def test_trees(spark):
    rows = [(1, None, "root", 0), (2, 1, "old", 1), (3, 1, "new", 0), (4, 2, "a", 0), (5, 2, "old", 1), (6, 5, "b", 0), (7, 3, "c", 0), (8, 99, "lost", 0)]
    df = spark.createDataFrame(rows, "id long, parent long, name string, place long")
    assert {r["id"]: r["levels"] for r in trees.below(df, F.col("name") == "old").collect()} == {4: 1, 5: 1, 6: 1}
    got = trees.depth_first(df, "place").orderBy("path").collect()
    assert [(r["id"], r["depth"]) for r in got] == [(1, 0), (3, 1), (7, 2), (2, 1), (4, 2), (5, 2), (6, 3)]
    assert trees.below(df.limit(0), F.lit(True)).count() == 0 and trees.depth_first(df.limit(0), "place").count() == 0
    ring = spark.createDataFrame([(1, 2, "x", 0), (2, 1, "y", 0)], df.schema)
    with pytest.raises(Exception, match="(?i)recurs"):
        trees.below(ring, F.col("name") == "x", levels=20)
    deep = spark.range(150).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert trees.below(deep, F.col("id") == 0).agg(F.max("levels")).first()[0] == 149


def test_stages_are_watched(spark):
    """Four checkpoints of three stations: whole, without truck shares, without anything."""
    row = lambda i, djma, cam: (i, float(i), 0.0, "a", *djma, *cam)
    names = [f"val_{m}_annee_{k} double" for m in ("djma", "cam") for k in range(1, 11)]
    rows = [row(i, [100.0 + i] * 10, [10.0] * 10) for i in range(4)] + [row(4, [50.0] * 10, [None] * 10), row(5, [None] * 10, [None] * 10), row(6, [5.0, None] * 5, [1.0] * 10), row(7, [7.0] * 10, [2.0, None] * 5)]
    df = spark.createDataFrame(rows, "id long, x double, y double, kind string, " + ", ".join(names))
    watched: list = []
    done = pipelines.complete_series(df, ["x"], watched, trees=2, rounds=1, least=2)
    assert done.count() == 8
    got = {r["stage"]: (r["djma"], r["cam"]) for r in pipelines.cascade_of(watched, spark).collect()}
    assert got == {"mesures": (75.0, 62.5), "series": (87.5, 75.0), "forets": (87.5, 87.5), "voisins": (100.0, 100.0)}


def test_routing_reads_its_joins_once(spark):
    """All three layers come from stored rows: no plan of theirs holds a grid join, and lists and segments are grouped where they lie."""
    line = lambda *p: F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in p])
    ids = spark.range(6).withColumnRenamed("id", "ID_ARC")
    arcs = ids.select("ID_ARC", F.col("ID_ARC").alias("ID_A"), (F.col("ID_ARC") + 100).alias("ID_B"))
    nodes = ids.select(F.col("ID_ARC").alias("ID"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).union(ids.select(F.col("ID_ARC") + 100, F.lit(9.0), F.lit(0.0)))
    routes = ids.select("ID_ARC", F.lit('{"code":"Ok","routes":[{"distance":1,"geometry":{"coordinates":[[0,0],[9,0]]}}]}').alias("response"))
    roads = spark.range(1).select(F.lit("r").alias("num_rts"), F.lit("c").alias("des_clasf_"), line((0, 0.1), (9, 0.1)).alias("line"), F.lit(9.0).alias("seg_long_m"))
    counts = spark.range(2).select(F.col("id").alias("ide_sectn_trafc"), line((3, 0.1), (6, 0.1)).alias("line"), F.lit(5.5).alias("djma_val"), F.lit(2020).alias("djma_annee"), F.lit(None).cast("double").alias("cam_val"), F.lit(2020).alias("cam_annee"))
    got = pipelines.route_arcs(arcs, nodes, routes, roads, counts, pipelines.Reach(0.5, 45.0, 1.0, 0.5, 0.5), degrees=False)
    for layer in (got.arcs, got.segments, got.traces):
        plan = layer._jdf.queryExecution().optimizedPlan().toString()
        assert "cx" not in plan and "explode" not in plan
    rows = got.arcs.collect()
    assert {r["statut"] for r in rows} == {"ok"} and {r["ids_segs_djma_val"] for r in rows} == {"5@2020|5@2020"}
    assert got.segments.count() == 12 and got.traces.count() == 6


def test_routing_layers_store_what_they_need(spark, monkeypatch):
    """Traces alone meet no road; what is stored for segments are ids, not lines."""
    line = lambda *p: F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in p])
    ids = spark.range(3).withColumnRenamed("id", "ID_ARC")
    nodes = ids.select(F.col("ID_ARC").alias("ID"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    routes = ids.select("ID_ARC", F.lit('{"code":"Ok","routes":[{"distance":1,"geometry":{"coordinates":[[0,0],[9,0]]}}]}').alias("response"))
    roads = spark.range(1).select(F.lit("r").alias("num_rts"), F.lit("c").alias("des_clasf_"), line((0, 0.1), (9, 0.1)).alias("line"), F.lit(9.0).alias("seg_long_m"))
    counts = spark.range(2).select(F.col("id").alias("ide_sectn_trafc"), line((3, 0.1), (6, 0.1)).alias("line"), F.lit(5.5).alias("djma_val"), F.lit(2020).alias("djma_annee"), F.lit(None).cast("double").alias("cam_val"), F.lit(2020).alias("cam_annee"))
    stored: list = []
    monkeypatch.setattr(pipelines, "cut", lambda df, own=pipelines.cut: (stored.append(df.columns), own(df))[1])
    got = pipelines.route_arcs(ids.select("ID_ARC", F.col("ID_ARC").alias("ID_A"), F.col("ID_ARC").alias("ID_B")), nodes, routes, roads, counts, pipelines.Reach(0.5, 45.0, 1.0, 0.5, 0.5), degrees=False)
    assert got.traces.count() == 3 and len(stored) <= 1
    rows = got.segments.collect()
    assert len(rows) == 6 and {len(r["geometry"]) for r in rows} == {2}
    assert ["trace_id", "segment_id"] in stored and not any("ide_sectn_trafc" in c or "geometry" in c for c in stored)
