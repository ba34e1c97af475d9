import json
import math

import pytest
from pyspark.sql import functions as F

from roadweave.functions import codec, crs, geometry as geo
from roadweave.functions.rounding import half_even, number
from roadweave.operators import compare, methods, project, series, spatial
from roadweave.plans import pipelines
from roadweave.sources import gpkg, layers
from roadweave.streaming import updates


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def array(values):
    return F.array(*[F.lit(v).cast("double") for v in values])


def line(*points):
    return F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


@pytest.mark.parametrize(
    "given, want, label",
    [
        ([None, 8700, 8500, 6200, 5300, 6000, 5900, None, None, None], [10300, 8700, 8500, 6200, 5300, 6000, 5900, 6333.33, 6633.33, 6933.33], "extrapolation"),
        ([None, 42] + [None] * 8, [42] * 10, "extrapolation"),
        ([10, None, 30] + [40] * 7, [10, 20, 30] + [40] * 7, "interpolation"),
        ([None] * 10, [None] * 10, "geo_knn"),
        ([100, 50] + [None] * 8, [100, 50] + [0] * 8, "extrapolation"),
        ([1] * 10, [1] * 10, "complet"),
    ],
)
def test_series(spark, given, want, label):
    df = spark.range(1).select(array(given).alias("s"))
    r = series.complete(df.withColumn("label", series.label(F.col("s"))), "s").first()
    assert [None if x is None else round(x, 2) for x in r["s"]] == want and r["label"] == label


def test_codecs(spark):
    r = one(spark, a=codec.parse_values(F.lit("12@2025|NA| 7.5@?|x")), b=codec.parse_pairs(F.lit("10@1|20@1|30@1"), F.lit("1@1|NA|3@1")), c=codec.parse_values(F.lit(None).cast("string")), d=number(F.lit("7d")), e=codec.encode_list(F.array(F.lit("a"), F.lit(None))))
    assert r["a"] == [12.0, 7.5] and [(x["value"], x["paired"]) for x in r["b"]] == [(10, 1), (20, None), (30, 3)]
    assert r["c"] in ([], None) and r["d"] is None and r["e"] == "a|None"
    text = codec.year_record(F.lit("2024 DJMA:1 / DJME:120 / DJMH:90 / %cam:"), F.lit(99.5), F.lit(7.04), False)
    assert one(spark, t=text)["t"] == "2024 DJMA:100 / DJME:120 / DJMH:90 / %cam:7.0"
    bins = [one(spark, b=codec.segment_class(F.lit(n)))["b"] for n in (3, 4, 6, 7, 10, 11, 18, 19)]
    assert bins == ["1–3", "4–6", "4–6", "7–10", "7–10", "11–18", "11–18", "19+"]


def test_ranks_and_spread(spark):
    ranks = [one(spark, r=methods.nearest_rank(F.lit(n)))["r"] for n in range(1, 9)]
    assert ranks == [1, 2, 2, 3, 4, 5, 6, 6]
    df = spark.createDataFrame([(1, 100, 110, 120, 150)], ["ID_ARC", *compare.COLUMNS])
    assert compare.with_spread(df).first()["ecart_pct"] == 41.7
    assert one(spark, x=half_even(F.lit(30.04), 1))["x"] == 30.0


def test_methods_of_one_arc(spark):
    segs = spark.createDataFrame([(1, 10.0, 1.0, 1.0, "Autoroute", 1), (1, 20.0, None, 1.0, "x", 2), (1, 30.0, 3.0, 2.0, "x", 3)], "ID_ARC long, djma_val double, cam_val double, longueur_m double, des_clasf string, ord int")
    r = methods.arc_methods(spark.createDataFrame([(1,), (2,)], "ID_ARC long"), segs).orderBy("ID_ARC").collect()
    assert [r[0][f"djma_m{k}"] for k in (1, 2, 3, 4)] == [20, 22, 15, 20] and r[0]["pct_cam_m4"] is None
    assert r[1]["djma_m1"] is None and r[1]["n_segs_m4"] == 0
    lists = spark.createDataFrame([(1, "10@1|20@1|30@1", None, "Autoroute|Nationale")], "ID_ARC long, ids_segs_djma_val string, ids_segs_djma_val_cam string, ids_segs_rtss_type string")
    m3 = methods.list_methods(lists).first()
    assert m3["djma_m3"] == 14 and m3["n_segs_m3"] == 2


def test_geometry(spark):
    cross, apart = line((0, 0), (2, 2)), line((0, 2), (2, 0))
    e = lambda a: (F.try_element_at(a, F.lit(1)), F.try_element_at(a, F.lit(2)))
    r = one(spark, l=geo.length(line((0, 0), (3, 4))), c=geo.centroid(line((0, 0), (2, 0))), x=geo.edge_edge(*e(cross), *e(apart)), y=geo.edge_edge(*e(line((0, 0), (1, 0))), *e(line((0, 2), (1, 2)))), d=geo.angle_between(F.lit(170.0), F.lit(10.0)))
    assert r["l"] == 5 and r["c"]["x"] == 1 and r["x"] == 0 and r["y"] == 2 and r["d"] == 20
    p = crs.Lambert().forward(F.lit(-71.2), F.lit(46.8))
    back = one(spark, b=crs.Lambert().inverse(p["x"], p["y"]))["b"]
    assert abs(back["lon"] + 71.2) < 1e-9 and abs(back["lat"] - 46.8) < 1e-9


def test_pairs_and_clip(spark):
    traces = spark.range(1).select(F.lit(1).cast("long").alias("id"), line((0, 0), (10, 0)).alias("line"))
    roads = spark.range(1).select(F.lit(7).cast("long").alias("id"), line((4, 1), (6, 1)).alias("line"))
    assert [(r["l"], r["r"], r["distance"]) for r in spatial.pairs_within(traces, roads, 1.5).collect()] == [(1, 7, 1.0)]
    r = spatial.clipped_lengths(traces, roads, 2.0).first()
    near = sum(math.hypot(max(4 - x, 0, x - 6), 1) <= 2 for x in (k / 1000 for k in range(10_000))) / 1000
    assert abs(r["inside"] - near) < 0.01 and r["length"] == 10


def test_routing_states(spark):
    crs32 = crs.Lambert()
    at = lambda lon, lat: spark.range(1).select(crs32.forward(F.lit(lon), F.lit(lat)).alias("p")).first()["p"]
    a, b = at(-71.2, 46.8), at(-71.2, 46.9)
    nodes = spark.createDataFrame([(1, a["x"], a["y"]), (2, b["x"], b["y"])], "ID long, x double, y double")
    arcs = spark.createDataFrame([(10, 1, 2), (11, 1, 9), (12, 1, 2)], "ID_ARC long, ID_A long, ID_B long")
    ok = json.dumps({"code": "Ok", "routes": [{"distance": 1.0, "geometry": {"coordinates": [[-71.2, 46.8], [-71.2, 46.9]]}}]})
    routes = spark.createDataFrame([(10, ok), (12, '{"code":"NoRoute"}')], "ID_ARC long, response string")
    m = at(-71.2, 46.85)
    seg = line((m["x"], m["y"] - 500), (m["x"], m["y"] + 500))
    roads = layers.roads(spark.range(1).select(F.lit("r").alias("num_rts"), F.lit("Nationale").alias("des_clasf_"), seg.alias("line")))
    counts = spark.range(1).select(F.lit(5).cast("long").alias("ide_sectn_trafc"), seg.alias("line"), F.lit(120.7).alias("djma_val"), F.lit(2025.0).alias("djma_annee"), F.lit(None).cast("double").alias("cam_val"), F.lit(None).cast("double").alias("cam_annee"))
    got = {r["ID_ARC"]: r for r in pipelines.route_arcs(arcs, nodes, routes, roads, counts).arcs.collect()}
    assert [got[k]["statut"] for k in (10, 11, 12)] == ["ok", "noeud_manquant", "echec_osrm"]
    done = pipelines.aggregate_arcs(pipelines.route_arcs(arcs, nodes, routes, roads, counts).arcs.withColumn("line", line((0, 0), (1, 1))), pipelines.route_arcs(arcs, nodes, routes, roads, counts).segments)
    assert {r["ID_ARC"]: (r["djma_m1"], r["djma_m2"]) for r in done.collect()} == {10: (120, 121), 11: (None, None), 12: (None, None)}
    assert got[10]["ids_segs_djma_val"] == "120@2025" and got[10]["ids_segs_djma_val_cam"] == "NA" and got[10]["n_segs_djma"] == 1


def test_clip_equals_dense_sampling(spark):
    """Interval ends against points along the edges, for random edges among others."""
    import random

    rng = random.Random(5)
    lines = [(i, [(rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(3)]) for i in range(12)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in lines], "id long, line array<struct<x:double,y:double>>")

    def gap(p, a, b):
        d = ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) or 1.0
        t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d))
        return math.hypot(a[0] + t * (b[0] - a[0]) - p[0], a[1] + t * (b[1] - a[1]) - p[1])

    got = {r["id"]: r["inside"] for r in spatial.clipped_lengths(df, df, 0.2, others=True).collect()}
    for i, line_ in lines:
        want = 0.0
        for a, b in zip(line_, line_[1:]):
            points = [(a[0] + (b[0] - a[0]) * (k + 0.5) / 2000, a[1] + (b[1] - a[1]) * (k + 0.5) / 2000) for k in range(2000)]
            near = sum(any(gap(p, u, v) <= 0.2 for j, other in lines if j != i for u, v in zip(other, other[1:])) for p in points)
            want += math.dist(a, b) * near / 2000
        assert abs(got[i] - want) < 0.02


def test_percentiles_are_exact(spark):
    import statistics

    values = [1.0] * 50 + [2.0] * 3 + [float(k * k % 97) for k in range(401)] + [None]
    long = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0), ("c", None)], "g string, v double")
    got = {r["g"]: r for r in compare.percentiles(long, "g", "v", {"q1": 0.25, "median": 0.5}, parts=8).collect()}
    known = [v for v in values if v is not None]
    assert got["a"]["median"] == statistics.median(known) and got["a"]["q1"] == statistics.quantiles(known, n=4, method="inclusive")[0]
    assert got["b"]["q1"] == 4 and "c" not in got


def test_ranks_of_equal_counts_and_orders_are_definite(spark):
    """The order of rows decides nothing: of segments equal in count and order, the truck share does."""
    rows = [(1, 10.0, c, 1.0, "x", 1) for c in (5.0, 2.0, None, 9.0, 7.0)]
    schema = "ID_ARC long, djma_val double, cam_val double, longueur_m double, des_clasf string, ord int"
    got = {methods.aggregate_methods(spark.createDataFrame(r, schema).coalesce(1), which=(4,)).first()["pct_cam_m4"] for r in (rows, rows[::-1], sorted(rows, key=lambda r: r[2] or 0))}
    assert got == {7.0}


def test_weightless_classes_count_plainly(spark):
    segs = spark.createDataFrame([(1, 10.0, 1.0, 1.0, "x", 1), (1, 30.0, 3.0, 1.0, "x", 2)], "ID_ARC long, djma_val double, cam_val double, longueur_m double, des_clasf string, ord int")
    r = methods.aggregate_methods(segs, weights={"x": 0}).first()
    assert (r["djma_m3"], r["pct_cam_m3"]) == (20, 2.0)
    lists = spark.createDataFrame([(1, "10@1|30@1", "1@1|3@1", "x|x")], "ID_ARC long, ids_segs_djma_val string, ids_segs_djma_val_cam string, ids_segs_rtss_type string")
    assert methods.list_methods(lists, weights={"x": 0}).first()["djma_m3"] == 20


def test_gpkg_layers(spark, tmp_path):
    gpkg.register(spark)
    path = str(tmp_path / "x")
    df = spark.range(3).select("id", F.lit("é").alias("name"), gpkg.to_wkb(line((0, 0), (1, 1))).alias("geometry"))
    for mode, layer in (("overwrite", "a"), ("append", "b"), ("append", "b")):
        df.write.format("gpkg").mode(mode).option("path", path).option("layer", layer).save()
    assert gpkg.layers(path) == ["a", "b"]
    assert spark.read.format("gpkg").option("path", path).option("layer", "b").load().count() == 6


def test_project_document(spark, tmp_path):
    import io
    import zipfile

    doc = (
        '<qgis projectname="x"><title>t</title><layer-tree-group><layer-tree-group name="old"><layer-tree-group name="deep"><layer-tree-layer id="1" name="m"/></layer-tree-group></layer-tree-group>'
        '<layer-tree-group name="g"><layer-tree-layer id="2" name="m"/><layer-tree-group name="old"/></layer-tree-group></layer-tree-group>'
        "<projectlayers><maplayer><id>1</id><datasource>./a/x.gpkg</datasource><layername>m</layername></maplayer><maplayer><id>2</id><datasource>./a/b.gpkg</datasource><layername>m</layername><title>own</title></maplayer></projectlayers></qgis>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("p.qgs", doc)
        z.writestr("p.db", b"data")
    path = tmp_path / "p.qgz"
    path.write_bytes(out.getvalue())
    rules = project.Rules("T", {"g": "G"}, "old", {"./a/": "./c/"}, {"m": "M"})
    files = spark.read.format("binaryFile").load(str(path))
    rows = [(r["kind"], r["layer_id"], r["name"], r["group_path"], r["depth"]) for r in project.listing(files).orderBy("no").collect()]
    assert rows == [("group", None, "old", "", 0), ("group", None, "deep", "old", 1), ("layer", "1", "m", "old/deep", 2), ("group", None, "g", "", 0), ("layer", "2", "m", "g", 1), ("group", None, "old", "g", 1)]
    assert project.clean_file(spark, str(path), rules) == {"groups": 1, "removed": 1, "sources": 1, "labels": 2}
    assert (tmp_path / "p.qgz.bak").read_bytes() == out.getvalue()
    with zipfile.ZipFile(path) as z:
        text = z.read("p.qgs").decode()
        assert z.read("p.db") == b"data"
    assert text.split("?>", 1)[1].strip() == (
        '<qgis projectname="T"><title>T</title><layer-tree-group><layer-tree-group name="G"><layer-tree-layer id="2" name="M" /><layer-tree-group name="old" /></layer-tree-group></layer-tree-group>'
        "<projectlayers><maplayer><id>2</id><datasource>./c/b.gpkg</datasource><layername>M</layername><title>own</title></maplayer></projectlayers></qgis>"
    )
    with pytest.raises(FileNotFoundError):
        project.clean_file(spark, str(tmp_path / "absent.qgz"), rules)


def test_stream_refresh(spark, tmp_path):
    schema = "ID_ARC long, djma_val double, cam_val double, longueur_m double, des_clasf string, ord int"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 10.0, 1.0, 1.0, "x", 1)], schema).write.parquet(source)
    query = updates.refresh_arcs(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/segs", f"{tmp_path}/out", f"{tmp_path}/cp")
    query.processAllAvailable()
    spark.createDataFrame([(1, 30.0, 1.0, 1.0, "x", 2)], schema).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    assert [(r["ID_ARC"], r["djma_m1"]) for r in updates.current(spark.read.parquet(f"{tmp_path}/out")).collect()] == [(1, 20)]


def test_optional_source_and_layers(spark, tmp_path):
    layers.write_layers({"a": spark.range(2).select("id", F.lit(1).alias("fid"), F.lit("g").alias("geometry"), F.lit(5).alias("ID_ARC"))}, str(tmp_path))
    assert layers.read_layer(spark, str(tmp_path), "a").columns == ["ID_ARC", "id", "geometry"]
    assert layers.optional(spark, f"{tmp_path}/a", f"{tmp_path}/b") is None
    assert [t.count() for t in layers.optional(spark, f"{tmp_path}/a")] == [2]


def test_parts_of_lines(spark):
    parts = F.array(line((0, 0), (1, 0)), line((0, 5), (9, 5)), line((0, 5), (9, 5)))
    r = one(spark, long=gpkg.longest(parts), near=gpkg.nearest_part(parts, geo.point(F.lit(0.0), F.lit(1.0))))
    assert r["long"][1]["x"] == 9 and r["near"][1]["x"] == 1


def test_counts_and_samples(spark):
    rows = spark.range(1).select(line((0, 0), (3, 4)).alias("line"), *[F.lit(v).alias(c) for c, v in (("val_djma_annee_1", "12"), ("djma_annee_1", "2025"), ("val_cam_annee_1", "x"), ("cam_annee_1", None))])
    r = layers.counts(layers.with_srid(rows, 32198)).first()
    assert (r["longueur_m"], r["djma_val"], r["djma_annee"], r["cam_val"]) == (5, 12, 2025, None)
    from roadweave.operators import impute

    df = spark.range(50)
    assert impute.sample(df, "id", 7).collect() == impute.sample(df.repartition(3), "id", 7).collect() and impute.sample(df, "id", 7).count() == 7
    twice = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k int, v int")
    assert sorted(map(tuple, pipelines.first_of(twice, "k", ["v"]).collect())) == [(1, 1), (2, 5)]


def test_completion_end_to_end(spark):
    """Series, neighbours and texts of three stations: whole, with a gap, and without counts."""
    def station(i, x, djma, cam):
        row = {"id": i, "x": x, "y": 0.0, "kind": "a", "annee_en_cours": "2025 DJMA:1 / DJME:5 / DJMH:6 / %cam:1 / 30e h:7"}
        row |= {f"val_djma_annee_{k}": str(v) if v is not None else None for k, v in enumerate(djma, 1)}
        return row | {f"val_cam_annee_{k}": str(v) if v is not None else None for k, v in enumerate(cam, 1)}

    rows = [station(1, 0.0, [100] * 10, [10] * 10), station(2, 1.0, [100, None] + [300] * 8, [20] * 10), station(3, 0.5, [None] * 10, [None] * 10)]
    schema = "id int, x double, y double, kind string, annee_en_cours string, " + ", ".join(f"val_{m}_annee_{k} string" for m in ("djma", "cam") for k in range(1, 11))
    got = {r["id"]: r for r in pipelines.complete_series(spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in rows], schema)).collect()}
    assert [got[k]["methode_djma"] for k in (1, 2, 3)] == ["complet", "interpolation", "geo_knn"]
    assert got[2]["val_djma_annee_2"] == 200 and got[3]["val_djma_annee_3"] == 200 and got[3]["val_cam_annee_1"] == 15
    assert got[3]["annee_en_cours"].startswith("2025 DJMA:100 / DJME:5") and "%cam:15.0" in got[3]["annee_en_cours"]
