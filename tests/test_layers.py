"""Polygons, GeoPackage and shapefile layers, and the parsing of long lists."""

import os
import re
import sqlite3
import struct
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from roadweave.functions import codec, geometry as geo, polygons
from roadweave.sources import gpkg, manifest, shapefile, wkb


def ring(*points):
    return F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2)]


def clipped(spark, box, *rings):
    df = polygons.with_clipped(spark.range(1).withColumn("p", F.array(*[ring(*r) for r in rings])), "p", "q", box)
    r = df.select("q", polygons.area(F.col("q")).alias("area")).first()
    return [[(p["x"], p["y"]) for p in x] for x in r["q"]] if r["q"] is not None else None, r["area"]


def test_polygons_are_clipped(spark):
    assert clipped(spark, (-1, -1, 9, 9), SQUARE, HOLE) == ([SQUARE, HOLE], 15.0)
    got, area = clipped(spark, (1.5, -1, 9, 9), [*SQUARE, SQUARE[0]], HOLE)  # the first ring closed as in files
    assert area == 10 - 0.5 and len(got) == 2 and {(1.5, 0.0), (1.5, 4.0)} <= set(got[0]) and {(1.5, 1.0), (1.5, 2.0)} <= set(got[1])
    assert clipped(spark, (2.5, 2.5, 3, 3), SQUARE, HOLE)[1] == 0.25 and len(clipped(spark, (2.5, 2.5, 3, 3), SQUARE, HOLE)[0]) == 1
    assert clipped(spark, (5, 5, 6, 6), SQUARE) == (None, 0.0)
    concave = [(0, 0), (6, 0), (6, 3), (4, 3), (4, 1), (2, 1), (2, 3), (0, 3)]
    assert clipped(spark, (-1, 2, 9, 9), concave)[1] == 4.0  # two towers, joined along the side
    turned, area = clipped(spark, (0.5, 0.5, 3.5, 3.5), SQUARE[::-1], HOLE[::-1])
    assert area == 8.0 and len(turned) == 2


def test_polygons_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [[]]), (4, [[(0.0, 0.0), (1.0, 1.0)]])], f"id int, polygon {polygons.POLYGON}")
    assert [r["a"] for r in rows.select(polygons.area(F.col("polygon")).alias("a")).collect()] == [0.0] * 4
    assert polygons.clip_to_window(rows, (-1.0, -1.0, 1.0, 1.0)).count() == 0 and polygons.clip_to_window(rows.limit(0), (0.0, 0.0, 1.0, 1.0)).count() == 0
    p = F.array(ring(*SQUARE), ring(*HOLE))
    r = spark.range(1).select(*[polygons.contains(p, geo.point(F.lit(x), F.lit(y))).alias(n) for n, x, y in (("inside", 3.0, 3.0), ("hole", 1.5, 1.5), ("out", 5.0, 1.0))], polygons.oriented(F.array(ring(*SQUARE[::-1]), ring(*HOLE))).alias("o")).first()
    assert (r["inside"], r["hole"], r["out"]) == (True, False, False)
    assert [(q["x"], q["y"]) for q in r["o"][0]] == [(0, 4), (0, 0), (4, 0), (4, 4)] and [(q["x"], q["y"]) for q in r["o"][1]][1] == (1, 2)


def test_lists_parse_in_linear_time(spark):
    """Parallel lists of 200 items take at most two and a half times as long as those of 100."""
    def seconds(n):
        values, classes = "|".join(f"{k}@2020" for k in range(n)), "|".join(["Nationale", "Autre"] * (n // 2))
        df = spark.range(6000).select(F.concat(F.lit(values), F.col("id").cast("string")).alias("v"), F.lit(classes).alias("c"))
        parsed = df.select(codec.parse_weighted(F.col("v"), F.col("c")).alias("w"), codec.parse_pairs(F.col("v"), F.col("v")).alias("p"))
        best = 1e9
        for _ in range(3):
            began = time.time()
            parsed.write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    seconds(10)
    assert seconds(200) <= 2.5 * seconds(100)
    r = spark.range(1).select(codec.parse_weighted(F.lit("1@2|NA|3"), F.lit("Autoroute|Autre")).alias("w"), codec.parse_weighted(F.lit("1|2"), F.lit(None).cast("string")).alias("n"), codec.parse_pairs(F.lit("NA|5|6"), F.lit("1|2")).alias("p"), codec.parse_pairs(F.lit(""), F.lit("1")).alias("e")).first()
    assert [tuple(x) for x in r["w"]] == [(1.0, 4)] and [tuple(x) for x in r["n"]] == [(1.0, 1), (2.0, 1)] and [tuple(x) for x in r["p"]] == [(2, 5.0, 2.0)] and r["e"] == []


def lines(spark, n):
    return spark.range(n).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("é"), F.col("id"))).alias("name"), (F.col("id") % 2 == 0).alias("even"), (F.col("id") / 2).alias("half"), wkb.to_wkb(ring((0, 0), (1, 1))).alias("geometry")).withColumn("geometry", wkb.to_wkb(F.array(geo.point(F.col("id").cast("double"), F.lit(0.0)), geo.point(F.col("id") + 0.5, F.lit(1.0)))))


def read(spark, path, **options):
    return spark.read.format("gpkg").options(path=path, layer="a", **options).load()


FILTERS = ["id = 7", "id >= 5 and id < 9", "name = 'é3'", "name is null", "name is not null and half > 2.25", "even", "not (id = 4)", "name like 'é1%'", "name like '%8'", "name like '%1%'", "id in (1, 3, 99)", "name <=> null", "not (name in ('é1', 'é2'))", "id = 3 or half = 4.0", "id > 1e300"]


def test_filters_are_pushed_into_sqlite(spark, tmp_path):
    gpkg.register(spark)
    df = lines(spark, 20)
    df.write.format("gpkg").mode("overwrite").option("path", str(tmp_path / "x")).option("layer", "a").save()
    for condition in FILTERS:
        key = lambda d: sorted(r["id"] for r in d.where(condition).collect())
        assert key(read(spark, str(tmp_path / "x"))) == key(df), condition
    plan = read(spark, str(tmp_path / "x")).where("id >= 5 and name = 'é7'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)
    schema = gpkg.GpkgSource({"path": str(tmp_path / "x"), "layer": "a"}).schema()
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = gpkg.GpkgReader(str(tmp_path / "x"), "a", schema, None, (3.2, 0.5, 6.1, 9.0))
    assert list(reader.pushFilters([EqualTo(("even",), True), GreaterThan(("geometry",), 1)])) != []
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == [4, 6]  # only matching rows leave the source
    far = gpkg.GpkgReader(str(tmp_path / "x"), "a", schema, None, (100.0, 0.0, 101.0, 1.0))
    assert [p.file for p in far.partitions()] == [""]  # no file is opened whose box misses the window


def test_window_of_a_file_equals_that_of_a_folder(spark, tmp_path):
    gpkg.register(spark)
    folder, file = str(tmp_path / "x"), str(tmp_path / "one.gpkg")
    for mode, some in (("overwrite", "id < 30"), ("append", "id >= 30")):
        lines(spark, 60).where(some).write.format("gpkg").mode(mode).option("path", folder).option("layer", "a").save()
    gpkg.merge(folder, file)
    assert gpkg.layers(file) == gpkg.layers(folder) == ["a"]
    for box in ("10.2,0,14,0.5", "-5,-5,-4,-4", "0,0,100,100"):
        a, b = (sorted(r["id"] for r in read(spark, p, bbox=box).collect()) for p in (folder, file))
        lo, hi = float(box.split(",")[0]), float(box.split(",")[2])
        assert a == b == [i for i in range(60) if i + 0.5 >= lo and i <= hi and hi > 0]
    with sqlite3.connect(file) as db:
        assert db.execute("select count(*) from rtree_a_geometry").fetchone() == (60,) and db.execute("pragma application_id").fetchone() == (1196444487,)
        assert db.execute("select min_x, max_x from gpkg_contents").fetchone() == (0.0, 59.5)
    assert sorted(r["id"] for r in read(spark, file, partitions="3").collect()) == list(range(60))
    assert read(spark, folder, keepFid="true").columns[0] == "fid"


def test_failed_writes_change_nothing(spark, tmp_path):
    """A write of which a task fails leaves the layer as it was, at overwrite and at append; files that no manifest names are not read."""
    gpkg.register(spark)
    path = str(tmp_path / "x")
    save = lambda df, mode: df.write.format("gpkg").mode(mode).option("path", path).option("layer", "a").save()
    save(lines(spark, 10), "overwrite")
    bad = lines(spark, 40).repartition(4).withColumn("half", F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("half")))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="lost"):
            save(bad, mode)
        assert sorted(r["id"] for r in read(spark, path).collect()) == list(range(10))
    save(read(spark, path).where("id < 4"), "overwrite")  # a layer written from itself
    assert read(spark, path).count() == 4
    save(lines(spark, 0), "append")
    save(lines(spark, 3), "append")
    assert read(spark, path).count() == 7
    listed = {p["file"] for v in manifest.read(path).values() for p in v["parts"]}
    assert listed <= set(os.listdir(path))
    with pytest.raises(Exception, match="another schema"):
        save(lines(spark, 3).drop("half"), "append")
    save(lines(spark, 0), "overwrite")
    assert read(spark, path).count() == 0 and read(spark, path).columns == lines(spark, 0).columns


def test_geometries_of_many_kinds():
    z = struct.pack("<BII", 1, 1002, 2) + struct.pack("<6d", 1, 2, 9, 3, 4, 9)
    ewkb = struct.pack("<BIII", 1, 2 | 0x80000000 | 0x20000000, 4326, 1) + struct.pack("<3d", 5, 6, 9)
    big = struct.pack(">BI2d", 0, 1, 7, 8)
    assert wkb.parts(z) == [[(1, 2), (3, 4)]] and wkb.parts(ewkb) == [[(5, 6)]] and wkb.parts(big) == [[(7, 8)]]
    rings = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.1)]]
    assert wkb.parts(wkb.polygon(rings)) == [[*rings[0], rings[0][0]], rings[1]] and wkb.envelope(wkb.polygon(rings)) == (0, 0, 1, 1)
    assert wkb.parts(wkb.multi_line(rings)) == rings and wkb.envelope(wkb.line([])) is None


@pytest.mark.parametrize("shape", ["point", "line", "polygon"])
def test_shapefile_round_trip(spark, tmp_path, shape):
    """Every kind of shape and value comes back, in ranges of few records, with nulls and a window."""
    shapefile.register(spark)
    path = str(tmp_path / "s")
    x = F.col("id").cast("double")
    parts = {"point": F.array(F.array(geo.point(x, x))), "line": F.array(F.array(geo.point(x, x), geo.point(x + 1, x)), F.array(geo.point(x, x + 2), geo.point(x + 3, x))), "polygon": shapefile.rings_of(F.array(ring(*SQUARE), ring(*HOLE)))}[shape]
    df = spark.range(25).select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("ñ"), F.col("id"))).alias("name"), (x / 3).alias("third"), (F.col("id") == 4).alias("flag"), F.to_date(F.lit("2024-02-29")).alias("day"), F.when(F.col("id") != 7, parts).alias("parts"))
    for mode, some in (("overwrite", "id < 15"), ("append", "id >= 15")):
        df.where(some).write.format("shapefile").mode(mode).option("path", path).option("layer", "l").option("shape", shape).save()
    back = spark.read.format("shapefile").options(path=path, rows="4").load()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    if shape == "point":
        some = spark.read.format("shapefile").options(path=path, layer="l", bbox="3,3,8,8").load()
        assert sorted(r["id"] for r in some.collect()) == [3, 4, 5, 6, 8]
    one = os.path.join(path, manifest.read(path)["l"]["parts"][0]["file"])
    assert spark.read.format("shapefile").load(one).count() == manifest.read(path)["l"]["parts"][0]["rows"]
    with zipfile.ZipFile(one) as z:
        assert struct.unpack(">i", z.read("l.shp")[24:28])[0] * 2 == z.getinfo("l.shp").file_size


def test_shapefile_refuses_what_it_cannot_hold(spark, tmp_path):
    shapefile.register(spark)
    save = lambda df: df.write.format("shapefile").mode("overwrite").option("path", str(tmp_path / "s")).save()
    point = F.array(F.array(geo.point(F.lit(1.0), F.lit(1.0)))).alias("parts")
    with pytest.raises(Exception, match="ten bytes"):
        save(spark.range(1).select(F.lit(1).cast("long").alias("a_long_name"), point))
    with pytest.raises(Exception, match="holds 254"):
        save(spark.range(1).select(F.repeat(F.lit("x"), 300).alias("t"), point))
    with pytest.raises(Exception, match="called parts"):
        save(spark.range(1))


def test_rings_become_polygons(spark):
    """A shape of two outer rings, one of them with a hole."""
    far = [(10, 10), (14, 10), (14, 14), (10, 14)]
    rings = F.array(ring(*SQUARE[::-1]), ring(*HOLE), ring(*far[::-1]))
    got = spark.range(1).select(shapefile.polygons_of(rings).alias("p")).select(F.size("p").alias("n"), F.transform("p", F.size).alias("rings"), F.transform("p", polygons.area).alias("areas")).first()
    assert (got["n"], got["rings"], got["areas"]) == (2, [2, 1], [15.0, 16.0])
