"""Queries through file formats: lines and polygons made of the vectors, written as layers and read back."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo, polygons
from ..functions.rounding import half_even
from ..operators.scratch import shared_dir
from ..sources import gpkg, shapefile, wkb
from .polygon_queries import _SUMS, _area_sql, _polygons, _rings_sql
from .registry import query, table
from .spatial_queries import _edges_sql, _lines, _r, _span, _VERTICES_SQL

BOX = (4.0, 6.0, 8.0, 10.5)


def _folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can write."""
    return tempfile.mkdtemp(prefix="spark-", dir=shared_dir(spark).removeprefix("file://"))


def _lines_layer(spark: SparkSession, sf: str) -> str:
    """All lines written to a layer in two goes, with id, label and name."""
    gpkg.register(spark)
    path = f"{_folder(spark)}/layers"
    rows = _lines(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label")), "id")
    rows = rows.select("id", "label", F.concat(F.lit("n° "), "id").alias("name"), wkb.to_wkb(F.col("line")).alias("geometry"))
    for mode, some in (("overwrite", "id % 2 = 0"), ("append", "id % 2 = 1")):
        rows.where(some).write.format("gpkg").mode(mode).option("path", path).option("layer", "lines").option("srid", "32198").save()
    return path


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.format("gpkg").options(path=path, layer="lines", **options).load()


_LENGTHS = f"{_edges_sql('e', 'a', 'q')}, n as (select aid as id, {_r('sum(' + _span('ax', 'ay', 'qx', 'qy') + ')')} as length, min(least(ax, qx)) as x0, max(greatest(ax, qx)) as x1, min(least(ay, qy)) as y0, max(greatest(ay, qy)) as y1 from e group by aid)"


@query(f"with {_LENGTHS} select n.id, v.label::bigint as label, 'n° ' || n.id as name, {_VERTICES_SQL} as vertices, length from n join embeddings v on v.vec_id = n.id")
def gpkg_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Lines written to a GeoPackage layer and read back."""
    line = wkb.longest(wkb.parts_of(F.col("geometry")))
    back = _read(spark, _lines_layer(spark, sf)).withColumn("line", line)
    return back.select("id", "label", "name", F.size("line").cast("long").alias("vertices"), half_even(geo.length(F.col("line")), 6).alias("length"))


@query(f"with {_LENGTHS} select n.id, length from n join embeddings v on v.vec_id = n.id where v.label >= 3 and v.label <> 7 and x1 >= {BOX[0]} and x0 <= {BOX[2]} and y1 >= {BOX[1]} and y0 <= {BOX[3]}")
def gpkg_pushdown(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of some labels whose box meets a window: SQLite and its spatial index choose the rows."""
    some = _read(spark, _lines_layer(spark, sf), bbox=",".join(map(str, BOX))).where("label >= 3 and label <> 7")
    return some.select("id", half_even(geo.length(wkb.longest(wkb.parts_of(F.col("geometry")))), 6).alias("length"))


@query(f"with {_rings_sql()}, {_SUMS.format('rings')} select id, label::bigint as label, coalesce(label = 3, false) as own, round_even(area * 1e6, 0) / 1e6 as area, vertices, (select {_area_sql()} > 0 from rings r where r.id = s.id and no = 0) as turned from s")
def shapefile_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons written as zipped shapefiles, read back, turned to polygons again and split by name."""
    shapefile.register(spark)
    path = f"{_folder(spark)}/shapes"
    rows = _polygons(spark, sf).select("id", F.col("label").cast("long").alias("label"), F.col("label").cast("string").alias("name"), shapefile.rings_of(F.col("polygon")).alias("parts"))
    rows.write.format("shapefile").mode("overwrite").option("path", path).option("layer", "areas").save()
    back = spark.read.format("shapefile").options(path=path, layer="areas").load()
    back = back.withColumn("polygon", F.get(shapefile.polygons_of(F.col("parts")), F.lit(0)))
    own, others = polygons.split_by_name(back, "3")
    both = own.withColumn("own", F.lit(True)).unionByName(others.withColumn("own", F.lit(False)))
    vertices = F.aggregate(F.transform("polygon", lambda r: F.size(polygons.opened(r))), F.lit(0).cast("long"), lambda s, n: s + n)
    clockwise = polygons.signed_area(polygons.opened(F.get("polygon", F.lit(0)))) < 0  # the vectors' rings run the other way
    return both.select("id", "label", "own", half_even(polygons.area(F.col("polygon")), 6).alias("area"), vertices.alias("vertices"), clockwise.alias("turned"))
