"""Readers of the pipeline's inputs and writers of its layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.crs import Lambert
from ..functions.rounding import number

ROUTE = "struct<code:string,routes:array<struct<distance:double,geometry:struct<coordinates:array<array<double>>>>>>"


def with_srid(df: DataFrame, srid: int, column: str = "line") -> DataFrame:
    """The reference system relabelled; coordinates stay."""
    return df.withMetadata(column, {**df.schema[column].metadata, "srid": srid})


def project(line: Column, crs: Lambert | None = None) -> Column:
    """A line in degrees as one in metres."""
    crs = crs or Lambert()
    return F.transform(line, lambda p: crs.forward(p["x"], p["y"]))


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as DOUBLE; what is no number is null."""
    return df.withColumns({c: number(F.col(c).cast("string")) for c in columns})


def counts(df: DataFrame, slot: int = 1, degrees: bool = False) -> DataFrame:
    """Counts with longueur_m, djma_val, djma_annee, cam_val and cam_annee of a slot; ``line`` is projected from degrees if so."""
    out = df.withColumn("line", project(F.col("line"))) if degrees else df
    names = {"djma_val": f"val_djma_annee_{slot}", "djma_annee": f"djma_annee_{slot}", "cam_val": f"val_cam_annee_{slot}", "cam_annee": f"cam_annee_{slot}"}
    return out.withColumns({"longueur_m": geo.length(F.col("line"))} | {new: number(F.col(old).cast("string")) for new, old in names.items()})


def roads(df: DataFrame, degrees: bool = False) -> DataFrame:
    """The road network with seg_long_m."""
    out = df.withColumn("line", project(F.col("line"))) if degrees else df
    return out.withColumn("seg_long_m", geo.length(F.col("line")))


def routes(df: DataFrame, response: str = "response") -> DataFrame:
    """Routing answers (JSON) as statut (ok, echec_osrm, erreur_api), distance_m and ``line`` in degrees.

    Unreadable or absent answers are erreur_api; answers of another code, or without a route, echec_osrm.
    """
    got = F.from_json(F.col(response), ROUTE)
    first = F.try_element_at(got["routes"], F.lit(1))
    status = F.when(got.isNull() | got["code"].isNull(), "erreur_api").when((got["code"] != "Ok") | first.isNull(), "echec_osrm").otherwise("ok")
    line = F.transform(first["geometry"]["coordinates"], lambda c: geo.point(F.try_element_at(c, F.lit(1)), F.try_element_at(c, F.lit(2))))
    rows = df.withColumn("statut", status)
    ok = F.col("statut") == "ok"
    return rows.withColumns({"distance_m": F.when(ok, first["distance"]), "line": F.when(ok, line)})


def fetched(df: DataFrame, url, timeout: float = 10.0, pause: float = 0.5, key: str = "ID_ARC", tasks: int = 1) -> DataFrame:
    """(key, response): answers of a routing service; null on any failure.

    ``url``: a function of (lon_a, lat_a, lon_b, lat_b) that gives the address.
    ``tasks`` ask at once, each with ``tasks`` times the pause after a
    question, so that the service is asked as often as by one.
    """

    def ask(batches):
        import time
        import urllib.request

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    with urllib.request.urlopen(url(r.lon_a, r.lat_a, r.lon_b, r.lat_b), timeout=timeout) as answer:
                        out.append(answer.read().decode())
                except Exception:  # noqa: BLE001  any failure is one status
                    out.append(None)
                time.sleep(pause * tasks)
            yield type(pdf)({key: pdf[key], "response": out})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "lon_a", "lat_a", "lon_b", "lat_b").repartition(tasks).mapInPandas(ask, f"`{key}` {kind}, response string")


def subset(df: DataFrame, key: str, one=None, some: list | None = None, first: int | None = None, order: str | None = None) -> DataFrame:
    """One id, or else a list of ids, or else the first rows by ``order``, or else all."""
    if one is not None:
        return df.where(F.col(key) == one)
    if some:
        return df.where(F.col(key).isin(some))
    return df.orderBy(order or key).limit(first) if first is not None else df


def write_layers(layers: dict[str, DataFrame], path: str, first: str = "ID_ARC", last: str = "geometry") -> None:
    """Each layer as Parquet under ``path``: fid dropped, ``first`` leading, ``last`` closing."""
    for name, df in layers.items():
        rest = [c for c in df.columns if c not in ("fid", first, last)]
        df.select(*[c for c in (first,) if c in df.columns], *rest, *[c for c in (last,) if c in df.columns]).write.mode("overwrite").parquet(f"{path}/{name}")


def read_layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def optional(spark: SparkSession, *paths: str) -> list[DataFrame] | None:
    """The Parquet tables of a source that may be absent; None if any of them is missing."""
    from pyspark.errors import AnalysisException

    try:
        return [spark.read.parquet(path) for path in paths]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
