"""GeoPackage layers as a Spark data source: ``spark.read.format("gpkg").option("layer", name).load(path)``.

Geometries travel as WKB in a BINARY column.  ``path`` is one GeoPackage file,
or a folder of them with a manifest, which is what writing makes: each task
writes whole GeoPackages of its own, with a spatial index, and the driver
commits their names alone.  A folder takes any number of layers; mode
overwrite replaces one layer, append adds to it.  ``merge`` gathers a layer
into one file, for programs that want that.

Reading is dealt by file and by range of row ids.  Comparisons of columns with
literals are pushed into SQLite, and the ``bbox`` option goes through the
layer's spatial index, so that tasks read matching rows only.
"""

from __future__ import annotations

import math
import os
import re
import sqlite3
import struct
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from . import manifest, wkb
from .wkb import longest, nearest_part, parts_of, to_wkb  # noqa: F401  part of this module's interface

_NUMBERS = {"BOOLEAN": BooleanType(), "TINYINT": IntegerType(), "SMALLINT": IntegerType(), "MEDIUMINT": IntegerType(), "INT": LongType(), "INTEGER": LongType(), "FLOAT": DoubleType(), "DOUBLE": DoubleType(), "REAL": DoubleType()}
_NAMES = {LongType: "INTEGER", IntegerType: "MEDIUMINT", DoubleType: "DOUBLE", BooleanType: "BOOLEAN", BinaryType: "GEOMETRY", StringType: "TEXT"}
_GEOMETRIES = {"POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION", "BLOB"}
# Fixed values of the format: envelope sizes by kind, magic letters, and the tables every file has.
_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
MAGIC = b"GP"
_TABLES = """
pragma application_id = 1196444487;
pragma user_version = 10300;
create table if not exists gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
create table if not exists gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change text default '1970-01-01T00:00:00Z', min_x double, min_y double, max_x double, max_y double, srs_id integer);
create table if not exists gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));
create table if not exists gpkg_extensions (table_name text, column_name text, extension_name text not null, definition text not null, scope text not null);
"""
#: Rows a task puts into one file, and rows it reads.
FILE_ROWS, READ_ROWS = 1_000_000, 250_000


def strip_header(blob: bytes | None) -> bytes | None:
    """WKB of a GeoPackage geometry blob."""
    if blob is None or blob[:2] != MAGIC:
        return blob
    return blob[8 + _ENVELOPE[(blob[3] >> 1) & 7] :]


def add_header(data: bytes | None, srid: int) -> bytes | None:
    return None if data is None else MAGIC + struct.pack("<BBi", 0, 1, srid) + data


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def layers(path: str) -> list[str]:
    if os.path.isdir(path):
        return list(manifest.read(path))
    with _open(path) as db:
        return [r[0] for r in db.execute("select table_name from gpkg_contents order by rowid")]


def _layer(path: str, options) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    name = options.get("layer") or next(iter(layers(path)), None)
    if name not in layers(path):
        raise ValueError(f"no layer {name!r} in {path}")
    return name


def _where(f: Filter, kinds: dict) -> tuple[str, list] | None:
    """A filter as a condition of SQLite with its values; none if it can't be pushed."""
    if isinstance(f, Not):
        inner = _where(f.child, kinds)
        return inner and (f"not ({inner[0]})", inner[1])
    kind = kinds.get(f.attribute[0]) if len(f.attribute) == 1 else None
    if kind is None or isinstance(kind, BinaryType):
        return None
    name = _quoted(f.attribute[0])
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} is {'not ' * isinstance(f, IsNotNull)}null", []
    values = list(f.value) if isinstance(f, In) else [f.value]
    plain = lambda v: isinstance(v, str) if isinstance(kind, StringType) else isinstance(v, (bool, int)) or isinstance(v, float) and math.isfinite(v)
    if isinstance(f, EqualNullSafe) and f.value is None:
        return f"{name} is null", []
    if not all(map(plain, values)) or any(isinstance(v, int) and not -(1 << 63) <= v < 1 << 63 for v in values):
        return None
    values = [int(v) if isinstance(v, bool) else v for v in values]
    marks = {EqualTo: "=", EqualNullSafe: "is", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    if type(f) in marks:
        return f"{name} {marks[type(f)]} ?", values
    if isinstance(f, In):
        return f"{name} in ({', '.join('?' * len(values))})", values
    if isinstance(kind, StringType) and isinstance(f, StringStartsWith):
        return f"substr({name}, 1, ?) = ?", [len(f.value), f.value]
    if isinstance(kind, StringType) and isinstance(f, StringEndsWith) and f.value:
        return f"substr({name}, ?) = ?", [-len(f.value), f.value]
    if isinstance(kind, StringType) and isinstance(f, StringContains):
        return f"instr({name}, ?) > 0", values
    return None


@dataclass
class RowRange(InputPartition):
    file: str
    low: int
    high: int


class GpkgReader(DataSourceReader):
    def __init__(self, path: str, layer: str, schema: StructType, parts: int | None, box: tuple | None):
        self.path, self.layer, self.fields, self.parts, self.box = path, layer, schema, parts, box
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        kinds = {f.name: f.dataType for f in self.fields}
        for f in filters:
            found = _where(f, kinds)
            if found is None:
                yield f
            else:
                self.conditions.append(found)

    def partitions(self) -> list[RowRange]:
        out = []
        if os.path.isdir(self.path):
            listed = [p for p in manifest.read(self.path)[self.layer]["parts"] if manifest.meets(p, self.box)]
            spans = [(os.path.join(self.path, p["file"]), 1, p["rows"]) for p in listed]
        else:
            with _open(self.path) as db:
                spans = [(self.path, *db.execute(f"select min(rowid), max(rowid) from {_quoted(self.layer)}").fetchone())]
        for file, low, high in spans:
            if low is not None and high >= low:
                n = high - low + 1
                step = max(1, -(-n // self.parts)) if self.parts else min(n, READ_ROWS)
                out += [RowRange(file, a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
        return out or [RowRange("", 0, 0)]

    def _geometry(self, db: sqlite3.Connection) -> str | None:
        found = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (self.layer,)).fetchone()
        return found and found[0]

    def read(self, partition: RowRange):
        if not partition.file:
            return
        makers = [bool if isinstance(f.dataType, BooleanType) else strip_header if isinstance(f.dataType, BinaryType) else None for f in self.fields]
        where, values = ["rowid >= ?", "rowid < ?"], [partition.low, partition.high]
        for condition, own in self.conditions:
            where.append(f"({condition})")
            values += own
        with _open(partition.file) as db:
            columns, at = [_quoted(f.name) for f in self.fields], None
            if self.box:
                geometry = self._geometry(db)
                if geometry is None:
                    raise ValueError(f"layer {self.layer!r} has no geometry to compare with a bbox")
                index = f"rtree_{self.layer}_{geometry}"
                if db.execute("select 1 from sqlite_master where name = ?", (index,)).fetchone():
                    where.append(f"rowid in (select id from {_quoted(index)} where maxx >= ? and minx <= ? and maxy >= ? and miny <= ?)")
                    values += [self.box[0], self.box[2], self.box[1], self.box[3]]
                at = len(columns)
                columns.append(_quoted(geometry))
            for row in db.execute(f"select {', '.join(columns) or '1'} from {_quoted(self.layer)} where {' and '.join(where)}", values):
                if at is not None:
                    own = wkb.envelope(strip_header(row[at])) if row[at] else None
                    if not manifest.meets({"box": own}, self.box):
                        continue  # the index keeps single precision, rounded outwards
                yield tuple(x if m is None or x is None else m(x) for m, x in zip(makers, row))


@dataclass
class Written(WriterCommitMessage):
    parts: list


def _create(db: sqlite3.Connection, layer: str, fields: StructType, srid: int) -> list[str]:
    """An empty layer with its entries and spatial indexes; the names of its geometry columns."""
    db.executescript(_TABLES)
    columns = ", ".join(f"{_quoted(f.name)} {_NAMES.get(type(f.dataType), 'TEXT')}" for f in fields)
    db.execute(f"create table {_quoted(layer)} (fid integer primary key, {columns})")
    db.execute("insert or ignore into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{srid}", srid, srid))
    shapes = [f.name for f in fields if isinstance(f.dataType, BinaryType)]
    db.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, ?, ?, ?)", (layer, "features" if shapes else "attributes", layer, srid))
    for name in shapes[:1]:
        db.execute("insert into gpkg_geometry_columns values (?, ?, 'GEOMETRY', ?, 0, 0)", (layer, name, srid))
        db.execute(f"create virtual table {_quoted(f'rtree_{layer}_{name}')} using rtree(id, minx, maxx, miny, maxy)")
        db.execute("insert into gpkg_extensions values (?, ?, 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (layer, name))
    return shapes


class GpkgWriter(DataSourceWriter):
    def __init__(self, path: str, layer: str, schema: StructType, srid: int, overwrite: bool):
        self.path, self.layer, self.fields, self.srid, self.overwrite = path, layer, schema, srid, overwrite
        if os.path.isfile(path):
            raise ValueError(f"{path} is one file; a folder is written, which merge() makes a file of")
        held = manifest.read(path).get(layer)
        if held and not overwrite and held["schema"] != schema.jsonValue():
            raise ValueError(f"layer {layer!r} has another schema: append needs the same columns")

    def write(self, rows) -> Written:
        """Whole GeoPackages, each under a name of its own, of at most ``FILE_ROWS`` rows."""
        parts, batch = [], []
        for row in rows:
            batch.append(row)
            if len(batch) == 10_000:
                self._put(parts, batch)
                batch = []
        if batch:
            self._put(parts, batch)
        for p in parts:
            p.pop("n", None)
        return Written(parts)

    def _put(self, parts: list[dict], batch: list) -> None:
        new = not parts or parts[-1]["rows"] >= FILE_ROWS
        if new:
            parts.append({"file": manifest.fresh(self.path, self.layer, ".gpkg"), "rows": 0, "box": None})
        part = parts[-1]
        db = sqlite3.connect(os.path.join(self.path, part["file"]))
        shapes = _create(db, self.layer, self.fields, self.srid) if new else [f.name for f in self.fields if isinstance(f.dataType, BinaryType)]
        at = {i for i, f in enumerate(self.fields) if isinstance(f.dataType, BinaryType)}
        main = next((i for i, f in enumerate(self.fields) if shapes and f.name == shapes[0]), None)
        first = part["rows"] + 1
        values = [(first + k, *(add_header(bytes(x), self.srid) if i in at and x is not None else x for i, x in enumerate(row))) for k, row in enumerate(batch)]
        db.executemany(f"insert into {_quoted(self.layer)} values ({', '.join('?' * (1 + len(self.fields)))})", values)
        if main is not None:
            boxes = [(first + k, wkb.envelope(bytes(row[main]))) for k, row in enumerate(batch) if row[main] is not None]
            boxes = [(k, b) for k, b in boxes if b]
            db.executemany(f"insert into {_quoted(f'rtree_{self.layer}_{shapes[0]}')} values (?, ?, ?, ?, ?)", [(k, b[0], b[2], b[1], b[3]) for k, b in boxes])
            part["box"] = manifest.joined([part["box"], *(b for _, b in boxes)])
            if part["box"]:
                db.execute("update gpkg_contents set min_x = ?, min_y = ?, max_x = ?, max_y = ? where table_name = ?", (*part["box"], self.layer))
        part["rows"] += len(batch)
        db.commit()
        db.close()

    def commit(self, messages) -> None:
        written = [p for m in messages if m is not None for p in m.parts]

        def change(held: dict) -> dict:
            before = [] if self.overwrite or self.layer not in held else held[self.layer]["parts"]
            return held | {self.layer: {"schema": self.fields.jsonValue(), "srid": self.srid, "parts": before + written}}

        manifest.replace(self.path, change)

    def abort(self, messages) -> None:
        manifest.discard(self.path, [p["file"] for m in messages if m is not None for p in m.parts])


class GpkgSource(DataSource):
    """Options: path; layer (default: the first; to write: "layer"); bbox ("xmin,ymin,xmax,ymax": rows whose geometry's box meets it);
    partitions (ranges of rows for each file); srid (written, default 4326); keepFid to read the row id, unique within a file."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> StructType:
        path, keep = self.options["path"], self.options.get("keepfid", "false").lower() == "true"
        layer = _layer(path, self.options)
        if os.path.isdir(path):
            held = StructType.fromJson(manifest.read(path)[layer]["schema"])
            return StructType([StructField("fid", LongType()), *held.fields]) if keep else held
        with _open(path) as db:
            info = db.execute(f"pragma table_info({_quoted(layer)})").fetchall()
        fields = []
        for _, name, kind, _, _, key in info:
            if key and not keep:
                continue
            base = re.sub(r"\(.*", "", kind or "TEXT").upper()
            fields.append(StructField(name, BinaryType() if "GEOMETRY" in base or base in _GEOMETRIES else _NUMBERS.get(base, StringType())))
        return StructType(fields)

    def reader(self, schema: StructType) -> GpkgReader:
        path, box = self.options["path"], self.options.get("bbox")
        parts = self.options.get("partitions")
        return GpkgReader(path, _layer(path, self.options), schema, parts and int(parts), box and tuple(float(x) for x in box.split(",")))

    def writer(self, schema: StructType, overwrite: bool) -> GpkgWriter:
        return GpkgWriter(self.options["path"], self.options.get("layer", "layer"), schema, int(self.options.get("srid", "4326")), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark offer its filters to Python sources."""
    spark.dataSource.register(GpkgSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def merge(folder: str, file: str) -> None:
    """All layers of a folder gathered into one new GeoPackage, by one process: an export for other programs, not for large layers."""
    if os.path.exists(file):
        raise FileExistsError(file)
    db = sqlite3.connect(f"{file}.part")
    for layer, held in manifest.read(folder).items():
        fields = StructType.fromJson(held["schema"])
        shapes, columns = _create(db, layer, fields, held["srid"]), ", ".join(_quoted(f.name) for f in fields)
        db.commit()
        for p in held["parts"]:
            db.execute("attach ? as part", (os.path.join(folder, p["file"]),))
            last = db.execute(f"select coalesce(max(fid), 0) from main.{_quoted(layer)}").fetchone()[0]
            db.execute(f"insert into main.{_quoted(layer)} select fid + ?, {columns} from part.{_quoted(layer)}", (last,))
            for name in shapes[:1]:
                index = _quoted(f"rtree_{layer}_{name}")
                db.execute(f"insert into main.{index} select id + ?, minx, maxx, miny, maxy from part.{index}", (last,))
            db.commit()
            db.execute("detach part")
        box = manifest.joined(p["box"] for p in held["parts"])
        if box:
            db.execute("update gpkg_contents set min_x = ?, min_y = ?, max_x = ?, max_y = ? where table_name = ?", (*box, layer))
            db.commit()
    db.close()
    os.replace(f"{file}.part", file)
