"""Zipped shapefile layers as a Spark data source: ``spark.read.format("shapefile").load(path)``.

``path`` is a zip file, a folder of zip files with a manifest (what writing
makes), or an address that pyarrow can open.  A layer has the columns of its
.dbf and ``parts``: ARRAY of lines, rings (outer ones clockwise, as the format
has it) or single points.  Records are dealt in ranges by the .shx index, a
task for each; a task reads its own records, a block at a time.  A compressed
member can't be entered in its midst, so a task inflates what comes before
its records, and throws that away; stored members are entered directly.
"""

from __future__ import annotations

import datetime
import os
import struct
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import polygons
from . import manifest
from .wkb import PARTS

# Fixed values of the format.
NULL, POINT, LINE, POLYGON, MULTIPOINT = 0, 1, 3, 5, 8
_FILE_CODE, _VERSION = 9994, 1000
#: Records a task reads, and those it puts into one file.
READ_ROWS, FILE_ROWS = 100_000, 50_000
_BLOCK = 1 << 20


def _file(path: str):
    """A seekable file, here or in a store that pyarrow knows."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def members(archive: zipfile.ZipFile, layer: str | None) -> dict[str, str]:
    """Names of a layer's files by ending; the layer is the stem of its .shp, by default the first."""
    names = archive.namelist()
    shapes = sorted(n for n in names if n.lower().endswith(".shp") and (layer is None or os.path.basename(n)[:-4] == layer))
    if not shapes:
        raise ValueError(f"no layer {layer!r} in the archive" if layer else "no layer in the archive")
    stem = shapes[0][:-4]
    return {n[len(stem) + 1 :].lower(): n for n in names if n.startswith(stem + ".")}


@dataclass
class Table:
    """A .dbf header: rows, bytes before them and of each, encoding, and fields (name, kind, width, decimals)."""

    rows: int
    start: int
    width: int
    encoding: str
    fields: list[tuple[str, str, int, int]]

    @classmethod
    def of(cls, archive: zipfile.ZipFile, files: dict[str, str]) -> Table:
        encoding = archive.read(files["cpg"]).decode("ascii", "replace").strip() if "cpg" in files else "latin-1"
        encoding = {"": "latin-1", "1252": "cp1252", "ANSI 1252": "cp1252"}.get(encoding, encoding)
        with archive.open(files["dbf"]) as f:
            head = f.read(32)
            rows, start, width = struct.unpack_from("<IHH", head, 4)
            raw = f.read(start - 32)
        fields = []
        for at in range(0, len(raw) - 31, 32):
            if raw[at] == 0x0D:
                break
            fields.append((raw[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        return cls(rows, start, width, encoding, fields)

    def schema(self) -> StructType:
        kinds = {"N": lambda d: DoubleType() if d else LongType(), "F": lambda d: DoubleType(), "L": lambda d: BooleanType(), "D": lambda d: DateType()}
        return StructType([StructField(n, kinds.get(k, lambda d: StringType())(d)) for n, k, _, d in self.fields])

    def values(self, record: bytes) -> list:
        """One record's values; blank numbers, dates, flags and texts are null."""
        out, at = [], 1
        for _, kind, width, decimals in self.fields:
            text = record[at : at + width].decode(self.encoding, "replace").strip(" \0")
            at += width
            if not text or kind in "NF" and set(text) == {"*"}:
                out.append(None)
            elif kind == "N" and not decimals:
                out.append(int(text))
            elif kind in "NF":
                out.append(float(text))
            elif kind == "L":
                out.append(text in "YyTt" if text in "YyTtNnFf" else None)
            elif kind == "D":
                out.append(datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])))
            else:
                out.append(text)
        return out


def shape_parts(data: bytes) -> list | None:
    """The parts of a record's content; none of a null shape."""
    kind = struct.unpack_from("<i", data, 0)[0] % 10
    points = lambda n, at: [{"x": x, "y": y} for x, y in struct.iter_unpack("<dd", data[at : at + 16 * n])]
    if kind == NULL:
        return None
    if kind == POINT:
        return [points(1, 4)]
    if kind == MULTIPOINT:
        return [[p] for p in points(struct.unpack_from("<i", data, 36)[0], 40)]
    n_parts, n = struct.unpack_from("<ii", data, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", data, 44), n]
    every = points(n, 44 + 4 * n_parts)
    return [every[a:b] for a, b in zip(starts, starts[1:])]


def shape_content(kind: int, parts: list | None) -> tuple[bytes, tuple | None]:
    """(a record's content, its box)."""
    every = [(p["x"], p["y"]) for part in parts or () for p in part]
    if not every:
        return struct.pack("<i", NULL), None
    box = min(x for x, _ in every), min(y for _, y in every), max(x for x, _ in every), max(y for _, y in every)
    flat = b"".join(struct.pack("<dd", *p) for p in every)
    if kind == POINT:
        return struct.pack("<i", POINT) + flat[:16], box
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    return struct.pack("<i4dii", kind, *box, len(starts), len(every)) + struct.pack(f"<{len(starts)}i", *starts) + flat, box


def _skip(f, n: int) -> None:
    if f.seekable():
        f.seek(n)  # within a compressed member this inflates and drops the bytes up to there
        return
    while n > 0:
        n -= len(f.read(min(n, _BLOCK)))


@dataclass
class Records(InputPartition):
    file: str
    layer: str | None
    first: int
    last: int


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, layer: str | None, schema: StructType, rows: int, box: tuple | None):
        self.path, self.layer, self.fields, self.rows, self.box = path, layer, schema, rows, box

    def partitions(self) -> list[Records]:
        out = []
        for file in _files(self.path, self.layer, self.box):
            with _file(file) as raw, zipfile.ZipFile(raw) as archive:
                index = members(archive, self.layer)["shx"]
                n = (archive.getinfo(index).file_size - 100) // 8
            out += [Records(file, self.layer, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out or [Records("", None, 0, 0)]

    def read(self, partition: Records):
        if not partition.file:
            return
        with _file(partition.file) as raw, zipfile.ZipFile(raw) as archive:
            files = members(archive, partition.layer)
            table = Table.of(archive, files)
            places = {f.name: i for i, f in enumerate(table.schema())}
            with archive.open(files["shx"]) as index:
                _skip(index, 100 + 8 * partition.first)
                spans = list(struct.iter_unpack(">ii", index.read(8 * (partition.last - partition.first))))
            with archive.open(files["shp"]) as shapes, archive.open(files["dbf"]) as rows:
                at = 0
                _skip(rows, table.start + table.width * partition.first)
                if spans:
                    at = 2 * spans[0][0]
                    _skip(shapes, at)
                for offset, words in spans:
                    if 2 * offset > at:
                        shapes.read(2 * offset - at)  # a gap between records
                    content = shapes.read(8 + 2 * words)[8:]
                    at = 2 * offset + 8 + 2 * words
                    record = rows.read(table.width)
                    if record[:1] == b"*":
                        continue  # a deleted row
                    parts = shape_parts(content)
                    if self.box is not None and not manifest.meets({"box": _box(parts)}, self.box):
                        continue
                    values = table.values(record)
                    yield tuple(parts if f.name == "parts" and f.name not in places else values[places[f.name]] for f in self.fields)


def _box(parts) -> tuple | None:
    every = [(p["x"], p["y"]) for part in parts or () for p in part]
    return (min(x for x, _ in every), min(y for _, y in every), max(x for x, _ in every), max(y for _, y in every)) if every else None


def _files(path: str, layer: str | None, box: tuple | None = None) -> list[str]:
    if "://" in path or not os.path.isdir(path):
        return [path]
    held = manifest.read(path)
    name = layer or next(iter(held), None)
    if name not in held:
        raise ValueError(f"no layer {name!r} in {path}")
    return [os.path.join(path, p["file"]) for p in held[name]["parts"] if manifest.meets(p, box)]


_WIDTHS = {LongType: ("N", 20, 0), DoubleType: ("F", 25, 17), BooleanType: ("L", 1, 0), DateType: ("D", 8, 0), StringType: ("C", 254, 0)}


@dataclass
class Written(WriterCommitMessage):
    parts: list


class ShapefileWriter(DataSourceWriter):
    def __init__(self, path: str, layer: str, kind: int, schema: StructType, overwrite: bool):
        self.path, self.layer, self.kind, self.fields, self.overwrite = path, layer, kind, schema, overwrite
        rest = [f for f in schema if f.name != "parts"]
        if "parts" not in schema.names:
            raise ValueError("a shapefile needs a column called parts")
        odd = [f.name for f in rest if len(f.name.encode()) > 10 or type(f.dataType) not in _WIDTHS]
        if odd:
            raise ValueError(f"a shapefile can't hold {odd}: names have ten bytes at most, types are LONG, DOUBLE, BOOLEAN, DATE and STRING")
        held = manifest.read(path).get(layer)
        if held and not overwrite and held["schema"] != schema.jsonValue():
            raise ValueError(f"layer {layer!r} has another schema: append needs the same columns")

    def write(self, rows) -> Written:
        parts, batch = [], []
        for row in rows:
            batch.append(row)
            if len(batch) == FILE_ROWS:
                parts.append(self._put(batch))
                batch = []
        return Written(parts + ([self._put(batch)] if batch else []))

    def _put(self, batch: list) -> dict:
        at = self.fields.names.index("parts")
        rest = [(i, f.name, *_WIDTHS[type(f.dataType)]) for i, f in enumerate(self.fields) if i != at]
        shapes, index, table, boxes, place = [], [], [], [], 50
        for k, row in enumerate(batch):
            content, box = shape_content(self.kind, row[at])
            boxes.append(box)
            words = len(content) // 2
            shapes.append(struct.pack(">ii", k + 1, words) + content)
            index.append(struct.pack(">ii", place, words))
            place += 4 + words
            table.append(b" " + b"".join(_cell(row[i], kind, width, name) for i, name, kind, width, _ in rest))
        whole = manifest.joined(boxes)
        head = lambda words: struct.pack(">7i", _FILE_CODE, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", _VERSION, self.kind, *(whole or (0.0,) * 4), 0, 0, 0, 0)
        described = b"".join(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), width, decimals) for _, name, kind, width, decimals in rest)
        record = 1 + sum(r[3] for r in rest)
        dbf = struct.pack("<B3BIHH20x", 3, 70, 1, 1, len(batch), 33 + len(described), record) + described + b"\r" + b"".join(table) + b"\x1a"
        file = manifest.fresh(self.path, self.layer, ".zip")
        with zipfile.ZipFile(os.path.join(self.path, file), "w", zipfile.ZIP_DEFLATED) as archive:
            for ending, data in (("shp", head(place) + b"".join(shapes)), ("shx", head(50 + 4 * len(batch)) + b"".join(index)), ("dbf", dbf), ("cpg", b"UTF-8")):
                archive.writestr(f"{self.layer}.{ending}", data)
        return {"file": file, "rows": len(batch), "box": whole}

    def commit(self, messages) -> None:
        written = [p for m in messages if m is not None for p in m.parts]

        def change(held: dict) -> dict:
            before = [] if self.overwrite or self.layer not in held else held[self.layer]["parts"]
            return held | {self.layer: {"schema": self.fields.jsonValue(), "parts": before + written}}

        manifest.replace(self.path, change)

    def abort(self, messages) -> None:
        manifest.discard(self.path, [p["file"] for m in messages if m is not None for p in m.parts])


def _cell(value, kind: str, width: int, name: str) -> bytes:
    """A value as the text of a .dbf cell; a text that doesn't fit is an error, never cut."""
    if value is None:
        text = b""
    elif kind == "L":
        text = b"T" if value else b"F"
    elif kind == "D":
        text = value.strftime("%Y%m%d").encode()
    elif kind == "F":
        text = repr(float(value)).encode()
    else:
        text = str(value).encode()
    if len(text) > width:
        raise ValueError(f"a value of {name} has {len(text)} bytes; a shapefile holds {width}")
    return text.rjust(width) if kind in "NF" else text.ljust(width)


class ShapefileSource(DataSource):
    """Options: path; layer (the .shp's stem, default: the first; to write: "layer"); bbox ("xmin,ymin,xmax,ymax"); rows (records a task reads);
    shape (written: point, line or polygon, the default)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        path, layer = self.options["path"], self.options.get("layer")
        if "://" not in path and os.path.isdir(path):
            held = manifest.read(path)
            return StructType.fromJson(held[layer or next(iter(held))]["schema"])
        with _file(path) as raw, zipfile.ZipFile(raw) as archive:
            return StructType([*Table.of(archive, members(archive, layer)).schema().fields, StructField("parts", PARTS)])

    def reader(self, schema: StructType) -> ShapefileReader:
        box = self.options.get("bbox")
        return ShapefileReader(self.options["path"], self.options.get("layer"), schema, int(self.options.get("rows", READ_ROWS)), box and tuple(float(x) for x in box.split(",")))

    def writer(self, schema: StructType, overwrite: bool) -> ShapefileWriter:
        kind = {"point": POINT, "line": LINE, "polygon": POLYGON}[self.options.get("shape", "polygon")]
        return ShapefileWriter(self.options["path"], self.options.get("layer", "layer"), kind, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)


def rings_of(polygon: Column) -> Column:
    """A polygon as the format wants it: rings closed, the outer one clockwise, holes counter-clockwise."""
    closed = lambda ring: F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))
    turned = lambda ring: F.concat(F.slice(ring, F.lit(1), F.lit(1)), F.reverse(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))))
    return F.transform(polygons.oriented(polygon), lambda ring: closed(turned(ring)))


def polygons_of(rings: Column) -> Column:
    """ARRAY of polygons: each clockwise ring with the counter-clockwise ones that begin inside it."""
    outer = F.filter(rings, lambda r: polygons.signed_area(polygons.opened(r)) <= 0)
    holes = F.filter(rings, lambda r: polygons.signed_area(polygons.opened(r)) > 0)
    return F.transform(outer, lambda o: F.concat(F.array(o), F.filter(holes, lambda h: polygons.contains(F.array(o), F.try_element_at(h, F.lit(1))))))
