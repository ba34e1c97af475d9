"""Clean-up of map-project documents: tables of their elements, the changes that these need, and the documents with them.

A document is read once into a flat table; joins and filters decide what
changes; the changes go back to the document by element number.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from .scratch import cut


def rename_groups(layers: DataFrame, names: dict[str, str], column: str = "group_name") -> DataFrame:
    return layers.withColumn(column, codec.relabel(F.col(column), names))


def removed_ids(layers: DataFrame, legacy: str, id_: str = "layer_id", column: str = "group_name") -> DataFrame:
    """Ids of the layers under a legacy group."""
    return layers.where(F.col(column) == legacy).select(id_).distinct()


def purge(maps: DataFrame, removed: DataFrame, id_: str = "layer_id") -> DataFrame:
    return maps.join(removed, id_, "left_anti")


def migrate_sources(layers: DataFrame, rules: dict[str, str], column: str = "datasource") -> DataFrame:
    """Data sources moved by prefix rules, and whether each was (``migrated``)."""
    moved = codec.migrate_prefix(F.col(column), rules)
    return layers.withColumn("migrated", ~moved.eqNullSafe(F.col(column))).withColumn(column, moved)


def rename_labels(layers: DataFrame, labels: dict[str, str], column: str = "layer_name") -> DataFrame:
    """Exact labels renamed, and whether each was (``renamed``)."""
    new = codec.relabel(F.col(column), labels)
    return layers.withColumn("renamed", ~new.eqNullSafe(F.col(column))).withColumn(column, new)


#: Tags of a document's elements that the tables hold, and what they are called there.
KINDS = {"layer-tree-group": "group", "layer-tree-layer": "layer", "maplayer": "map", "datasource": "source", "layername": "label", "title": "title", "qgis": "document"}
ELEMENT = "path string, no int, kind string, layer_id string, value string, group_path string, top string, depth int"


@dataclass
class Rules:
    """What a clean-up sets: the title, names of top groups, the group that goes, prefixes of data sources, exact labels."""

    title: str | None = None
    groups: dict[str, str] = field(default_factory=dict)
    legacy: str | None = None
    sources: dict[str, str] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)


def document_of(path: str, content: bytes) -> tuple[str, bytes]:
    """Name and bytes of the project document in an archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if name.endswith(".qgs"):
                return name, z.read(name)
    raise FileNotFoundError(f"{path} holds no project document")


def _table_of(path: str, xml: bytes) -> list[tuple]:
    """One pass over a document's parse events; an element's number counts the elements begun before it.

    Groups are those inside the first of them, which is the tree itself; ``depth`` counts the groups around.
    """
    rows, names, maps, open_, number = [], [], [], [], -1
    for event, e in ET.iterparse(io.BytesIO(xml), ("start", "end")):
        kind = KINDS.get(e.tag)
        if event == "start":
            number += 1
            open_.append(number)
            if kind == "group":
                names.append(e.get("name") or "")
            elif kind == "map":
                maps.append(len(rows))
            continue
        no, inside = open_.pop(), names[1:]  # at an element's end its content is there
        if kind == "group":
            names.pop()
            inside = names[1:]
            if names:
                own = e.get("name")
                rows.append((path, no, kind, None, own, "/".join(inside), inside[0] if inside else own, len(inside)))
        elif kind == "layer":
            rows.append((path, no, kind, e.get("id"), e.get("name"), "/".join(inside), inside[0] if inside else None, len(inside)))
        elif kind == "map":
            first, of = maps.pop(), e.findtext("id")
            rows[first:] = [(*r[:3], of if r[2] in ("source", "label") else r[3], *r[4:]) for r in rows[first:]]
            rows.append((path, no, kind, of, None, None, None, 0))
        elif kind:
            rows.append((path, no, kind, None, e.text if kind != "document" else e.get("projectname"), None, None, 0))
    return sorted(rows, key=lambda r: r[1])


def elements(files: DataFrame) -> DataFrame:
    """A row for each group, layer, map layer, data source, label and title of zipped projects: path, no, kind, layer_id, value, group_path, top, depth.

    ``files``: path, content as of the binaryFile source.  Each document is
    parsed where its row is.  ``top`` is the outermost group around a layer;
    data sources and labels carry the id of their map layer.
    """

    def parse(batches):
        for batch in batches:
            rows = [r for path, content in zip(batch["path"], batch["content"]) for r in _table_of(path, document_of(path, content)[1])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ELEMENT.split(", ")])

    return files.select("path", "content").mapInPandas(parse, ELEMENT)


def listing(files: DataFrame) -> DataFrame:
    """Groups and layers of zipped projects, depth first by ``no``: path, no, kind, layer_id, name, group_path, depth."""
    return elements(files).where("kind in ('group', 'layer')").select("path", "no", "kind", "layer_id", F.col("value").alias("name"), "group_path", "depth")


def changes(found: DataFrame, rules: Rules) -> DataFrame:
    """(path, no, what, value) of the elements of ``found`` that the rules change; a null value removes the element.

    ``what``: group, removed, source, label, title, or legacy for the group
    that goes.  What lies inside a removed element is not changed.
    """
    kind = lambda *names: found.where(F.col("kind").isin(*names))
    tops = kind("group").where("depth = 0")
    named = rename_groups(tops.withColumn("was", F.col("value")), rules.groups, "value").where(F.col("was").isin(*rules.groups)) if rules.groups else tops.limit(0)
    legacy = tops.where(F.col("value").eqNullSafe(F.lit(rules.legacy)) & ~F.coalesce(F.col("value").isin(*rules.groups), F.lit(False))) if rules.legacy is not None else tops.limit(0)
    gone = kind("layer").join(legacy.select("path", F.col("value").alias("top")).distinct(), ["path", "top"], "left_semi")
    ids = gone.where("layer_id is not null").select("path", "layer_id").distinct()
    maps = kind("map").join(ids, ["path", "layer_id"], "left_semi")
    stay = lambda t: t.join(ids, ["path", "layer_id"], "left_anti")
    sources = migrate_sources(stay(kind("source")), rules.sources, "value").where("migrated") if rules.sources else found.limit(0)
    labels = rename_labels(stay(kind("label")).unionByName(kind("layer").join(gone.select("path", "no"), ["path", "no"], "left_anti")), rules.labels, "value").where("renamed") if rules.labels else found.limit(0)
    titles = kind("document") if rules.title is not None else found.limit(0)
    first = kind("title").groupBy("path").agg(F.min("no").alias("no")) if rules.title is not None else found.limit(0)
    pick = lambda t, what, value: t.select("path", "no", F.lit(what).alias("what"), value.cast("string").alias("value"))
    out = pick(named, "group", F.col("value"))
    for t, what, value in ((legacy, "legacy", F.lit(None)), (maps, "removed", F.lit(None)), (sources, "source", F.col("value")), (labels, "label", F.col("value")), (titles, "title", F.lit(rules.title)), (first, "title", F.lit(rules.title))):
        out = out.unionByName(pick(t, what, value))
    return out


def counted(changed: DataFrame) -> DataFrame:
    """(path, groups, removed, sources, labels): how many elements of each document change."""
    of = lambda what: F.count_if(F.col("what") == what).alias(f"{what}s" if what != "removed" else what)
    return changed.groupBy("path").agg(*[of(w) for w in ("group", "removed", "source", "label")])


def _with_changes(path: str, content: bytes, todo: list) -> bytes:
    """The archive with its document's elements set or removed by number."""
    name, xml = document_of(path, content)
    root = ET.fromstring(xml)
    numbered, above = list(root.iter()), {child: parent for parent in root.iter() for child in parent}
    for no, value in todo:
        e = numbered[no]
        if value is None:
            above[e].remove(e)
        elif e is root:
            e.set("projectname", value)
        elif KINDS[e.tag] in ("group", "layer"):
            e.set("name", value)
        else:
            e.text = value
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for member in old.namelist():
            z.writestr(member, ET.tostring(root, encoding="utf-8", xml_declaration=True) if member == name else old.read(member))
    return out.getvalue()


def cleaned(files: DataFrame, rules: Rules) -> DataFrame:
    """(path, content, groups, removed, sources, labels): zipped projects by the rules, and how many elements changed."""
    changed = cut(changes(cut(elements(files)), rules))  # the documents are parsed once, and the changes found once
    todo = changed.groupBy("path").agg(F.collect_list(F.struct("no", "value")).alias("todo"))  # of one document
    joined = files.select("path", "content").join(todo, "path", "left")

    def apply(batches):
        for batch in batches:
            done = [_with_changes(p, c, [(t["no"], t["value"]) for t in (todo if todo is not None else [])]) for p, c, todo in zip(batch["path"], batch["content"], batch["todo"])]
            yield pd.DataFrame({"path": batch["path"], "content": done})

    counts = counted(changed)
    return joined.mapInPandas(apply, "path string, content binary").join(counts, "path", "left").na.fill(0)


def clean_file(spark: SparkSession, path: str, rules: Rules) -> dict[str, int]:
    """One project file cleaned in place; the former content stays beside it as ``.bak``.  FileNotFoundError without the file."""
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"no project file {path}")
    done = cleaned(spark.read.format("binaryFile").load(path), rules).first()
    file.with_name(file.name + ".bak").write_bytes(file.read_bytes())
    file.write_bytes(bytes(done["content"]))
    return {c: done[c] for c in ("groups", "removed", "sources", "labels")}
