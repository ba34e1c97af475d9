"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


@common.tidy
def _windows(batches, n: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        docs, marks = batch.column("doc_id"), batch.column("mark").to_pylist()
        for first, texts in common.slices(batch, "text"):
            row, pos, keys = [], [], []
            for k, text in enumerate(texts):
                lines = text.split(b"\n")
                if len(lines) >= n:
                    keys += [digest(b"\n".join(lines[i : i + n])) for i in range(len(lines) - n + 1)]
                    pos += range(len(lines) - n + 1)
                    row += [first + k] * (len(lines) - n + 1)
            if keys:
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), docs.take(at), pa.array(marks, pa.int64()).take(at), pa.array(pos, pa.int32())], ["window", "doc_id", "mark", "pos"])


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines at the given positions; null without positions."""

    def edit(x, cut):
        if x is None or cut is None:
            return None
        cut = set(cut.tolist())
        return "\n".join(line for i, line in enumerate(x.split("\n")) if i not in cut)

    return pd.Series([edit(x, cut) for x, cut in zip(text, gone)], dtype=object)


def dedup_lines(docs: DataFrame, n: int = 3) -> DataFrame:
    """``docs`` with text rid of repeated runs of lines, plus n_lines INT and n_removed INT.

    Lines are split at line feeds.  Every ``n`` consecutive lines form a
    window, compared by 128-bit hash of their bytes.  Of equal windows
    anywhere in the table, the first by (doc_id, text hash, line) stays; the
    lines under all later ones are removed, overlapping windows merged.  The
    kept lines are joined again.  A text of under ``n`` lines stays as it is.

    The smallest occurrence is found by an aggregation that combines before
    the shuffle, and only windows that occur twice take part in the join back,
    whose hot keys Spark may split; no task gathers a group.

    A very long text is read whole, by one task that holds its windows' hashes.
    Null texts stay null, with n_lines 0.  Null doc_ids come first in the
    order.  Repeated rows with equal doc_id and text count as one document and
    are edited alike.  A document may lose all lines: its text is then empty.
    Own columns called n_lines or n_removed are replaced.  An empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_removed")
    mark, cut, of_doc, of_mark = common.fresh(docs, "ld_mark", "ld_cut", "ld_doc", "ld_of")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    read = marked.where("text is not null").select("doc_id", F.col(mark).alias("mark"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    windows = common.stored(read.mapInArrow(partial(_windows, n=n), f"window binary, doc_id {kind}, mark long, pos int"), "windows")
    place = F.struct("doc_id", "mark", "pos")
    first = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("window", "first")
    later = windows.join(first, "window").where(~place.eqNullSafe(F.col("first")))
    cuts = later.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias(cut))
    cuts = cuts.select(F.col("doc_id").alias(of_doc), F.col("mark").alias(of_mark), cut)
    joined = marked.join(cuts, F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.col(mark) == F.col(of_mark)), "left").drop(of_doc, of_mark, mark)
    lines = F.split("text", "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform(cut, lambda p: F.sequence(p, p + n - 1))))
    kept = _without(F.when(F.col(cut).isNotNull(), F.col("text")), gone)
    out = {c: F.col(c) for c in docs.columns} | {"text": F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)}
    counts = [F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("n_removed")]
    return joined.select(*[v.alias(c) for c, v in out.items()], *counts)


def line_cuts_sql(n: int = 3) -> str:
    """The same result in DuckDB SQL: doc_id, n_lines, n_removed, text."""
    return f"""
with l as (select doc_id, i::int - 1 as pos, list_extract(a, i) as line, len(a)::int as n
           from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null),
                lateral (select unnest(range(1, len(a) + 1)) as i)),
w as (select doc_id, pos, line, n, lead(line, 1) over d as l2, lead(line, 2) over d as l3
      from l window d as (partition by doc_id order by pos)),
f as (select doc_id, pos, row_number() over (partition by line, l2, l3 order by doc_id, pos) as k from w where pos + {n} <= n),
c as (select distinct doc_id, pos + o.o as pos from f, (select unnest(range(0, {n})) as o) o where k > 1),
k as (select l.doc_id, l.n, count(c.pos)::int as n_removed,
             coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where c.pos is null), '') as text
      from l left join c on l.doc_id = c.doc_id and l.pos = c.pos group by l.doc_id, l.n)
select d.doc_id, coalesce(k.n, 0)::int as n_lines, coalesce(k.n_removed, 0)::int as n_removed, k.text
from documents d left join k using (doc_id)"""
