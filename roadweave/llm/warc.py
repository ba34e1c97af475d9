"""WARC archives written from and read into a chunked record table."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 64 << 10
#: Payload bytes after which a task begins another archive file.
FILE_BYTES = 512 << 20
BLOCK = 1 << 20
CHUNK_SCHEMA = (
    "file string, record long, record_id string, warc_type string, refers_to string, digest string, length long, uri string, "
    "chunk_no long, chunk_bytes long, sha1_so_far binary, last boolean"
)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _head(row: dict) -> bytes:
    """WARC and HTTP headers of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n"
    body = 0 if row["revisit"] else row["n_bytes"]
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: <urn:x-record:{'' if row['id'] is None else row['id']}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{_base32(row['sha1'])}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + body}",
    ]
    if row["uri"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['uri'], safe=';/?:@&=+$,#%[]!~*()')}")
    if row["revisit"]:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-record:{row['refers_to']}>"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _write(folder: str):
    def write(batches) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        task, out, pack, files, name, n, size = TaskContext.get(), None, None, [], "", 0, 0

        def end() -> None:
            out.write(pack.compress(b"\r\n\r\n") + pack.flush()) if pack else None
            out.close()
            files.append((f"{folder}/{name}", n))

        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()) if batch.nbytes > 64 * BLOCK else batch.to_pylist():
                if row["chunk_no"] == 0:
                    if pack:
                        out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                        pack = None
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            end()
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(files)}.warc.gz"
                        out, n, size = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    pack, n = zlib.compressobj(1, wbits=31), n + 1
                    out.write(pack.compress(_head(row)))
                if row["chunk"]:
                    out.write(pack.compress(row["chunk"]))
                    size += len(row["chunk"])
        if out is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([k for _, k in files], pa.int64())], ["file", "records"])

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload: str = "html", uri: str | None = "url", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write a WARC record for each row into gzipped archives in ``folder``; returns the table of files (file, records).

    Payload: the UTF-8 bytes of ``payload`` (null: empty).  Of records with
    equal payloads of at least ``least`` bytes, the one with the largest id is
    a response, the others are revisits that carry its id and the payload's
    digest and length but no payload; rows that tie on the id are responses
    alike, null ids come last: a null id is a response only where all ids of
    its payload are null, and repeated null ids then are responses all.  An
    empty table gives no archives; other columns are left out.  Payloads travel as chunk rows of ``chunk``
    bytes and are compressed as a stream, so a writer holds one chunk.

    Each task names its files by its attempt; only those of the attempt that
    finished are in the table, which is itself stored.  ``folder`` must be one
    that all executors share and pyarrow can open.
    """
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), (F.col(uri).cast("string") if uri else F.lit(None).cast("string")).alias("uri"), body.alias("body"))
    rows = rows.withColumns({"sha1": F.sha1("body"), "n_bytes": F.octet_length("body").cast("long")})
    same = rows.where(F.col("n_bytes") >= least).groupBy("sha1", "n_bytes").agg(F.count("*").alias("n"), F.max("id").alias("winner")).where("n > 1")
    rows = rows.join(same, ["sha1", "n_bytes"], "left")
    rows = rows.withColumn("revisit", F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner")))
    last = F.when(F.col("revisit"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(F.col("n_bytes") / chunk) - 1)).cast("int")
    part = F.when(~F.col("revisit"), F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    chunks = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last))).select(
        "id", "uri", "sha1", "n_bytes", "revisit", F.col("winner").alias("refers_to"), "chunk_no", part.alias("chunk")
    )
    return common.stored(chunks.mapInArrow(_write(folder), "file string, records long"), "warc-files")


def _blocks(fs: pafs.FileSystem, path: str) -> Iterator[bytes]:
    """The inflated bytes of a file of gzip members, a block at a time."""
    with fs.open_input_stream(path, compression=None) as source:
        unpack, data = zlib.decompressobj(31), b""
        while data or (data := source.read(BLOCK)):
            got = unpack.decompress(data, BLOCK)
            data = unpack.unconsumed_tail
            if got:
                yield got
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(31)


def records_of(blocks: Iterator[bytes], chunk: int) -> Iterator[tuple[int, dict, dict, int, bytes, bool]]:
    """(record number, WARC headers, HTTP headers, chunk number, chunk, whether it is the last) of a WARC stream."""
    held = bytearray()

    def more() -> bool:
        got = next(blocks, None)
        held.extend(got or b"")
        return got is not None

    def head() -> list[str]:
        start = 0
        while (at := held.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(held) - 3)
            if not more():
                raise ValueError("a WARC file ends within a header")
        lines = held[:at].decode("utf-8", "replace").split("\r\n")
        del held[: at + 4]
        return lines

    named = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    number = 0
    while held or more():
        lines = head()
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        warc = named(lines)
        before = int(warc["content-length"])
        lines = head()
        http, left, k = named(lines), before - sum(len(x.encode()) + 2 for x in lines) - 2, 0
        while True:
            take = min(left, chunk)
            while len(held) < take:
                if not more():
                    raise ValueError("a WARC file ends within a record")
            part = bytes(held[:take])
            del held[:take]
            left -= take
            yield number, warc, http, k, part, left == 0
            k += 1
            if not left:
                break
        while len(held) < 4:
            if not more():
                raise ValueError("a WARC file ends within a record")
        del held[:4]
        number += 1


def _read(chunk: int, data: bool):
    def read(batches) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()] + [pa.binary()] * data
        names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")] + ["chunk"] * data
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        bare = lambda x: x and x.removeprefix("<urn:x-record:").removesuffix(">")
        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = _open(file)
                rows, size, digest = [], 0, None
                for number, warc, http, k, part, last in records_of(_blocks(fs, path), chunk):
                    digest = hashlib.sha1() if k == 0 else digest
                    digest.update(part)
                    row = (file, number, bare(warc["warc-record-id"]), warc["warc-type"], bare(warc.get("warc-refers-to")), warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]), warc.get("warc-target-uri"), k, len(part), digest.digest(), last)
                    rows.append((*row, part) if data else row)
                    size += len(part) * data
                    if len(rows) >= 5000 or size >= 8 * BLOCK:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def read_chunks(files: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk table of the archives in ``files``: a row for each record and chunk number, with the SHA-1 up to there.

    Files are read a block at a time, a task for each.  ``data``: whether the
    chunks' bytes come along.  A truncated or malformed file raises.
    """
    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(_read(chunk, data), CHUNK_SCHEMA + ", chunk binary" * data)


def read_records(chunks: DataFrame) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, uri.

    Of a response, bytes and digest are those of the chunks read, and must
    agree with its headers, else the job fails; of a revisit, which has no
    payload, those its headers state of the full payload.  Repeated and null
    ids give a row for each record; without records there are no rows.
    """
    one = chunks.groupBy("file", "record").agg(
        F.sum("chunk_bytes").alias("read_bytes"), F.max_by("sha1_so_far", "chunk_no").alias("sha1"),
        *[F.first(c).alias(c) for c in ("record_id", "warc_type", "refers_to", "digest", "length", "uri")],
    )

    def encoded(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [base64.b32encode(x).decode() for x in b.column("sha1").to_pylist()]
            yield b.set_column(b.schema.get_field_index("sha1"), "sha1", pa.array(digests, pa.string()))

    one = one.select("read_bytes", "sha1", "record_id", "warc_type", "refers_to", "digest", "length", "uri")
    one = one.mapInArrow(encoded, "read_bytes long, sha1 string, record_id string, warc_type string, refers_to string, digest string, length long, uri string")
    revisit = F.col("warc_type") == "revisit"
    whole = revisit | ((F.col("read_bytes") == F.col("length")) & (F.col("sha1") == F.col("digest")))
    checked = F.when(whole, F.col("digest")).otherwise(F.raise_error(F.lit("a record's payload does not match its headers")).cast("string"))
    return one.select(
        F.nullif("record_id", F.lit("")).cast("long").alias("page_id"), F.col("length").alias("payload_bytes"), checked.alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"), "uri",
    )
