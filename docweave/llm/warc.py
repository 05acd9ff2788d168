"""WARC archives, index first.

``write_archives`` writes one record per page into gzip-per-record archives and returns
the index: archive, offset, length, url and digest of every record.  ``read_records``
takes any selection of index rows, sorts them by archive and offset, coalesces ranges that
lie close together and reads only those.

Payloads that occur more than once are stored once: of equal ones the largest page id is
the response, the others are revisits that name it.

Archives go to the shared folder, through pyarrow's file systems (local, HDFS, S3, GCS).
Every attempt of a task writes a file of its own; only the index rows of the attempt that
Spark commits name a file, so that retries and speculation leave nothing half-written
in use.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import settle, shared_dir

INDEX = "page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint, archive string, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"

#: Ranges closer than this are read as one; a read is no longer than MAX_READ (one record may be).
GAP, MAX_READ = 64 << 10, 8 << 20
#: Archive bytes that one task reads.
TASK_BYTES = 32 << 20
CRLF = "\r\n"


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


def _one_line(value: str) -> str:
    """Header values end at a line's end; percent-encoded, they survive."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _many_lines(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record(row: dict) -> bytes:
    payload = row["payload"] if row["record_type"] == "response" else b""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if row["url"] is None else _one_line(row["url"]),
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "X-Payload-Length": str(row["payload_bytes"]),
        "WARC-Refers-To": None if row["refers_to"] is None else f"<urn:page:{row['refers_to']}>",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row["record_type"] == "revisit" else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(body)),
    }
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in head.items() if v is not None], "", ""]
    return CRLF.join(lines).encode() + body + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, wbits=31)
    return z.compress(data) + z.flush()


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``pages`` with payload (null html: empty), its digest and size, record_type, refers_to.

    Equal payloads of at least ``min_bytes``: the largest page_id is the response, the
    others are revisits; rows that share that id are all responses; null ids are never
    responses for others.  Smaller payloads are all responses.
    The response of each payload is an aggregate of two narrow columns; only digests that
    occur twice come back to the rows, and adaptive execution splits the hot ones there.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    # the aggregate reads its own two columns of the scan: the payloads aren't shuffled for it
    first = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    found = rows.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str | None = None, level: int = 4, max_archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes every row of ``pages`` (page_id, url, html) as a record; returns the index.

    Null urls have no target header, null html is an empty payload, repeated rows are
    records of their own, an empty table writes nothing.  The index is on disk when this
    returns.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_fs(folder)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if out is None or at >= max_archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    data = _gzip(_record(row), level)
                    out.write(data)
                    index.append(
                        {k: row[k] for k in ("page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to")}
                        | {"archive": f"{folder}/{name}", "offset": at, "length": len(data)}
                    )
                    at += len(data)
                if index:
                    yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return settle(plan_records(pages).mapInArrow(write, INDEX))


_INDEX = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in INDEX.split(", ")])
_RECORDS = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in RECORDS.split(", ")])


def _parse(data: bytes) -> dict:
    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda s: int(s.split(":")[-1].rstrip(">")) if s and s.split(":")[-1] != ">" else None
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else body.partition(b"\r\n\r\n")[2]
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": _many_lines(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To", "")),
        "payload": payload,
    }


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MAX_READ) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) pairs as reads: (start, size, the pairs inside)."""
    reads: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in ranges:
        if reads:
            start, size, inside = reads[-1]
            end = max(start + size, offset + length)
            if offset <= start + size + gap and end - start <= most:
                reads[-1] = (start, end - start, [*inside, (offset, length)]) if len(inside) < 64 else reads[-1]
                if len(inside) < 64:
                    continue
        reads.append((offset, length, [(offset, length)]))
    return reads


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the index rows given, parsed; digests and sizes come from the payloads.

    Revisits have no payload of their own: size, digest and the response's id are what
    their headers state.  ``payloads=False`` leaves the payload column null.
    Rows are ranged by archive and offset, so that a task's reads run forward through few
    archives; no archive is read whole, and an archive of many records spreads over tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: dict[str, list[tuple[int, int]]] = {}
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at.setdefault(name, []).append((offset, length))
            for name, ranges in at.items():
                fs, path = _open_fs(name)
                with fs.open_input_file(path) as file:
                    for start, size, inside in coalesce_ranges(ranges):
                        data = file.read_at(size, start)
                        rows = [_parse(data[o - start : o - start + n]) for o, n in inside]
                        if not payloads:
                            rows = [r | {"payload": None} for r in rows]
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / TASK_BYTES))
    ranged = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranged.mapInArrow(read, RECORDS)


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
