"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing: records with equal payloads are found by digest; the one with the largest page_id is
written as a response with its payload, the others as revisits that refer to it. Every task
writes gzip members (one per record) to archive files of bounded size in the shared folder and
returns an index row per record: file, offset, length, url, payload digest. Only the files named
by the index, which Spark commits when a task succeeds, belong to the archive, so a task that
is run again leaves at most a file that nobody reads.

Reading: the selected index rows are sorted by file and offset, ranges that lie close together
are read at once, and the records are parsed from their bytes alone.

Defined results
    null html              an empty payload
    null url               no WARC-Target-URI
    null page_id           written and read as null; never the largest if an id is known
    repeated rows          rows that tie for the largest page_id are all responses
    extra columns          ignored
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewarden.plans.durable import durable_root, materialize

#: Compressed bytes after which a task starts another file.
FILE_BYTES = 256 << 20
#: Unread bytes that a read may span, and the most it takes at once.
GAP, READ_BYTES = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"

INDEX = (
    "file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "payload binary"
)


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI that every executor can reach."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    name = str(page_id) if page_id is not None else f"{uuid.uuid5(uuid.NAMESPACE_URL, url or '')}"
    return f"<urn:page:{name}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``refers_to``) carries no payload but tells its length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        # White space and control characters cannot stand in a header.
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, None)}")
    head += [
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def parse(raw: bytes) -> dict:
    """Fields of one record and, for a response, its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": None if url is None else unquote(url),
        "payload_bytes": int(fields["X-Payload-Length"]) if payload is None else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if payload is None else digest(payload),
        "record_type": kind,
        "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": payload,
    }


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to: the largest page_id with an equal payload, null for that record.

    Payloads below ``least_bytes`` are never revisits. Only digests and ids are exchanged to find
    the originals, combined before the exchange, so one payload in a third of all pages loads no task.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumns({"key": F.sha1("payload"), "size": F.octet_length("payload")})
    originals = rows.where(F.col("size") >= least_bytes).groupBy("key", "size").agg(
        F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")
    )
    # Payloads that occur once need no partner.
    originals = materialize(originals.where(F.col("n") > 1).drop("n"), "warc-originals")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return rows.join(originals, ["key", "size"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record per page and return the stored index.

    ``folder`` (by default a new one in the session's shared folder) must be a place that all
    executors reach: a shared mount or a URI that pyarrow opens (s3, gs, hdfs).
    """
    folder = folder or f"{durable_root(pages.sparkSession)}/gatewarden/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                    page_id, url, payload, refers_to = (x.as_py() for x in (page_id, url, payload, refers_to))
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        # A name of its own for every attempt.
                        name, offset = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(name, compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, payload, refers_to)) + packer.flush()
                    out.write(member)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((name, offset, len(member), page_id, url, len(payload), digest(payload), kind, refers_to))
                    offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX.types, strict=True)], schema=_INDEX
                    )
        finally:
            if out is not None:
                out.close()

    return materialize(with_originals(pages, least_bytes).mapInArrow(write, INDEX), "warc-index")


_INDEX = pa.schema(
    [
        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()),
        ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
)
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
)


def ranges(offsets: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) positions of sorted records that one read takes together."""
    found, first = [], 0
    for i in range(1, len(offsets) + 1):
        if (
            i == len(offsets)
            or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > GAP
            or offsets[i] + lengths[i] - offsets[first] > READ_BYTES
        ):
            found.append((first, i))
            first = i
    return found


def read_records(index: DataFrame, folder: str | None = None) -> DataFrame:
    """The records that ``index`` (all of it or selected rows) points to, parsed from the archive's bytes."""
    spark: SparkSession = index.sparkSession
    folder = folder or durable_root(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(folder)
        open_name, source = None, None
        for batch in batches:
            names = batch.column("file").to_pylist()
            offsets, lengths = batch.column("offset").to_numpy(), batch.column("length").to_numpy()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if names[low] != open_name:
                    open_name, source = names[low], files.open_input_file(names[low])
                for first, last in ranges(offsets[low:high], lengths[low:high]):
                    here = slice(low + first, low + last)
                    start = int(offsets[here][0])
                    raw = source.read_at(int(offsets[here][-1] + lengths[here][-1]) - start, start)
                    rows = [
                        parse(zlib.decompress(raw[a - start : a - start + n], 31))
                        for a, n in zip(offsets[here].tolist(), lengths[here].tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    # Files have a bounded size, so a file is a fair unit for a task.
    placed = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, RECORDS)
