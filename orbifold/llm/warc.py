"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Pages become ``response`` records, or ``revisit`` records of the identical-payload-digest profile where an equal
payload of at least :data:`LEAST_REVISIT` bytes belongs to a smaller page_id. A record holds the HTTP header and,
in a response, the payload. The reader decompresses member by member as bytes arrive, frames blocks by
Content-Length and verifies block and payload digests, so a task holds one record at a time.

Null html is the empty payload. Pages with a null page_id are written and read like others, with a null id; they
are never referred to. Repeated rows are written one by one; rows that share the smallest page_id are all responses.
Null urls leave out the target. A record's payload is held whole, however long. An empty table gives no archive and
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_path
from .common import Stored, stored

LEAST_REVISIT = 100
#: An archive is closed when it has reached this size.
ARCHIVE_BYTES = 64_000_000
CHUNK = 1 << 16
#: Parts that the ids of one payload are dealt into, as one payload may be that of many pages.
SALTS = 32
#: Tasks that read archives at most; each reads its archives one after another.
READERS = 20_000
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"{_ID}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if url is not None:
        headers.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        headers += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    headers.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(headers).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after another."""
    data = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            data = data or stream.read(CHUNK)
            if not data:
                if parts or unpack.unconsumed_tail:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(parts)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; raises ValueError where framing or digest is wrong."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{headers.get('warc-record-id')}: the block is not as long as stated")
    stated = headers.get("warc-block-digest")
    if stated and stated != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{headers.get('warc-record-id')}: the block's digest differs")
    return headers, block


def read_page(member: bytes) -> dict:
    """page_id, url, payload (None in a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    headers, block = parse_record(member)
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
    size, digest = int(fields[b"Content-Length"]), headers["warc-payload-digest"].removeprefix("sha256:")
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['warc-record-id']}: the payload's digest differs")

    def page(name: str | None) -> int | None:
        name = (name or "").strip("<>")
        return int(name.removeprefix(_ID)) if name.startswith(_ID) else None

    return {
        "page_id": page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload": None if revisit else payload,
        "payload_bytes": size, "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": page(headers.get("warc-refers-to")),
    }


def with_references(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of ``pages`` (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Revisits are found by ids and digests alone; a payload moves only where too many are to be broadcast.
    large = rows.where(F.length("payload") >= LEAST_REVISIT).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = salted.join(firsts, ["digest", "salt"]).where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    again = Stored(again.groupBy("page_id", "digest").agg(F.min("first").alias("refers_to")), "revisits").df
    same = rows["page_id"].eqNullSafe(again["page_id"]) & (rows["digest"] == again["digest"])
    return rows.join(again, same, "left").select(rows["page_id"], "url", "payload", rows["digest"], "refers_to")


def _opened(uri: str):
    """pyarrow's file system of a URI and the path in it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` as archives in ``folder`` (a URI that all executors can write to); (path, records) of each.

    Every attempt at a task has its own file names, and only those of the attempt that succeeded are listed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, base = _opened(folder)
        where.create_dir(base, recursive=True)
        task = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}"
        done: list[tuple[str, int]] = []
        out, count = None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in (batch.column(k) for k in range(5))), strict=True):
                if out is None:
                    path = f"{folder}/part-{task}-{len(done):03d}.warc.gz"
                    out, count = where.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None), 0
                out.write(record_bytes(*row))
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return stored(with_references(pages).mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of ``archives`` (path): page_id, url[, payload], payload_bytes, payload_digest, record_type, refers_to."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields = [f for f in fields if payload or f[0] != "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], [n for n, _ in fields])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = _opened(path)
                with where.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for member in members(stream):
                        rows.append(read_page(member))
                        size += len(member)
                        if size >= 4_000_000:
                            yield packed(rows)
                            rows, size = [], 0
                    if rows:
                        yield packed(rows)

    schema = "page_id long, url string, " + "payload binary, " * payload + "payload_bytes long, payload_digest string, record_type string, refers_to long"
    # A stated number of partitions, as adaptive execution would put the short rows of paths into one task.
    tasks = min(READERS, max(1, archives.count()))
    return archives.select("path").repartition(tasks, "path").mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of ``pages`` say of each page once they are read back."""
    archives = write_archives(pages, shared_path(pages.sparkSession, "warc"))
    return read_archives(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
