"""WARC archives: written by tasks, read again in byte ranges.

Writing. Each task packs its rows into one archive, a gzip member for each record, and returns the
path, size and number of records. A repeated task writes another file, and only paths in the returned table are
ever read, so a lost executor leaves at worst a file that nobody reads. Rows with equal payloads are
written once: the greatest id becomes a ``response`` record, the others become ``revisit`` records
without payload that refer to it. Payloads under ``smallest`` bytes are all responses.

Reading. An archive is cut into byte ranges, one row each, dealt over the tasks. A task looks for gzip
magic in its range, takes a place for a member's start only if the bytes there decode to a WARC header,
and owns the records that start inside; the last one may end beyond the range. Between two members nothing is
searched. The payload's digest is computed anew and must match the header.

Nulls: a null payload is empty; a null id or url is kept (no header). A null id counts as smaller than
any other. Rows of one payload that share its greatest id are all responses. A line break in a url comes back
percent-encoded. A table without rows gives no record.

Archives lie in the shared folder. Tasks open them through ``pyarrow.fs``, which knows local and
mounted folders and the usual object stores.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewindle.llm.common import ready, shared_path, written

MAGIC = b"\x1f\x8b\x08"
#: The profile of a revisit with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT = 8 << 20
#: A header must decode from the first so many bytes of a member.
HEAD = 64 << 10
RECORD = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str | None = None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A")] if url is not None else []
    head += [f"Page-ID: {id}"] if id is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page: {refers_to}"] if revisit and refers_to is not None else [f"WARC-Profile: {PROFILE}"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{digest or _digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + press.flush()


def write(df: DataFrame, smallest: int = 0, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row and return the table of archives: ``path``, ``bytes``, ``records``."""
    spark = df.sparkSession
    ready(spark)
    folder = shared_path(spark, "warc")
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    sized = F.octet_length("html") >= smallest
    rows = rows.withColumn("sha", F.when(sized, F.unhex(F.sha1("html"))))
    again = rows.where(sized).groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = written(again.select(F.col("sha").alias("of"), "first"), "payloads")
    other = F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    told = rows.join(again, rows["sha"] == again["of"], "left").select("id", "url", "html", other.alias("revisit"), F.col("first").alias("refers_to"))

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out: IO | None = None
        path, size, n = "", 0, 0
        for part in parts:
            for row in part.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    name = f"/{uuid.uuid4().hex}.warc.gz"
                    path, out = folder + name, store.open_output_stream(base + name, compression=None)
                body = record(row["id"], row["url"], row["html"].encode(), row["refers_to"], row["revisit"])
                out.write(body)
                size, n = size + len(body), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return written(told.mapInArrow(pack, "path string, bytes long, records long"), "archives")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _is_start(data: bytes, at: int) -> bool:
    """Whether a member that starts here decodes to a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + HEAD], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(file: IO, begin: int, end: int, step: int = 1 << 18) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive whose members start in ``[begin, end)``."""
    file.seek(begin)
    data, base, at, synced = b"", begin, 0, False

    def more() -> bool:
        nonlocal data
        got = file.read(step)
        data += got
        return bool(got)

    while True:
        if not synced:  # look for the next member's start
            found = data.find(MAGIC, at)
            if found < 0:
                base, data, at = base + max(at, len(data) - 2), data[max(at, len(data) - 2) :], 0
                if base >= end or not more():
                    return
                continue
            if base + found >= end:
                return
            while len(data) - found < HEAD and more():
                pass
            at, synced = found, _is_start(data, found)
            at += not synced
            continue
        if base + at >= end:
            return
        base, data, at = base + at, data[at:], 0
        while len(data) < len(MAGIC) and more():
            pass
        if not data.startswith(MAGIC):
            synced = False
            continue
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if used >= len(data) and not more():
                raise ValueError("the archive ends inside a record")
            parts.append(unpack.decompress(data[used:]))
            used = len(data)
        at = len(data) - len(unpack.unused_data)
        yield _parsed(b"".join(parts))


def read(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of all archives, with their payloads (none for revisits)."""
    spark = archives.sparkSession
    ready(spark)
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("begin"))
    ranges = ranges.withColumn("end", F.least(F.col("begin") + split, "bytes"))
    spread = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pending(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema)

        schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        number = lambda x: None if x is None else int(x)
        for part in parts:
            for row in part.to_pylist():
                store, path = _store(row["path"])
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for fields, block in records_in(file, row["begin"], row["end"]):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = fields["WARC-Type"]
                        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (len(payload) != length or _digest(payload) != stated):
                            raise ValueError(f"payload differs from its header in {row['path']}")
                        rows.append(
                            {
                                "id": number(fields.get("Page-ID")),
                                "url": fields.get("WARC-Target-URI"),
                                "record_type": kind,
                                "payload_bytes": length,
                                "payload_digest": stated,
                                "refers_to": number(fields.get("Refers-To-Page")),
                                "payload": payload if kind == "response" else None,
                            }
                        )
                        held += len(payload)
                        if held > 16 << 20:
                            yield pending(rows)
                            rows, held = [], 0
                if rows:
                    yield pending(rows)

    return ranges.repartition(spread, "path", "begin").mapInArrow(scan, RECORD)
