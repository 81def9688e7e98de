"""WARC records in ZIP archives: writing, and reading by byte ranges.

An archive is a ZIP file whose members are stored, not compressed:
``archive/data.warc.gz`` (each record a gzip member of its own),
``indexes/index.jsonl`` (offset, length and id of each record) and
``datapackage.json``. The reader never extracts: it reads the end of the file,
the (ZIP64) end records and the central directory, finds where the stored
members lie, reads the index, and then each record by its byte range.

Files go through ``pyarrow.fs``, which takes local, HDFS, S3 and GCS paths
by the same calls; the folder must be one that all executors share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacewx.llm.common import join_unique, mapped, shared_path, slices, written
from surfacewx.sources.files import place

ARCHIVE_BYTES = 8 << 20
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.jsonl", "datapackage.json"
# Fixed values of the ZIP format.
END_SIGN, END64_SIGN, LOCATOR_SIGN, ENTRY_SIGN, LOCAL_SIGN = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
STORED = 0
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Of a path as Hadoop writes it, ``s3a://`` too."""
    return place(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url is not None else None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {safe}"] if safe is not None else []
    lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"] if revisit else []
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields, payload length and digest of a record. The digest of a
    response is taken from its payload and must equal the one it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != length or payload_digest(payload) != stated):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    number = lambda x: int(x[len("<urn:x-page:") : -1]) if x and x != "<urn:x-page:>" else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": stated,
        "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")), "payload": payload if fields["warc-type"] == "response" else None,
    }


def pack(records: list[tuple[int | None, bytes]]) -> bytes:
    """A ZIP archive of records, all members stored."""
    data, index = io.BytesIO(), []
    for page_id, raw in records:
        member = gzip.compress(raw, 6, mtime=0)
        index.append(json.dumps({"id": page_id, "offset": data.tell(), "length": len(member)}))
        data.write(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, content in ((DATA, data.getvalue()), (INDEX, "\n".join(index).encode()), (PACKAGE, json.dumps({"profile": "data-package", "records": len(records)}).encode())):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


class StoredZip:
    """The members of a ZIP file, found from its directories by range reads.

    ``read_at(offset, length)`` reads a byte range of a file of ``size`` bytes.
    """

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail_at = max(0, size - 65_557)  # the end record and the longest comment
        tail = read_at(tail_at, size - tail_at)
        at = tail.rfind(END_SIGN)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END_SIGN, 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP file, or cut off")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if tail_at + at >= 20:
            locator = read_at(tail_at + at - 20, 20)
            if locator[:4] == LOCATOR_SIGN:
                end64 = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end64[:4] != END64_SIGN:
                    raise ValueError("damaged ZIP64 end record")
                count, length, start = struct.unpack_from("<QQQ", end64, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, p = read_at(start, length), 0
        for _ in range(count):
            if directory[p : p + 4] != ENTRY_SIGN:
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            packed, plain, n, e, c = struct.unpack_from("<IIHHH", directory, p + 20)
            local = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[p + 46 + n : p + 46 + n + e]
            q = 0
            while q + 4 <= len(extra):
                kind, long = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # 64-bit values, only of the fields that are full
                    wide = iter(struct.unpack_from(f"<{long // 8}Q", extra, q + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                q += 4 + long
            self.members[name] = (method, local, packed)
            p += 46 + n + e + c

    def range_of(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes lie in the file: offset and length."""
        method, local, length = self.members[name]
        if method != STORED:
            raise ValueError(f"{name} is not stored")
        head = self.read_at(local, 30)
        if head[:4] != LOCAL_SIGN:
            raise ValueError(f"damaged local header of {name}")
        n, e = struct.unpack_from("<HH", head, 26)
        return local + 30 + n + e, length

    def read(self, name: str) -> bytes:
        return self.read_at(*self.range_of(name))


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row into archives in ``folder``; return the written
    manifest ``(path, records, bytes)`` of the archives that count.

    Of rows with equal payloads of at least ``min_payload`` bytes that with
    the smallest id is the response and the others are revisits of it; rows
    that share this id are all responses, and so are all rows if none has an
    id. Null html is an empty payload. An archive is complete under a name of
    its own before the manifest lists it, so a task that runs again leaves
    files that nobody reads, never half ones. Other columns are not read.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    source = source.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    classes = written(source.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "payloads")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_unique(source, classes, "digest", "n", total)
    revisit = (F.octet_length("html") >= min_payload) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = joined.select("page_id", "url", "html", F.col("first").alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)

        def put(records: list) -> pa.RecordBatch:
            name = f"{base}/{uuid.uuid4().hex}.wacz"
            content = pack(records)
            with files.open_output_stream(f"{name}.part") as f:
                f.write(content)
            files.move(f"{name}.part", name)
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name.rpartition('/')[2]}", "records": len(records), "bytes": len(content)}])

        files.create_dir(base, recursive=True)
        held, size = [], 0
        for b in slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page_id, url, html, refers_to, revisit = row
                held.append((page_id, record(page_id, url, html.encode(), refers_to, revisit, date)))
                size += len(held[-1][1])
                if size >= archive_bytes:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    return written(mapped(rows, run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False, tasks: int | None = None) -> DataFrame:
    """The records of the archives at ``manifest.path``: ``(page_id, url,
    payload_bytes, payload_digest, record_type, refers_to)``, with ``payloads``
    also ``payload`` (binary; null for revisits)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    kinds = pa.schema(kinds if payloads else kinds[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                files, name = filesystem(path)
                with files.open_input_file(name) as f:

                    def read_at(offset: int, length: int, f=f) -> bytes:
                        return f.read_at(length, offset)

                    z = StoredZip(read_at, f.size())
                    start, _ = z.range_of(DATA)
                    entries = [json.loads(x) for x in z.read(INDEX).splitlines()]
                    for s in range(0, len(entries), 256):
                        found = [parse_record(gzip.decompress(read_at(start + e["offset"], e["length"]))) for e in entries[s : s + 256]]
                        yield pa.RecordBatch.from_pylist(found, schema=kinds)

    n = tasks or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(manifest.select("path").repartition(n, "path"), run, schema)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in a new shared folder and read them back."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **options))
