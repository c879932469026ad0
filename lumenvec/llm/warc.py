"""WARC archives as a Spark data source (format ``warc``).

Writing: each task writes ``.warc.gz`` files of at most ``max_file_bytes``, one
gzip member per record; the driver's commit then writes a manifest that names
the files of the tasks that succeeded.  Files of lost or repeated attempts are
not in the manifest and are never read.

Reading: files of the manifest (or all ``.warc.gz`` files where there is none)
become partitions, small files together.  Predicates on record_type, page_id
and target_uri are pushed down.  The header of a record is inflated first; if a
pushed predicate rejects it, or payloads are not asked for, the reader seeks to
the next member: each member carries its compressed length in an ``sl`` extra
field of the gzip header, so a rejected payload is neither read nor inflated.
Archives of other writers have no such field and are inflated to the end; a
member may hold several records there.  A payload that this writer stored is
checked against its digest when it is read.  The
payload is the whole block of a record of any type but revisit, which has none.

Edge cases: a null payload is an empty one; a null id is left out of the header
and read as null; records may repeat; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    InputPartition,
    WriterCommitMessage,
)

from .common import fresh_path, pick, utf8

WRITE_SCHEMA = "page_id bigint, target_uri string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
READ_SCHEMA = WRITE_SCHEMA
MANIFEST = "_manifest.json"
READ_BLOCK = 1 << 16
#: Rows and payload bytes of a batch that the reader hands on.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 20
_ARROW = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path: URIs go by their scheme, plain paths are local."""
    if "://" in path or path.startswith("file:"):
        path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has no block, but the length and digest of its payload."""
    payload = row["payload"] or b""
    digest = row["payload_digest"] or sha1_base32(payload)
    revisit = row["record_type"] == "revisit"
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type'] or 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-X-Payload-Length: {len(payload) if row['payload_bytes'] is None else row['payload_bytes']}",
    ]
    if row["page_id"] is not None:
        lines.append(f"WARC-X-Page-ID: {row['page_id']}")
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['target_uri'], safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-X-Refers-To-Page-ID: {row['refers_to']}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose ``sl`` extra field holds its own compressed and plain lengths."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if total >= 1 << 32:
        raise ValueError("a record of 4 GB or more does not fit a gzip member")
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_file_bytes: int, date: str):
        self.path, self.max_file_bytes, self.date = path, max_file_bytes, date

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_path(self.path)
        store.create_dir(root, recursive=True)
        files, sink, size, name = [], None, 0, ""
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for row in batch.slice(at, 64).to_pylist():
                        if sink is None:
                            name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                            sink = store.open_output_stream(f"{root}/{name}", compression=None)
                        member = gzip_member(record_bytes(row, self.date))
                        sink.write(member)
                        size += len(member)
                        if size >= self.max_file_bytes:
                            sink.close()
                            files.append((name, size))
                            sink = None
        finally:
            if sink is not None:
                sink.close()
                files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_path(self.path)
        store.create_dir(root, recursive=True)
        listed = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"files": listed}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = open_path(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                store.delete_file(f"{root}/{name}")


@dataclass
class Files(InputPartition):
    paths: list[str]


class Member:
    """Streams the records of one gzip member: a head first, its block only if asked for."""

    def __init__(self, source, at: int):
        self.source, self.at = source, at
        source.seek(at)
        start = source.read(24)
        if start[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {at}")
        self.skip = None
        if start[3] & 4 and start[12:14] == b"sl" and start[14:16] == b"\x08\x00":
            (self.skip,) = struct.unpack("<I", start[16:20])
        source.seek(at)
        self.inflate, self.data, self.read = zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        block = self.source.read(READ_BLOCK)
        if not block:
            raise ValueError("truncated gzip member")
        self.read += len(block)
        self.data += self.inflate.decompress(block)
        return True

    def head(self) -> dict[str, str] | None:
        """The next record's headers; None at the end of the member."""
        while (end := self.data.find(b"\r\n\r\n", len(self.data) - len(self.data.lstrip(b"\r\n")))) < 0:
            if not self._more():
                if self.data.strip(b"\r\n"):
                    raise ValueError("WARC record without end of headers")
                return None
        headers = parse_headers(self.data[:end].lstrip(b"\r\n"))
        self.data = self.data[end + 4 :]
        return headers

    def block(self, n: int, keep: bool) -> bytes:
        """The record's block, or nothing if it is passed over."""
        parts, left = [], n
        while True:
            piece, self.data = self.data[:left], self.data[left:]
            left -= len(piece)
            if keep:
                parts.append(piece)
            if not left:
                return b"".join(parts)
            if not self._more():
                raise ValueError("truncated WARC record")

    def next(self) -> int:
        """Where the next member begins."""
        if self.skip is not None:
            return self.at + self.skip
        while not self.inflate.eof:
            self.data = b""
            self._more()
        return self.at + self.read - len(self.inflate.unused_data)


class WarcReader(DataSourceReader):
    PUSHED = {"record_type", "page_id", "target_uri"}

    def __init__(self, path: str, payload: bool, partition_bytes: int):
        self.path, self.payload, self.partition_bytes, self.filters = path, payload, partition_bytes, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.PUSHED:
                self.filters.setdefault(f.attribute[0], []).append(f.value)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = open_path(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").is_file:
            with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = json.loads(f.read())["files"]
        else:
            found = store.get_file_info(fs.FileSelector(root, recursive=True))
            files = [(f.path[len(root) :].lstrip("/"), f.size) for f in found if f.is_file and f.path.endswith(".warc.gz")]
        parts, size = [], self.partition_bytes
        for name, n in sorted(files, key=lambda f: -f[1]):
            if size + n > self.partition_bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(f"{root}/{name}")
            size += n
        return parts or [Files([])]

    def wanted(self, row: dict) -> bool:
        return all(row[k] == v for k, values in self.filters.items() for v in values)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_path(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as source:
                at, end = 0, source.size()
                while at < end:
                    member = Member(source, at)
                    while (h := member.head()) is not None:
                        row, own = self.record(member, h)
                        if row is not None:
                            rows.append(row)
                            size += len(row["payload"] or b"")
                            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                                rows, size = [], 0
                        if own and member.skip is not None:
                            break  # the member's only record: what is left of it is not inflated
                    at = member.next()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def record(self, member: Member, h: dict[str, str]) -> tuple[dict | None, bool]:
        """The row of a record, None if it is not wanted; and whether this writer made it."""
        number = lambda k: int(h[k]) if k in h else None
        digest, own = h.get("warc-payload-digest"), "warc-x-payload-length" in h
        block = number("content-length") or 0
        # a revisit's block is not its payload
        length = None if h.get("warc-type") == "revisit" else number("content-length")
        row = {
            "page_id": number("warc-x-page-id"), "target_uri": h.get("warc-target-uri"), "record_type": h.get("warc-type"),
            "refers_to": number("warc-x-refers-to-page-id"), "payload_bytes": number("warc-x-payload-length") if own else length,
            "payload_digest": digest.rpartition(":")[2] if digest else None, "payload": None,
        }
        wanted = self.wanted(row)
        keep = wanted and self.payload and length is not None
        if keep or not own or member.skip is None:
            payload = member.block(block, keep)
            if keep:
                row["payload"] = payload
                if own and row["payload_digest"] != sha1_base32(payload):
                    raise ValueError(f"the payload of page {row['page_id']} does not have its digest")
        return (row if wanted else None), own


class WarcSource(DataSource):
    """Options: path; payload (true) reads payloads too; max_file_bytes, partition_bytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        payload = self.options.get("payload", "true").lower() == "true"
        return WarcReader(self.options["path"], payload, int(self.options.get("partition_bytes", 32 << 20)))

    def writer(self, schema, overwrite) -> WarcWriter:
        size = int(self.options.get("max_file_bytes", 64 << 20))
        return WarcWriter(self.options["path"], size, self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with the push-down of predicates that Python sources need, from now on."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_rows(
    pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit_bytes: int
) -> DataFrame:
    """The records to write: of equal payloads the smallest id is the response.

    Only (id, digest) pairs meet by digest; payloads are joined by (id, digest),
    so a payload that fills a third of the table gathers in no task.
    """
    page = pick(pages, page_id=id_col, target_uri=url_col, html=html_col).select(
        F.col("page_id").cast("bigint").alias("page_id"), "target_uri", utf8("html").alias("payload")
    )
    page = page.select("*", F.sha2("payload", 256).alias("digest"))
    keys = page.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    revisits = keys.join(first.where("n > 1 and refers_to is not null"), "digest")
    revisits = revisits.where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct()
    return page.join(revisits, ["page_id", "digest"], "left").select(
        "page_id",
        "target_uri",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        "refers_to",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.lit(None).cast("string").alias("payload_digest"),
        "payload",
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
) -> None:
    """Write a WARC record per row under ``path``.

    Of records with equal payloads of at least min_revisit_bytes, the one with
    the smallest id is a response and the others revisit it; rows that repeat
    that id are responses too, and so are rows without an id.
    """
    register(pages.sparkSession)
    rows = archive_rows(pages, id_col, url_col, html_col, min_revisit_bytes)
    rows.write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a fresh archive in the shared folder and read it back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
